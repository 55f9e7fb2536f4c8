"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue per query.

Vectors are brought to the unit sphere by one more coordinate (largest inner product becomes smallest distance), the
trees' hyperplanes are fitted on a bounded sample, every row is put into one leaf of each tree, and each query opens
leaves of all trees in the order of its margins to the hyperplanes it would have to cross. Leaf members are reranked
exactly. Equal vectors are one entry with their smallest ids, as many as an answer can hold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import settle

#: Each query opens OPENED leaves at least, and this share of all leaves of the forest.
TREES, LEAF, OPENED, SHARE = 16, 256, 180, 0.05
#: Trees are fitted on so many rows at most (least hash of id), and are so deep at most.
SAMPLE, DEEPEST = 20_000, 13
SALTS = 64


def fit(sample: np.ndarray, depth: int, trees: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes (trees x nodes x dims) and offsets (trees x nodes) of full binary trees, nodes in level order."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    planes, offsets = np.zeros((trees, 2**depth - 1, dims)), np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        rows = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            own = rows.pop(node)
            if len(own) > 1:
                a, b = sample[rng.choice(own, 2, replace=False)]
                way = a - b
            else:
                way = np.zeros(dims)
            if not np.any(way):
                way = rng.standard_normal(dims)
            way /= np.linalg.norm(way)
            at = sample[own] @ way
            planes[t, node], offsets[t, node] = way, np.median(at) if len(own) else 0.0
            right = at > offsets[t, node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return planes, offsets


def leaf_of(x: np.ndarray, planes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x trees: the leaf of each row, from 0."""
    out = np.zeros((len(x), len(planes)), np.int32)
    for t, (p, o) in enumerate(zip(planes, offsets)):
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(o) + 1))):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, p[node]) > o[node])
        out[:, t] = node - len(o)
    return out


def opened(q: np.ndarray, planes: np.ndarray, offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the leaves that a query opens, all trees sharing one queue by least margin crossed."""
    inner = offsets.shape[1]
    side = (np.einsum("tnd,d->tn", planes, q, optimize=True) - offsets).tolist()
    heap = [(0.0, t, 0) for t in range(len(planes))]
    out: list[tuple[int, int]] = []
    while heap and len(out) < most:
        cross, t, node = heapq.heappop(heap)
        own = side[t]
        while node < inner:
            s = own[node]
            right = s > 0
            heapq.heappush(heap, (max(cross, abs(s)), t, 2 * node + 1 + (not right)))
            node = 2 * node + 1 + right
        out.append((t, node - inner))
    return out


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """On the unit sphere: x by the longest length, and what is missing as one more coordinate."""
    y = x / longest
    return np.c_[y, np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", y, y)))]


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & ok & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, leaf: int = LEAF, most: int = OPENED, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k found rows of largest inner product (double), its own row left out.

    Ties go to the smaller id, of equal and of different vectors. Null, empty, zero, and non-finite vectors take no part,
    nor do null ids. Vectors shorter than the longest count as if zeros followed. Rows that repeat an id count once for
    each distinct vector. Fewer candidates give fewer rows, an empty table none. Other columns are not read, whatever
    their names.
    """
    rows = vectors.select(vectors[vec_id].alias("id"), F.transform(vectors[vector], lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    # vectors of single precision are sent to the leaves as such, which loses nothing
    single = isinstance(vectors.schema[vector].dataType, ArrayType) and isinstance(vectors.schema[vector].dataType.elementType, FloatType)
    sent = np.float32 if single else np.float64
    top = rows.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not top["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, count, longest = top["d"], top["n"], float(np.sqrt(top["longest"])) * (1 + 1e-9)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), dims - F.size("v")))).withColumn("key", F.xxhash64("v"))
    # of equal vectors the k + 1 smallest ids, first by salt
    salted = Window.partitionBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    whole = Window.partitionBy("key").orderBy("id")
    few = rows.dropDuplicates(["key", "id"]).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    asked = rows.where("q").select(F.col("key").alias("qkey"), F.col("id").alias("query_id")).distinct()
    distinct = few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    distinct = settle(distinct.join(asked.select(F.col("qkey").alias("key"), F.lit(True).alias("q")).distinct(), "key", "left"), "vectors")
    depth = int(np.clip(np.ceil(np.log2(max(count, 1) / leaf)), 1, DEEPEST))
    most = max(most, int(np.ceil(SHARE * trees * 2**depth)))
    picked = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect()])
    forest = vectors.sparkSession.sparkContext.broadcast(fit(lifted(picked, longest), depth, trees))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes, offsets = forest.value
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy())
            leaves = leaf_of(lifted(x, longest), planes, offsets)
            for t in range(leaves.shape[1]):
                yield pd.DataFrame({"tree": t, "leaf": leaves[:, t], "coarse": leaves[:, t] >> 4, "key": b["key"].to_numpy(), "least": b["least"].to_numpy(), "v": list(x.astype(sent))})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes, offsets = forest.value
        for b in batches:
            for key, v in zip(b["key"], b["v"]):
                v = np.asarray(v)
                ways = np.array(opened(np.r_[v / np.linalg.norm(v), 0.0], planes, offsets, most), np.int32)
                yield pd.DataFrame({"tree": ways[:, 0], "leaf": ways[:, 1], "coarse": ways[:, 1] >> 4, "key": key, "least": 0, "v": [v.astype(sent)] * len(ways)})

    def rank(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(queries):
            at = dict(list(members.groupby("leaf").indices.items()))
            mv, qv = (np.stack(x["v"].to_numpy()).astype(float) for x in (members, queries))
            mk, ml, qk = members["key"].to_numpy(), members["least"].to_numpy(), queries["key"].to_numpy()
            for name, qi in queries.groupby("leaf").indices.items():
                mi = at.get(name)
                if mi is None:
                    continue
                near = qv[qi] @ mv[mi].T
                if len(mi) > k + 1:  # all that may be among the first k + 1: the product's own rounding is allowed for
                    edge = np.partition(near, len(mi) - k - 1, axis=1)[:, len(mi) - k - 1]
                    x, y = np.nonzero(near >= (edge - 1e-12 * (np.abs(edge) + longest * longest))[:, None])
                else:
                    x, y = (a.ravel() for a in np.indices(near.shape))
                score = (mv[mi[y]] * qv[qi[x]]).sum(-1)
                order = np.lexsort((ml[mi[y]], -score, x))
                x, y, score = x[order], y[order], score[order]
                few = np.arange(len(x)) - np.searchsorted(x, x) <= k
                out.append(pd.DataFrame({"qkey": qk[qi[x[few]]], "key": mk[mi[y[few]]], "least": ml[mi[y[few]]], "score": score[few]}))
        if out:  # of all the leaves of the group that a query opens, no more than the first k + 1
            found = pd.concat(out).sort_values(["qkey", "score", "least"], ascending=[True, False, True], kind="stable")
            at = found["qkey"].to_numpy()
            return found[np.arange(len(at)) - np.searchsorted(at, at) <= k]
        return pd.DataFrame({"qkey": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "least": np.zeros(0, np.int64), "score": np.zeros(0)})

    shape = f"tree int, leaf int, coarse int, key long, least long, v array<{'float' if single else 'double'}>"
    members = distinct.select("key", F.col("ids")[0].cast("long").alias("least"), "v").mapInPandas(place, shape)
    queries = distinct.where("q").select("key", "v").mapInPandas(ask, shape)
    pairs = members.groupBy("tree", "coarse").cogroup(queries.groupBy("tree", "coarse")).applyInPandas(rank, "qkey long, key long, least long, score double")
    # the k + 1 first vectors by score and smallest id hold the k first ids, as each comes with its smallest ids
    best = pairs.groupBy("qkey", "key").agg(F.max("score").alias("score"), F.min("least").alias("least")).withColumn("r", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "least"))).where(F.col("r") <= k + 1)
    full = best.join(distinct.select("key", "ids"), "key").select("qkey", "score", F.explode("ids").alias("vec_id")).join(asked, "qkey").where("query_id <> vec_id")
    order = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), "score")
