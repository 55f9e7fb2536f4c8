"""Vectors: centroids, nearest centroids, exact neighbours and silhouettes by blocks, diagonal densities, codebooks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance, dot, norm

#: Rows of a block when all pairs of rows are compared.
BLOCK = 2048


def centroids(rows: DataFrame, by: str = "label", v: str = "v") -> DataFrame:
    """by, centroid, size, variance (mean squared distance to the centroid)."""
    x = array_to_vector(F.col(v))
    s = rows.groupBy(by).agg(Summarizer.mean(x).alias("m"), Summarizer.variance(x).alias("s2"), F.count(F.lit(1)).alias("size"))
    spread = F.aggregate(vector_to_array("s2"), F.lit(0.0), lambda a, b: a + b) * (F.col("size") - 1) / F.col("size")
    return s.select(by, vector_to_array("m").alias("centroid"), "size", spread.alias("variance"))


def beside(rows: DataFrame, codebook: DataFrame, *cols: str) -> DataFrame:
    """rows with "book", the whole codebook as one array; a codebook has few rows by nature and is broadcast as one."""
    return rows.join(F.broadcast(codebook.agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("book"))), how="cross")


def nearest(rows: DataFrame, codebook: DataFrame, by: str = "label", v: str = "v", name: str = "token", digits: int = 9) -> DataFrame:
    """rows with name, the nearest codebook entry (ties at so many digits: the least), and dist."""
    best = F.array_min(F.transform("book", lambda c: F.struct(F.round(distance(F.col(v), c["centroid"]), digits).alias("d"), c[by].alias("k"))))
    return beside(rows, codebook, by, "centroid").withColumn("__b", best).withColumn(name, F.col("__b.k")).withColumn("dist", F.col("__b.d")).drop("book", "__b")


def by_blocks(left: DataFrame, right: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, n_left: int, n_right: int, key: str = "id") -> DataFrame:
    """compare(block of left, block of right) for all pairs of blocks: all pairs of rows, in dense pieces of bounded size."""
    a, b = max(1, math.ceil(n_left / BLOCK)), max(1, math.ceil(n_right / BLOCK))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, if both sides are one table
    x = left.withColumn("__a", F.pmod(F.xxhash64(key), F.lit(a))).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    y = right.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(b))).withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    kinds = lambda d: d.withColumns({"__a": F.col("__a").cast("int"), "__b": F.col("__b").cast("int")})
    return kinds(x).groupBy("__a", "__b").cogroup(kinds(y).groupBy("__a", "__b")).applyInPandas(compare, schema)


def _pairwise(a: pd.DataFrame, b: pd.DataFrame, v: str) -> np.ndarray:
    x, y = np.stack(a[v].to_numpy()), np.stack(b[v].to_numpy())
    out = np.empty((len(x), len(y)))
    for i in range(0, len(x), 64):  # differences, not the expanded square: no cancellation
        out[i : i + 64] = np.sqrt(((x[i : i + 64, None, :] - y[None, :, :]) ** 2).sum(-1))
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As _pairwise, by one product of matrices; where the expanded square would cancel digits, from differences."""
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return np.stack([np.sqrt(((r - y) ** 2).sum(-1)) for r in x])
    middle = y.mean(0)
    cx, cy = x - middle, y - middle
    long = lambda a: np.einsum("ij,ij->i", a, a)
    near, far = long(cx)[:, None] + long(cy)[None, :], long(x)[:, None] + long(y)[None, :]
    d = near - 2 * (cx @ cy.T)
    i, j = np.nonzero(~(d >= np.maximum(1e-3 * near, 1e-6 * far)))
    for a in range(0, len(i), 65536):
        p, q = i[a : a + 65536], j[a : a + 65536]
        d[p, q] = ((x[p] - y[q]) ** 2).sum(-1)
    return np.sqrt(d, out=d)


def neighbours(left: DataFrame, right: DataFrame, k: int, v: str = "v", digits: int = 9) -> DataFrame:
    """id, other, dist, rank: the k nearest rows of right (id, v, ...) of each row of left, itself left out; ties by id."""
    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "dist": []}).astype({"id": "int64", "other": "int64"})
        d = np.round(_pairwise(a, b, v), digits)
        d[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = np.inf
        order = np.lexsort((np.broadcast_to(b["id"].to_numpy(), d.shape), d), axis=1)[:, : k]
        rows = np.repeat(np.arange(len(a)), order.shape[1])
        out = pd.DataFrame({"id": a["id"].to_numpy()[rows], "other": b["id"].to_numpy()[order.ravel()], "dist": d[rows, order.ravel()]})
        return out[np.isfinite(out["dist"])]

    from pyspark.sql import Window

    near = by_blocks(left.select("id", v), right.select("id", v), compare, "id long, other long, dist double", left.count(), right.count())
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))).where(F.col("rank") <= k)


def knn_vote(left: DataFrame, right: DataFrame, k: int, label: str = "label", v: str = "v") -> DataFrame:
    """id, vote: the commonest label of the k nearest, of ties the least."""
    near = neighbours(left, right, k, v).join(right.select(F.col("id").alias("other"), F.col(label).alias("l")), "other")
    c = near.groupBy("id", "l").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("id").agg(F.min_by("l", F.struct(-F.col("n"), F.col("l"))).alias("vote"))


def silhouettes_by(rows: DataFrame, labels: tuple[str, ...], v: str = "v") -> DataFrame:
    """nth, id, l, s: exact Euclidean silhouettes by each of several labels, the nth from 0; distances are taken once.

    Of each, all rows with a label of 0 or more; 0 where a label has one row.
    """
    kept = rows.select("id", F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in labels]).alias("ls"), v).where(F.exists("ls", lambda x: x >= 0))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"nth": [], "id": [], "l": [], "k": [], "total": [], "n": []}).astype({"nth": "int32", "id": "int64", "l": "int32", "k": "int32", "n": "int64"})]
        if len(a) and len(b):
            x, y, la, lb = (np.stack(c.to_numpy()) for c in (a[v], b[v], a["ls"], b["ls"]))
            sums = [[] for _ in labels]
            books = [np.unique(lb[lb[:, t] >= 0, t]) for t in range(len(labels))]
            ones = [(lb[:, t, None] == books[t][None, :]).astype(float) for t in range(len(labels))]
            for i in range(0, len(x), 256):
                d = _distances(x[i : i + 256], y)
                for t in range(len(labels)):
                    sums[t].append(d @ ones[t])
            for t, ks in enumerate(books):
                own = la[:, t] >= 0
                out.append(pd.DataFrame({"nth": t, "id": np.repeat(a["id"].to_numpy()[own], len(ks)), "l": np.repeat(la[own, t], len(ks)), "k": np.tile(ks, own.sum()), "total": np.concatenate(sums[t])[own].ravel(), "n": np.tile(ones[t].sum(0).astype(np.int64), own.sum())}))
        return pd.concat(out[1:] or out)

    c = kept.count()
    sums = by_blocks(kept, kept, compare, "nth int, id long, l int, k int, total double, n long", c, c).groupBy("nth", "id", "l", "k").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("k") == F.col("l")
    per = sums.groupBy("nth", "id", "l").agg(F.max(F.when(own, F.col("n"))).alias("size"), F.max(F.when(own, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("b").isNull(), F.lit(None)).when((F.col("size") < 2) | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select("nth", "id", "l", s.alias("s"))


def silhouettes(rows: DataFrame, label: str = "label", v: str = "v") -> DataFrame:
    """id, label, s: exact Euclidean silhouette of each row with a label of 0 or more; 0 where a label has one row."""
    return silhouettes_by(rows, (label,), v).select("id", F.col("l").alias(label), "s")


def diagonal_gaussians(rows: DataFrame, by: str = "label", v: str = "v", jitter: float = 1e-6) -> DataFrame:
    """by, mean, var, log_prior."""
    x = array_to_vector(F.col(v))
    s = rows.groupBy(by).agg(Summarizer.mean(x).alias("m"), Summarizer.variance(x).alias("s2"), F.count(F.lit(1)).alias("n"))
    total = s.agg(F.sum("n").alias("all"))
    return s.join(F.broadcast(total), how="cross").select(by, vector_to_array("m").alias("mean"), F.transform(vector_to_array("s2"), lambda q: q * (F.col("n") - 1) / F.col("n") + jitter).alias("var"), F.ln(F.col("n") / F.col("all")).alias("log_prior"))


def log_density(x: Column, mean: Column, var: Column) -> Column:
    z = F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), var, lambda d, q: d * d / q + F.ln(q) + math.log(2 * math.pi))
    return -F.aggregate(z, F.lit(0.0), lambda a, b: a + b) / 2


def scored(rows: DataFrame, models: DataFrame, by: str = "label", v: str = "v", prior: bool = True) -> DataFrame:
    """rows with scores: array<struct<k, lp>>, of every model the log density and prior."""
    lp = lambda m: log_density(F.col(v), m["mean"], m["var"]) + (m["log_prior"] if prior else F.lit(0.0))
    return beside(rows, models, by, "mean", "var", "log_prior").withColumn("scores", F.transform("book", lambda m: F.struct(m[by].alias("k"), lp(m).alias("lp")))).drop("book")


def best_of(scores: Column, digits: int = 9) -> Column:
    """The k of the highest lp, of ties the least."""
    return F.array_min(F.transform(scores, lambda s: F.struct(-F.round(s["lp"], digits), s["k"].alias("k"))))["k"]


def quantised(rows: DataFrame, coarse: DataFrame, fine: DataFrame, k_fine: int, v: str = "v") -> DataFrame:
    """Residual quantiser: token = coarse * k_fine + fine of what coarse leaves. Codebooks: k, centroid."""
    first = nearest(rows, coarse, "k", v, "coarse").drop("dist")
    first = first.join(F.broadcast(coarse.select(F.col("k").alias("coarse"), "centroid")), "coarse")
    left = first.withColumn("rest", F.zip_with(v, "centroid", lambda a, b: a - b)).drop("centroid")
    return nearest(left, fine, "k", "rest", "fine").withColumn("token", F.col("coarse") * k_fine + F.col("fine"))


def similarity(rows: DataFrame, a: str, b: str) -> Column:
    return F.try_divide(dot(F.col(a), F.col(b)), norm(F.col(a)) * norm(F.col(b)))
