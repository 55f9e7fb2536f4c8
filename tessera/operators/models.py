"""Fitted models: clusterers, mixtures per group, projections, splits, and what has to be worked out in NumPy.

What a group fits on is bounded: groups are sampled to FIT rows by the least hash of id, and every row is then
assigned by an expression or an Arrow batch. Bounded samples that a driver works on say so.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors

FIT, WARD = 20_000, 1_500
#: Rows of which a silhouette is taken in refine, as in the reference.
SCORED = 5_000


def sampled(rows: DataFrame, most: int, by: str | None = None, key: str = "id") -> DataFrame:
    """At most so many rows (of each group), those of the least hash of key."""
    if by is None:
        return rows.orderBy(F.xxhash64(key), key).limit(most)
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(key), key))
    return rows.withColumn("__r", r).where(F.col("__r") <= most).drop("__r")


# splits


def folds(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    return rows.withColumn("fold", ((F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1) % k).cast("int"))


def stratified(rows: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """test: a share of each label in the order of a hash, one row at least."""
    at = Window.partitionBy(label)
    least = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(at) * share).cast("int"))
    return rows.withColumn("test", F.row_number().over(at.orderBy(F.col(key) * 48271 % 1000003, key)) <= least)


def group_split(rows: DataFrame, group: str, held: int) -> DataFrame:
    """test: whether the row's group is one of the first so many in the order of a hash."""
    test = rows.select(group).distinct().orderBy(F.col(group) * 48271 % 1000003, group).limit(held).withColumn("test", F.lit(True))
    return rows.join(F.broadcast(test), group, "left").withColumn("test", F.coalesce("test", F.lit(False)))


# scaling and projection


def standardised(rows: DataFrame, v: str = "v") -> DataFrame:
    """z: v less the mean, by the population deviation and 1e-6."""
    s = rows.agg(Summarizer.mean(array_to_vector(v)).alias("m"), Summarizer.variance(array_to_vector(v)).alias("s2"), F.count(F.lit(1)).alias("n"))
    s = s.select(vector_to_array("m").alias("__m"), F.transform(vector_to_array("s2"), lambda x: F.sqrt(x * (F.col("n") - 1) / F.col("n")) + 1e-6).alias("__s"))
    return rows.join(F.broadcast(s), how="cross").withColumn("z", F.zip_with(F.zip_with(v, "__m", lambda a, b: a - b), "__s", lambda a, b: a / b)).drop("__m", "__s")


def pca(rows: DataFrame, k: int, v: str = "v") -> DataFrame:
    """id, v: centred, on the k leading axes; each axis points to where its largest weight is positive."""
    d = len(rows.select(v).first()[0])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = np.stack(b[v].to_numpy()) if len(b) else np.zeros((0, d))
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "ss": [ss.ravel()]})

    parts = rows.select(v).mapInPandas(moments, "n long, s array<double>, ss array<double>").toPandas()  # one row per partition
    n, s, ss = parts["n"].sum(), np.stack(parts["s"]).sum(0), np.stack(parts["ss"]).sum(0).reshape(d, d)
    mean = s / n
    _, axes = np.linalg.eigh(ss / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    return _projected(rows, mean, axes, v)


def random_projection(rows: DataFrame, k: int, seed: int = 0, v: str = "v") -> DataFrame:
    d = len(rows.select(v).first()[0])
    return _projected(rows, np.zeros(d), np.random.default_rng(seed).standard_normal((d, k)) / math.sqrt(k), v)


def _projected(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, v: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": list((np.stack(b[v].to_numpy()) - mean) @ axes)})

    return rows.select("id", v).mapInPandas(run, "id long, v array<double>")


# clusterers


def kmeans(rows: DataFrame, k: int, seed: int = 0, v: str = "v") -> DataFrame:
    x = rows.withColumn("features", array_to_vector(v))
    return KMeans(k=k, seed=seed, maxIter=50, predictionCol="token").fit(x).transform(x).select("id", "token")


def bisecting(rows: DataFrame, k: int, seed: int = 0, v: str = "v") -> DataFrame:
    x = rows.withColumn("features", array_to_vector(v))
    return BisectingKMeans(k=k, seed=seed, predictionCol="token").fit(x).transform(x).select("id", "token")


def lloyd(x: np.ndarray, k: int, seed: int = 0, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels: k-means++ starts, at most "steps" rounds."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.integers(len(x))][None]
    while len(centres) < k:
        d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))]])
    label = np.zeros(len(x), int)
    for _ in range(steps):
        new = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        if (new == label).all() and _:
            break
        label = new
        for j in range(k):
            if (label == j).any():
                centres[j] = x[label == j].mean(0)
    return centres, label


def per_group_kmeans(rows: DataFrame, by: str, k: int, least: int, disjoint: bool = True, v: str = "v") -> DataFrame:
    """rows with token: k-means in each group of "least" rows or more; ids of groups are apart if disjoint."""
    def fit(x: pd.DataFrame) -> pd.DataFrame:
        c, _ = lloyd(np.stack(x[v].to_numpy()), min(k, max(1, len(x) // 5)))
        return pd.DataFrame({by: [x[by].iloc[0]] * len(c), "k": range(len(c)), "centroid": list(c)})

    big = rows.groupBy(by).count().where(F.col("count") >= least)
    kind = rows.schema[by].dataType.simpleString()
    books = sampled(rows.join(F.broadcast(big), by, "left_semi").select("id", by, v), FIT, by).groupBy(by).applyInPandas(fit, f"{by} {kind}, k int, centroid array<double>")
    nth = F.dense_rank().over(Window.orderBy(by)) - 1  # over the groups' centres only
    books = books.withColumn("token", nth * k + F.col("k") if disjoint else F.col("k"))
    packed = books.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("token", "centroid"))).alias("book"))
    best = F.array_min(F.transform("book", lambda c: F.struct(F.round(vectors.distance(F.col(v), c["centroid"]), 9), c["token"].alias("k"))))
    return rows.join(F.broadcast(packed), by).withColumn("token", best["k"]).drop("book")


def linkage_cut(x: np.ndarray, k: int | None = None, height: float | None = None, method: str = "ward", d: np.ndarray | None = None) -> np.ndarray:
    """Labels from 0 by first row: agglomerative clusters, cut at k clusters, or where the next merge is higher than height."""
    n = len(x) if d is None else len(d)
    if d is None:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d = d.astype(float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), n
    while alive > (k or 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        low = d[i, j] ** 0.5 if method == "ward" else d[i, j]
        if not np.isfinite(low) or (height is not None and low > height):
            break
        a, b, s = size[i], size[j], size
        if method == "ward":
            new = ((a + s) * d[i] + (b + s) * d[j] - s * d[i, j]) / (a + b + s)
        else:
            new = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (a * d[i] + b * d[j]) / (a + b)}[method]
        new[[i, j]] = np.inf
        new[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += b
        label[label == j] = i
        alive -= 1
    _, out = np.unique(label, return_inverse=True)
    return out


def ward(rows: DataFrame, k: int, method: str = "ward", v: str = "v") -> DataFrame:
    """id, token: clusters of a bounded sample (WARD rows, on the driver), then every row to its nearest centre."""
    some = sampled(rows.select("id", v), WARD).toPandas()
    x = np.stack(some[v].to_numpy())
    label = linkage_cut(x, k, method=method)
    book = rows.sparkSession.createDataFrame([(int(c), x[label == c].mean(0).tolist()) for c in np.unique(label)], "k int, centroid array<double>")
    return vectors.nearest(rows, book, "k", v).select("id", "token")


def density_labels(x: np.ndarray, least: int, core: int) -> np.ndarray:
    """Clusters of a density hierarchy by greatest persistence, -1 for noise: mutual reachability, spanning tree, condensed."""
    n = len(x)
    if n <= least:
        return np.full(n, -1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    reach = np.sort(d, 1)[:, min(core, n - 1)]
    d = np.maximum(d, np.maximum(reach[:, None], reach[None]))
    near, parent, done = d[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    done[0], edges = True, []
    for _ in range(n - 1):  # Prim
        near[done] = np.inf
        j = int(near.argmin())
        edges.append((near[j], int(parent[j]), j))
        done[j] = True
        closer = d[j] < near
        near[closer & ~done], parent[closer & ~done] = d[j][closer & ~done], j
    up = list(range(2 * n - 1))
    child, high, size, of = {}, {}, [1] * n + [0] * (n - 1), list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for t, (w, a, b) in enumerate(sorted(edges), n):
        a, b = root(a), root(b)
        child[t], high[t], size[t] = (a, b), w, size[a] + size[b]
        up[a] = up[b] = t
    # condense from the top: a split counts when both sides are large enough
    clusters, stack = {0: [0.0, [], []]}, [(2 * n - 2, 0)]  # id: birth, (lambda, point) falls, children
    while stack:
        node, c = stack.pop()
        if node < n:
            clusters[c][1].append((np.inf, [node]))
            continue
        lam = 1 / max(high[node], 1e-12)
        a, b = child[node]
        big = [s for s in (a, b) if size[s] >= least]
        if len(big) == 2:
            for s in (a, b):
                i = len(clusters)
                clusters[i] = [lam, [], []]
                clusters[c][2].append(i)
                stack.append((s, i))
            clusters[c][1].append((lam, []))
            continue
        for s in (a, b):
            if s in big:
                stack.append((s, c))
            else:
                todo, points = [s], []
                while todo:
                    q = todo.pop()
                    if q < n:
                        points.append(q)
                    else:
                        todo += child[q]
                clusters[c][1].append((lam, points))

    def members(c: int) -> list[int]:
        return [p for _, ps in clusters[c][1] for p in ps] + [p for k in clusters[c][2] for p in members(k)]

    worth, chosen = {}, {}
    for c in sorted(clusters, reverse=True):
        birth, falls, kids = clusters[c]
        top = max((l for l, ps in falls if np.isfinite(l)), default=birth)
        own = sum((min(l, top) - birth) * len(ps) for l, ps in falls) + sum((clusters[k][0] - birth) * len(members(k)) for k in kids)
        below = sum(worth[k] for k in kids)
        chosen[c] = not kids or (c != 0 and own >= below)
        worth[c] = own if chosen[c] else below
    out, stack, name = np.full(n, -1), [0], 0
    while stack:
        c = stack.pop()
        if chosen[c] and c != 0:
            out[members(c)] = name
            name += 1
        else:
            stack += clusters[c][2]
    return out


def density_clusters(rows: DataFrame, least: int, core: int, by: str | None = None, v: str = "v") -> DataFrame:
    """id, token (-1 for noise): density clusters of at most WARD rows of each group; the group's other rows go to the
    nearest clustered row's label."""
    group = by or "__all"
    x = rows if by else rows.withColumn("__all", F.lit(0))
    kind = x.schema[group].dataType.simpleString()

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": p["id"], group: p[group], v: p[v], "token": density_labels(np.stack(p[v].to_numpy()), least, core)})

    some = sampled(x.select("id", group, v), WARD, group).groupBy(group).applyInPandas(fit, f"id long, {group} {kind}, {v} array<double>, token int").cache()
    left = x.select("id", group, v).join(some.select("id"), "id", "left_anti")
    books = some.groupBy(group).agg(F.collect_list(F.struct("id", F.col(v).alias("w"), "token")).alias("book"))  # WARD rows at most
    best = F.array_min(F.transform("book", lambda c: F.struct(F.round(vectors.distance(F.col(v), c["w"]), 9), c["id"], c["token"].alias("token"))))
    return some.select("id", "token").unionByName(left.join(books, group).select("id", best["token"].alias("token")))


def reassigned_noise(rows: DataFrame, k: int = 30, label: str = "token", v: str = "v") -> DataFrame:
    """rows whose label is -1 get the commonest label of their k nearest labelled rows."""
    noise, good = rows.where(F.col(label) == -1), rows.where(F.col(label) >= 0)
    vote = vectors.knn_vote(noise, good, k, label, v).withColumnRenamed("id", "__i")
    return rows.join(vote, rows["id"] == vote["__i"], "left").withColumn(label, F.coalesce("vote", label)).drop("__i", "vote")


def merged_components(centres: DataFrame, q: float, label: str = "label") -> DataFrame:
    """label, super: centres closer than the q-quantile of their distances are one, by connected components (least label)."""
    c = centres.select(F.col(label).alias("k"), "centroid")
    d = c.alias("x").join(c.alias("y"), F.col("x.k") < F.col("y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), vectors.distance(F.col("x.centroid"), F.col("y.centroid")).alias("d"))
    e = d.join(F.broadcast(d.agg(F.percentile("d", F.lit(q)).alias("q"))), how="cross").where("d < q").select("a", "b").cache()
    now = c.select(F.col("k"), F.col("k").alias("super"))
    while True:
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(now, F.col("b") == F.col("k")).groupBy(F.col("a").alias("n")).agg(F.min("super").alias("s"))
        new = now.join(near, F.col("k") == F.col("n"), "left").select("k", F.least("super", F.coalesce("s", "super")).alias("super"))
        rows = new.collect()  # one row per centre
        new = centres.sparkSession.createDataFrame(rows, new.schema)
        if {tuple(r) for r in rows} == {tuple(r) for r in now.collect()}:
            return new.select(F.col("k").alias(label), "super")
        now = new


# mixtures


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.asarray(x, float).copy(), 0.0
    for _ in range(6):
        out, x = out - 1 / x, x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def gaussian_logs(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for j, (m, c) in enumerate(zip(means, covs)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, j] = -0.5 * (x.shape[1] * math.log(2 * math.pi) + (z**2).sum(0)) - np.log(np.diag(low)).sum()
    return out


def fit_mixture(x: np.ndarray, k: int, kind: str = "dp", alpha: float = 0.1, steps: int = 150, jitter: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances of at most k Gaussians: "em", or "dp" with stick-breaking weights (truncated
    variational), under which components that explain nothing lose their weight."""
    n, d = x.shape
    _, label = lloyd(x, k)
    r = np.eye(k)[label] if label.max() + 1 <= k else np.eye(label.max() + 1)[label]
    k, base, last = r.shape[1], np.atleast_2d(np.cov(x.T) if n > 1 else np.eye(d)) + jitter * np.eye(d), -np.inf
    for _ in range(steps):
        nk = r.sum(0) + 1e-10
        means = (r.T @ x) / nk[:, None]
        covs = np.empty((k, d, d))
        for j in range(k):
            y = x - means[j]
            covs[j] = ((r[:, j, None] * y).T @ y + base) / (nk[j] + 1) + jitter * np.eye(d)
        if kind == "dp":
            a, b = 1 + nk, alpha + np.r_[np.cumsum(nk[::-1])[::-1][1:], 0]
            stick, rest = digamma(a) - digamma(a + b), digamma(b) - digamma(a + b)
            logw = stick + np.r_[0, np.cumsum(rest)[:-1]]
        else:
            logw = np.log(nk / n)
        lp = gaussian_logs(x, means, covs) + logw
        top = lp.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(lp - top).sum(1))
        r = np.exp(lp - total[:, None])
        if abs(total.sum() - last) < 1e-3:
            break
        last = total.sum()
    return r.sum(0) / n, means, covs


MIXTURE = "component int, weight double, mean array<double>, cov array<double>"


def mixture_family(rows: DataFrame, by: str, k: int, kind: str = "dp", least: int = 10, floor: float = 1e-3, v: str = "v") -> DataFrame:
    """by, component, weight, mean, cov (flat): a mixture per group, fitted on at most FIT of its rows."""
    def fit(p: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(p[v].to_numpy())
        if len(x) < least:
            w, m, c = np.ones(1), x.mean(0)[None], (np.atleast_2d(np.cov(x.T)) if len(x) > 1 else np.zeros((x.shape[1],) * 2))[None] + 1e-3 * np.eye(x.shape[1])
        else:
            w, m, c = fit_mixture(x, k, kind)
        on = w > floor
        return pd.DataFrame({by: p[by].iloc[0], "component": np.flatnonzero(on), "weight": w[on], "mean": list(m[on]), "cov": [a.ravel() for a in c[on]]})

    t = rows.schema[by].dataType.simpleString()
    return sampled(rows.select("id", by, v), FIT, by).groupBy(by).applyInPandas(fit, f"{by} {t}, {MIXTURE}")


def covering(components: DataFrame, by: str, mass: float = 0.95) -> DataFrame:
    """by, k: how many of a group's components, the heaviest first, hold so much of its weight."""
    before = F.sum("weight").over(Window.partitionBy(by).orderBy(F.desc("weight"), "component")) - F.col("weight")
    return components.withColumn("before", before).where(F.col("before") < mass).groupBy(by).agg(F.count(F.lit(1)).alias("k"))


def family_scores(rows: DataFrame, family: DataFrame, by: str, v: str = "v") -> DataFrame:
    """id, seq_id, k, lp: the log density of each row under each group's mixture. Models go to the tasks as one table."""
    m = family.toPandas()  # components of all groups
    shared = rows.sparkSession.sparkContext.broadcast({g: (np.log(np.maximum(p["weight"].to_numpy(), 1e-12)), np.stack(p["mean"].to_numpy()), np.stack(p["cov"].to_numpy()).reshape(len(p), len(p["mean"].iloc[0]), -1)) for g, p in m.groupby(by)})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b[v].to_numpy())
                for g, (w, mu, cov) in shared.value.items():
                    lp = gaussian_logs(x, mu, cov) + w
                    top = lp.max(1)
                    yield pd.DataFrame({"id": b["id"], "seq_id": b["seq_id"], "k": g, "lp": top + np.log(np.exp(lp - top[:, None]).sum(1))})

    return rows.select("id", "seq_id", v).mapInPandas(score, "id long, seq_id long, k long, lp double")


def family_predict(rows: DataFrame, family: DataFrame, by: str, log_prior: dict | None = None, v: str = "v") -> DataFrame:
    """seq_id, pred: the group whose mixture, with its prior, makes the sequence likeliest; of ties the least."""
    s = family_scores(rows, family, by, v).groupBy("seq_id", "k").agg(F.sum("lp").alias("lp"))
    if log_prior:
        s = s.withColumn("lp", F.col("lp") + F.coalesce(*[F.when(F.col("k") == g, float(x)) for g, x in log_prior.items()], F.lit(-1e10)))
    return s.groupBy("seq_id").agg(F.min_by("k", F.struct(-F.round("lp", 6), F.col("k"))).alias("pred"))


# codebooks that follow the data


def ema_codebook(rows: DataFrame, book: DataFrame, decay: float, v: str = "v") -> DataFrame:
    """k, centroid, size after one batch: running means of what is assigned to each entry."""
    near = vectors.nearest(rows, book.select("k", "centroid"), "k", v)
    new = vectors.centroids(near.drop("size") if "size" in near.columns else near, "token", v).select(F.col("token").alias("k"), F.col("centroid").alias("__c"), F.col("size").alias("__n"))
    n = decay * F.col("size") + (1 - decay) * F.coalesce("__n", F.lit(0))
    gain = (1 - decay) * F.coalesce("__n", F.lit(0)) / n
    return book.select("k", "centroid", "size").join(new, "k", "left").select("k", F.when(F.col("__c").isNull(), F.col("centroid")).otherwise(F.zip_with("centroid", "__c", lambda a, b: a + gain * (b - a))).alias("centroid"), n.alias("size"))


# sequences and labels


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping distance of two series of rows."""
    if a.ndim == 1:
        a, b = a[:, None], b[:, None]
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    acc = np.full((len(a) + 1, len(b) + 1), np.inf)
    acc[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            acc[i, j] = cost[i - 1, j - 1] + min(acc[i - 1, j], acc[i, j - 1], acc[i - 1, j - 1])
    return float(acc[-1, -1])


def dtw_ward(rows: DataFrame, by: str, q: float, most: int = 400, width: int = 4, method: str = "ward", v: str = "v") -> DataFrame:
    """id, by, proxy: per group, warping distances of its vectors read as series of "width" steps, clustered and cut at the
    q-quantile of the distances; as in the reference the first "most" rows of a group by id, and -1, "not computed", beyond."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = [np.asarray(a).reshape(width, -1) for a in p[v]]
        n = len(x)
        d = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                d[i, j] = d[j, i] = dtw(x[i], x[j])
        h = float(np.quantile(d[np.triu_indices(n, 1)], q)) if n > 1 else 0.0
        return pd.DataFrame({"id": p["id"], by: p[by], "proxy": linkage_cut(None, None, h, method, d) if n > 1 else np.zeros(n, int)})

    t = rows.schema[by].dataType.simpleString()
    nth = F.row_number().over(Window.partitionBy(by).orderBy("id"))
    got = rows.select("id", by, v).withColumn("__r", nth).where(F.col("__r") <= most).drop("__r").groupBy(by).applyInPandas(run, f"id long, {by} {t}, proxy int")
    return rows.select("id", by).join(got.select("id", "proxy"), "id", "left").withColumn("proxy", F.coalesce("proxy", F.lit(-1)))


def fit_hmm(seqs: list[np.ndarray], states: int, symbols: int, steps: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities by Baum-Welch."""
    rng = np.random.default_rng(seed)
    norm = lambda a: a / a.sum(-1, keepdims=True)
    pi, tr, em = norm(np.ones(states)), norm(rng.random((states, states)) + 1), norm(rng.random((states, symbols)) + 1)
    for _ in range(steps):
        p, t, e = np.full(states, 1e-3), np.full((states, states), 1e-3), np.full((states, symbols), 1e-3)
        for s in seqs:
            f, c = np.empty((len(s), states)), np.empty(len(s))
            for i, x in enumerate(s):
                f[i] = (pi if i == 0 else f[i - 1] @ tr) * em[:, x]
                c[i] = f[i].sum()
                f[i] /= c[i]
            b = np.ones(states)
            for i in range(len(s) - 1, -1, -1):
                g = norm(f[i] * b)
                e[:, s[i]] += g
                if i:
                    t += f[i - 1][:, None] * tr * (em[:, s[i]] * b) / c[i]
                    b = tr @ (em[:, s[i]] * b) / c[i]
                else:
                    p += g
        pi, tr, em = norm(p), norm(t), norm(e)
    return pi, tr, em


def hmm_log(s: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    pi, tr, em = model
    f, out = None, 0.0
    for x in s:
        f = (pi if f is None else f @ tr) * em[:, x]
        out += math.log(f.sum())
        f /= f.sum()
    return out


def hmm_classify(lists: DataFrame, by: str, symbols: list[str], states: int = 3, most: int = 500) -> DataFrame:
    """seq_id, context, pred: an HMM for each class (at most so many sequences), each sequence to the likeliest."""
    place = {s: i for i, s in enumerate(symbols)}

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        pi, tr, em = fit_hmm([np.array([place[t] for t in s]) for s in p["seq"]], states, len(symbols))
        return pd.DataFrame({"k": [p[by].iloc[0]], "pi": [pi], "tr": [tr.ravel()], "em": [em.ravel()]})

    fitted = sampled(lists, most, by, "seq_id").groupBy(by).applyInPandas(fit, "k string, pi array<double>, tr array<double>, em array<double>").toPandas()
    shared = lists.sparkSession.sparkContext.broadcast({r.k: (np.asarray(r.pi), np.asarray(r.tr).reshape(states, -1), np.asarray(r.em).reshape(states, -1)) for r in fitted.itertuples()})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ms = shared.value
            best = [min((-hmm_log(np.array([place[t] for t in s]), m), k) for k, m in ms.items())[1] for s in b["seq"]]
            yield pd.DataFrame({"seq_id": b["seq_id"], "context": b[by], "pred": best})

    return lists.select("seq_id", by, "seq").mapInPandas(score, "seq_id long, context string, pred string")


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: inverse to the size of their class, one on average."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    t = c.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    return rows.join(F.broadcast(c), label).join(F.broadcast(t), how="cross").withColumn("weight", F.col("__t") / (F.col("__k") * F.col("__n"))).drop("__n", "__t", "__k")


def classify(rows: DataFrame, kind: str, label: str = "label", v: str = "v") -> DataFrame:
    """id, label, pred of the held-out fifth: random forest or logistic regression with balanced weights."""
    x = stratified(rows, label, "id", 0.2).withColumn("features", array_to_vector(v)).withColumn("y", F.col(label).cast("double"))
    train = balanced(x.where(~F.col("test")), label)
    model = RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=30, maxDepth=8, seed=0) if kind == "rf" else LogisticRegression(labelCol="y", weightCol="weight", maxIter=50, regParam=1e-3)
    return model.fit(train).transform(x.where("test")).select("id", label, F.col("prediction").cast("int").alias("pred"))


# the loop over an acoustic vocabulary


@dataclass
class Refined:
    labels: DataFrame
    log: list[tuple] = field(default_factory=list)

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "step int, kind string, a int, b int, silhouette double, vocabulary int")


def written(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back, which cuts their lineage."""
    spark = rows.sparkSession
    folder = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/tessera-shared").rstrip("/")
    path = f"{folder}/refined-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def scored(rows: DataFrame) -> DataFrame:
    """Silhouettes of SCORED rows among each other: all pairs of rows are compared."""
    return vectors.silhouettes(sampled(rows.where("token >= 0"), SCORED), "token")


def score(rows: DataFrame) -> float:
    r = scored(rows).agg(F.avg("s")).first()[0]
    return float("nan") if r is None else float(r)


def refine(rows: DataFrame, label: str = "label", rounds: int = 2, drop: float = 0.02, prune_below: int = 20, split_below: float = 0.0, add_above: float = 0.95, locked: tuple[int, ...] = (), v: str = "v") -> Refined:
    """Split, merge, add and prune clusters of all rows: each change is kept only if the silhouette (of SCORED rows) allows it.

    Merge: the closest pair of centres within the lowest decile of their distances, while the silhouette falls by no more
    than drop. Split: the cluster of the worst silhouette, in two, if the whole gets no worse than 0.01. Add: what is
    farther from every centre than the quantile becomes a cluster if that is better. Prune: clusters of too few rows go to
    the nearest centre, in one pass. Labels are replaced by plans over the ones before and written out in each round.
    """
    spark = rows.sparkSession
    fixed = lambda d: written(d.select("id", "v", F.col("token").cast("int").alias("token")))
    now = fixed(rows.select("id", F.col(v).alias("v"), F.col(label).alias("token")))
    log: list[tuple] = []
    size = lambda d: d.where("token >= 0").select("token").distinct().count()
    s = score(now)
    log.append((0, "seed", -1, -1, s, size(now)))
    for step in range(1, rounds + 1):
        changed = False
        sizes = now.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        worst = scored(now).groupBy("token").agg(F.avg("s").alias("s")).join(sizes, "token").where((F.col("s") < split_below) & (F.col("n") >= 2 * prune_below)).orderBy("s", "token").first()
        if worst and worst["token"] not in locked:
            own = now.where(F.col("token") == worst["token"]).drop("token")
            new = now.agg(F.max("token")).first()[0] + 1
            moved = kmeans(own, 2).where("token = 1").select(F.col("id").alias("m"))
            then = fixed(now.join(moved, F.col("id") == F.col("m"), "left").withColumn("token", F.when(F.col("m").isNotNull(), new).otherwise(F.col("token"))))
            if (t := score(then)) >= s - 0.01:
                now, s, changed = then, t, True
                log.append((step, "split", worst["token"], new, s, size(now)))
        c = vectors.centroids(now.where("token >= 0"), "token").select("token", "centroid")
        pairs = c.alias("x").join(c.alias("y"), F.col("x.token") < F.col("y.token")).select(F.col("x.token").alias("a"), F.col("y.token").alias("b"), vectors.distance(F.col("x.centroid"), F.col("y.centroid")).alias("d"))
        limit = pairs.agg(F.percentile("d", F.lit(0.1))).first()[0]
        top = pairs.where(F.col("d") <= limit).orderBy("d", "a", "b").first() if limit is not None else None
        if top and top["a"] not in locked and top["b"] not in locked:
            then = fixed(now.withColumn("token", F.when(F.col("token") == top["b"], top["a"]).otherwise(F.col("token"))))
            if (t := score(then)) >= s - drop:
                now, s, changed = then, t, True
                log.append((step, "merge", top["a"], top["b"], s, size(now)))
        near = vectors.nearest(now.drop("token"), vectors.centroids(now.where("token >= 0"), "token").select("token", "centroid"), "token")
        cut = near.agg(F.percentile("dist", F.lit(add_above))).first()[0]
        far = near.where(F.col("dist") > cut).select(F.col("id").alias("m"))
        if far.count() >= 2 * prune_below:
            new = now.agg(F.max("token")).first()[0] + 1
            then = fixed(now.join(far, F.col("id") == F.col("m"), "left").withColumn("token", F.when(F.col("m").isNotNull(), new).otherwise(F.col("token"))))
            if (t := score(then)) >= max(s, 0.3):
                now, s, changed = then, t, True
                log.append((step, "add", new, -1, s, size(now)))
        small = [r["token"] for r in now.groupBy("token").count().where(F.col("count") < prune_below).collect() if r["token"] not in locked]
        if small and size(now) - len(small) >= 2:
            keep = vectors.centroids(now.where(~F.col("token").isin(small)), "token").select("token", "centroid")
            near = vectors.nearest(now.withColumnRenamed("token", "old"), keep, "token")
            now, changed = fixed(near.withColumn("token", F.when(F.col("old").isin(small), F.col("token")).otherwise(F.col("old")))), True
            s = score(now)
            log.append((step, "prune", min(small), -1, s, size(now)))
        if not changed:
            break
    return Refined(now, log)
