"""Tokenizers by name, the mixture families that their labels make, what hangs on the context, and the adaptive loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import id_hash
from . import evaluation, features, harness, models, tabular, vectors, vocabulary

#: name: rows (id, group, v), the group's column, most tokens of a group -> id, token (-1: noise).
Labels = Callable[[DataFrame, str, int], DataFrame]
TOKENIZERS: dict[str, Labels] = {}


def tokenizer(name: str) -> Callable[[Labels], Labels]:
    """Registers a labelling of vectors under a name; families and evaluations take it by that."""
    def put(labels: Labels) -> Labels:
        TOKENIZERS[name] = labels
        return labels

    return put


@tokenizer("kmeans")
def kmeans_labels(rows: DataFrame, by: str, k: int) -> DataFrame:
    return models.per_group_kmeans(rows, by, k, 2, disjoint=False).select("id", "token")


@tokenizer("density")
def density_labels(rows: DataFrame, by: str, k: int) -> DataFrame:
    return models.density_clusters(rows, 5, 5, by)


def moments_family(rows: DataFrame, by: str, token: str, covariance: str = "full", least: int = 5, jitter: float = 1e-3, v: str = "v") -> DataFrame:
    """by, component, weight, mean, cov (flat): one Gaussian for each token of a group with "least" rows or more; a group
    without any has one of all its rows. Noise (below 0) is left out. covariance: full, or diagonal."""
    def gaussians(m: DataFrame, keys: list[str]) -> DataFrame:
        full = m.unionByName(m.where("i <> j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "n", F.col("mean_j").alias("mean_i"), F.col("mean_i").alias("mean_j"), "cov"))
        c = F.col("cov") + F.when(F.col("i") == F.col("j"), jitter).otherwise(0.0)
        if covariance == "diagonal":
            c = F.when(F.col("i") == F.col("j"), c).otherwise(0.0)
        cells = F.array_sort(F.collect_list(F.struct("i", "j", c.alias("c"), F.col("mean_i").alias("m"))))
        out = full.groupBy(*keys).agg(F.first("n").alias("n"), cells.alias("cells"))
        return out.select(*keys, "n", F.transform(F.filter("cells", lambda x: x["i"] == x["j"]), lambda x: x["m"]).alias("mean"), F.transform("cells", lambda x: x["c"]).alias("cov"))

    good = gaussians(tabular.co_moments(rows.where(F.col(token) >= 0), [by, token], v), [by, token]).where(F.col("n") >= least).withColumn("component", F.col(token).cast("int"))
    rest = rows.join(good.select(by).distinct(), by, "left_anti")
    plain = gaussians(tabular.co_moments(rest, [by], v), [by]).withColumn("component", F.lit(0))
    both = good.select(by, "component", "n", "mean", "cov").unionByName(plain.select(by, "component", "n", "mean", "cov"))
    return both.select(by, "component", (F.col("n") / F.sum("n").over(Window.partitionBy(by))).alias("weight"), "mean", "cov")


def family(rows: DataFrame, by: str, kind: str, k: int = 8, covariance: str = "full", least: int = 5) -> DataFrame:
    """The family of a registered tokenizer."""
    return moments_family(rows.join(TOKENIZERS[kind](rows, by, k), "id"), by, "token", covariance, least)


def with_fallback(own: DataFrame, whole: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """own, and for the groups of rows that have no model there the one of whole, a family of a single group."""
    missing = rows.select(by).distinct().join(own.select(by).distinct(), by, "left_anti")
    return own.unionByName(missing.crossJoin(F.broadcast(whole.drop(by))).select(*own.columns))  # one model for each such group


def components_of(rows: DataFrame, models_: DataFrame, by: str, v: str = "v") -> DataFrame:
    """id, seq_id, k, component, lp: each row's likeliest component under each group's model."""
    m = models_.toPandas()  # components of all groups
    shared = rows.sparkSession.sparkContext.broadcast([(int(g), p["component"].to_numpy(), np.log(np.maximum(p["weight"].to_numpy(), 1e-12)), np.stack(p["mean"].to_numpy()), np.stack(p["cov"].to_numpy()).reshape(len(p), len(p["mean"].iloc[0]), -1)) for g, p in m.groupby(by)])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, names, w, mu, cov in shared.value if len(b) else []:
                lp = models.gaussian_logs(np.stack(b[v].to_numpy()), mu, cov) + w
                yield pd.DataFrame({"id": b["id"], "seq_id": b["seq_id"], "k": g, "component": names[lp.argmax(1)], "lp": lp.max(1)})

    return rows.select("id", "seq_id", v).mapInPandas(score, "id long, seq_id long, k long, component int, lp double")


def gated(rows: DataFrame, models_: DataFrame, by: str, width: int = 100, v: str = "v") -> DataFrame:
    """id, seq_id, predicted, token, oracle_token: the sequence's likeliest group decides whose tokenizer codes its rows;
    beside it the token of the group that is true."""
    guess = models.family_predict(rows, models_, by, v=v).withColumnRenamed("pred", "predicted")
    coded = components_of(rows, models_, by, v).select("id", "seq_id", "k", (F.col("k") * width + F.col("component")).alias("t"))
    truth = rows.select("id", F.col(by).cast("long").alias("__true"))
    both = coded.join(guess, "seq_id").join(truth, "id")
    return both.groupBy("id", "seq_id", "predicted").agg(F.max(F.when(F.col("k") == F.col("predicted"), F.col("t"))).alias("token"), F.max(F.when(F.col("k") == F.col("__true"), F.col("t"))).alias("oracle_token"))


def gate_agreement(coded: DataFrame) -> DataFrame:
    """n, ari, nmi between tokens under the predicted and under the true group."""
    known = coded.where("token is not null and oracle_token is not null")
    return evaluation.agreement(evaluation.contingency(known, "token", "oracle_token")).select("n", "ari", "nmi")


# contexts from sequences


def classify_context(rows: DataFrame, label: str, kind: str = "rf", k: int = 5, seed: int = 0, v: str = "v") -> DataFrame:
    """labels ("real", "drawn"), fold, n, accuracy: cross-validated, and the same with labels drawn anew from the classes'
    shares by a seeded hash, which tells what chance does."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()  # a row for each class
    total, u = sum(r["n"] for r in sizes), id_hash(F.col("id"), F.lit(1), seed + 11)
    edge, drawn = 0.0, F.lit(sizes[-1][label])
    bounds = []
    for r in sizes[:-1]:
        edge += r["n"] / total
        bounds.append((edge * 1000003, r[label]))
    for limit, name in reversed(bounds):
        drawn = F.when(u < limit, F.lit(name)).otherwise(drawn)
    x = models.folds(rows, label, "id", k).withColumn("features", array_to_vector(v))
    out = None
    for said, y in (("real", F.col(label)), ("drawn", drawn)):
        own = x.withColumn("y", y.cast("double"))
        for f in range(k):
            model = RandomForestClassifier(labelCol="y", numTrees=30, impurity="entropy", seed=seed) if kind == "rf" else LogisticRegression(labelCol="y", maxIter=50, regParam=1e-3)
            got = model.fit(own.where(F.col("fold") != f)).transform(own.where(F.col("fold") == f))
            one = got.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 6).alias("accuracy")).select(F.lit(said).alias("labels"), F.lit(f).alias("fold"), "n", "accuracy")
            out = one if out is None else out.unionByName(one)
    return out


def sequence_vectors(seqs: DataFrame, tokens: list[str]) -> DataFrame:
    """id, context, bag, order: shares of tokens, and what of a sequence depends on order, as vectors."""
    bag = features.bag(seqs, tokens, share=True)
    eighteen = features.eighteen(seqs, len(tokens))
    numbers = [f.name for f in eighteen.schema.fields if f.name != "seq_id" and f.dataType.simpleString() not in ("string",)]
    order = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in numbers])
    context = seqs.select("seq_id", "context").distinct()
    return bag.select("seq_id", F.array(*[F.col(f"`n_{t}`").cast("double") for t in tokens]).alias("bag")).join(eighteen.select("seq_id", order.alias("order")), "seq_id").join(context, "seq_id").select(F.col("seq_id").cast("long").alias("id"), "context", "bag", "order")


def hp1_evaluate(seqs: DataFrame, tokens: list[str], kind: str = "rf") -> DataFrame:
    """features ("bag", "order", "both"), n, accuracy, recall (mean over contexts), gain (accuracy over that of the bag):
    what order adds to the bag of tokens when the context is told, on held-out sequences."""
    x = sequence_vectors(seqs, tokens)
    names = [r["context"] for r in x.select("context").distinct().orderBy("context").collect()]  # contexts are few
    code = F.lit(0)
    for i, n in enumerate(names):
        code = F.when(F.col("context") == n, i).otherwise(code)
    x = models.written(x.withColumn("label", code))
    out = None
    for said, v in (("bag", F.col("bag")), ("order", F.col("order")), ("both", F.concat("bag", "order"))):
        got = models.classify(x.select("id", "label", v.alias("v")), kind)
        per = got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") == F.col("label")).cast("int")).alias("hit"))
        one = per.agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("recall")).select(F.lit(said).alias("features"), "n", "accuracy", "recall")
        out = one if out is None else out.unionByName(one)
    out = models.written(out)
    base = out.where("features = 'bag'").select(F.col("accuracy").alias("base"))
    return out.join(F.broadcast(base), how="cross").select("features", "n", F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"), F.round(F.col("accuracy") - F.col("base"), 6).alias("gain"))


# vocabularies of types, refined step by step


def closest_pairs(centres: DataFrame, most: float) -> list[tuple[int, int]]:
    """Pairs of tokens whose centres are at most so far apart, nearest first, each token once. Vocabularies are small."""
    c = centres.select("token", "centroid")
    near = c.alias("x").join(c.alias("y"), F.col("x.token") < F.col("y.token")).select(F.col("x.token").alias("a"), F.col("y.token").alias("b"), F.round(models.vectors.distance(F.col("x.centroid"), F.col("y.centroid")), 9).alias("d")).where(F.col("d") <= most)
    used: set[int] = set()
    out = []
    for r in near.orderBy("d", "a", "b").collect():
        if not {r["a"], r["b"]} & used:
            used |= {r["a"], r["b"]}
            out.append((r["a"], r["b"]))
    return out


def merged_types(rows: DataFrame, most: float | None = None, token: str = "token") -> DataFrame:
    """rows with the tokens of near centres joined (the less stays); most: by default 1.5 times the mean root of the variances."""
    centres = vectors.centroids(rows.where(F.col(token) >= 0), token).withColumnRenamed(token, "token")
    if most is None:
        most = 1.5 * (centres.agg(F.avg(F.sqrt("variance"))).first()[0] or 0.0)
    new = F.col(token)
    for a, b in closest_pairs(centres, most):
        new = F.when(F.col(token) == b, a).otherwise(new)
    return rows.withColumn(token, new)


def split_types(rows: DataFrame, below: float = 0.0, least: int = 30, side: int = 5) -> DataFrame:
    """rows (id, v, token) with each token of a mean silhouette under "below" and "least" rows or more in two, if both sides have "side"."""
    worst = models.scored(rows).groupBy("token").agg(F.avg("s").alias("s"), F.count(F.lit(1)).alias("n")).where((F.col("s") < below) & (F.col("n") >= least)).orderBy("token").collect()
    top = rows.agg(F.max("token")).first()[0] or 0
    for r in worst:
        half = models.kmeans(rows.where(F.col("token") == r["token"]).drop("token"), 2).where("token = 1").select(F.col("id").alias("__m"))
        half = models.written(half)
        if side <= half.count() <= r["n"] - side:
            top += 1
            rows = models.written(rows.join(half, F.col("id") == F.col("__m"), "left").withColumn("token", F.when(F.col("__m").isNotNull(), top).otherwise(F.col("token"))).drop("__m"))
    return rows


def added_types(rows: DataFrame, least: int = 5) -> DataFrame:
    """rows (id, v, token) whose noise (-1) has become tokens where it is dense."""
    noise = rows.where("token = -1").drop("token")
    if noise.isEmpty():
        return rows
    top = rows.agg(F.max("token")).first()[0]
    found = models.density_clusters(noise, least, least).where("token >= 0").select(F.col("id").alias("__m"), (F.col("token") + top + 1).alias("__t"))
    return models.written(rows.join(found, F.col("id") == F.col("__m"), "left").withColumn("token", F.coalesce("__t", "token")).drop("__m", "__t"))


def refined_types(rows: DataFrame, rounds: int = 3, settled: float = 0.01, least: int = 5) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(rows, [(round, tokens)]): split, merge, add, prune, until less than "settled" of the vocabulary changes."""
    size = lambda r: r.where("token >= 0").select("token").distinct().count()
    rows, log = models.written(rows.select("id", "v", F.col("token").cast("int").alias("token"))), []
    before = size(rows)
    for step in range(1, rounds + 1):
        for change in (split_types, merged_types, added_types):
            rows = models.written(change(rows))
        small = [r["token"] for r in rows.where("token >= 0").groupBy("token").count().where(F.col("count") < least).collect()]
        if small and size(rows) - len(small) >= 1:
            noise = rows.where("token = -1").select("id", "token")
            rows = models.written(rows.drop("token").join(harness.absorbed(rows.where("token >= 0"), "token", least).unionByName(noise), "id").select("id", "v", F.col("token").cast("int").alias("token")))
        now = size(rows)
        log.append((step, now))
        if abs(now - before) < settled * max(before, 1):
            break
        before = now
    return rows, log


@dataclass
class Adapted:
    """labels (id, seq_id, pos, v, token), the merges of the last pass, and a line for each outer pass."""

    labels: DataFrame
    merges: list[tuple[str, str, int]] = field(default_factory=list)
    log: list[tuple] = field(default_factory=list)

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "outer int, atoms long, composites long, locked long, unknown long")


def as_sequences(labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """seq_id, pos, token (text) of what is no noise, and of known tokens only; pos is counted anew."""
    rows = labels.where("token >= 0").select("seq_id", "pos", F.col("token").cast("string").alias("token"))
    rows = rows if known is None else rows.join(known, "token", "left_semi")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("seq_id").orderBy("pos")) - 1)


def adapted(rows: DataFrame, outers: int = 3, merges: int = 3, least_change: int = 0, **how) -> Adapted:
    """Turns of a pass over sequences (merges of frequent pairs) and one over sounds (split, merge, add, prune); tokens
    that are part of a composite are locked. Ends when the vocabulary changes by least_change at most."""
    labels, out, before = models.written(rows.select("id", "seq_id", "pos", "v", F.col("token").cast("int").alias("token"))), None, None
    log: list[tuple] = []
    for outer in range(1, outers + 1):
        merger = vocabulary.Merger()
        merger.fit(as_sequences(labels), merges)
        parts = {p for a, b, _ in merger.merges for x in (a, b) for p in x.split(vocabulary.JOINT)}
        locked = tuple(sorted(int(p) for p in parts))
        done = models.refine(labels, "token", rounds=1, locked=locked, **how).labels
        labels = models.written(labels.drop("token").join(done.select("id", "token"), "id"))
        atoms = labels.where("token >= 0").select(F.col("token").cast("string").alias("token")).distinct()
        unknown = as_sequences(labels).join(atoms, "token", "left_anti").count() + len(parts - {r["token"] for r in atoms.collect()})
        size = atoms.count() + len(merger.merges)
        log.append((outer, size - len(merger.merges), len(merger.merges), len(locked), unknown))
        out = Adapted(labels, merger.merges, log)
        if before is not None and abs(size - before) <= least_change:
            break
        before = size
    return out
