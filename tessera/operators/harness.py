"""Experiment harness and what stands between operators: pooling, absorbing, permuting, voting, sweeping, stability."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation, language, models, sequences, vectors

# vectors and labels


def pooled(rows: DataFrame, by: str, deviation: bool = True, v: str = "v") -> DataFrame:
    """by, pooled: the mean of a sequence's vectors, followed by their population deviation."""
    x = array_to_vector(v)
    s = rows.groupBy(by).agg(Summarizer.mean(x).alias("m"), Summarizer.variance(x).alias("s2"), F.count(F.lit(1)).alias("n"))
    std = F.transform(vector_to_array("s2"), lambda q: F.sqrt(q * (F.col("n") - 1) / F.col("n")))
    return s.select(by, F.concat(vector_to_array("m"), std).alias("pooled") if deviation else vector_to_array("m").alias("pooled"))


def absorbed(rows: DataFrame, label: str, least: int, v: str = "v") -> DataFrame:
    """id, token: rows of labels with fewer rows than "least" get the nearest centre of the others."""
    big = rows.groupBy(label).count().where(F.col("count") >= least).select(label)
    near = vectors.nearest(rows.join(F.broadcast(big), label, "left_anti"), vectors.centroids(rows.join(F.broadcast(big), label, "left_semi"), label, v), label, v, "token")
    return rows.join(F.broadcast(big), label, "left_semi").select("id", F.col(label).alias("token")).unionByName(near.select("id", "token"))


def pruned_by_neighbours(rows: DataFrame, label: str, least: int, k: int = 5, v: str = "v") -> DataFrame:
    """id, token: rows of small labels get the label of greatest weight 1 / distance of their k nearest rows of others."""
    big = rows.groupBy(label).count().where(F.col("count") >= least).select(label)
    good, small = rows.join(F.broadcast(big), label, "left_semi"), rows.join(F.broadcast(big), label, "left_anti")
    near = vectors.neighbours(small, good, k, v).join(good.select(F.col("id").alias("other"), F.col(label).alias("l")), "other")
    votes = near.groupBy("id", "l").agg(F.round(F.sum(1 / (F.col("dist") + 1e-9)), 6).alias("w"))
    return good.select("id", F.col(label).alias("token")).unionByName(votes.groupBy("id").agg(F.min_by("l", F.struct(-F.col("w"), F.col("l"))).alias("token")))


def permuted_ids(rows: DataFrame, label: str, seed: int = 0) -> DataFrame:
    """rows with token: labels renumbered from 0 in the order of a seeded hash."""
    names = rows.select(label).distinct()
    order = F.row_number().over(Window.orderBy((F.col(label).cast("long") * 48271 + seed * 7919) % 1000003, label)) - 1  # over the labels only
    return rows.join(F.broadcast(names.withColumn("token", order)), label)


def component_ids(scores: DataFrame, by: str, component: str, lp: str, width: int) -> DataFrame:
    """id, token: the likeliest component of each row's own group, with ids of groups apart (group * width + component)."""
    return scores.groupBy("id").agg(F.min_by(F.struct(by, component), F.struct(-F.round(lp, 9), F.col(by), F.col(component))).alias("b")).select("id", (F.col(f"b.{by}") * width + F.col(f"b.{component}")).alias("token"))


def split_in_two(rows: DataFrame, label: str, which: int, v: str = "v") -> DataFrame:
    """id, token: one label's rows in two by 2-means; the first part keeps the label, the other gets the next free one."""
    own = models.kmeans(rows.where(F.col(label) == which), 2, v=v).withColumnRenamed("token", "half")
    new = rows.agg(F.max(label)).first()[0] + 1
    return rows.join(own, "id", "left").select("id", F.when(F.col("half") == 1, F.lit(new)).otherwise(F.col(label)).alias("token"))


def adaptive_codebook(rows: DataFrame, k: int, least: int = 10, q: float = 0.1, rounds: int = 3, v: str = "v") -> DataFrame:
    """k, centroid, size: k-means entries of which the little used go and those closer than the q-quantile are joined."""
    now = vectors.centroids(models.kmeans(rows, k, v=v).join(rows, "id"), "token", v).select(F.col("token").alias("k"), "centroid", "size")
    for _ in range(rounds):
        book = now.where(F.col("size") >= least).toPandas()  # at most k entries
        c = np.stack(book["centroid"])
        d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
        pairs = [(d[i, j], i, j) for i, j in itertools.combinations(range(len(c)), 2)]
        low, used, out = (np.quantile([p[0] for p in pairs], q) if pairs else 0.0), set(), []
        for dist, i, j in sorted(pairs):
            if dist <= low and not {i, j} & used:
                used |= {i, j}
                n = book["size"][[i, j]].to_numpy()
                out.append(((c[[i, j]] * n[:, None]).sum(0) / n.sum()).tolist())
        out += [c[i].tolist() for i in range(len(c)) if i not in used]
        fixed = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(out)], "k int, centroid array<double>")
        near = vectors.nearest(rows, fixed, "k", v)
        now = rows.sparkSession.createDataFrame(vectors.centroids(near.drop("k"), "token", v).select(F.col("token").alias("k"), "centroid", "size").collect(), "k int, centroid array<double>, size long")
    return now


def voted(rows: DataFrame, by: str, pred: str) -> DataFrame:
    """by, pred: the commonest prediction of each sequence's rows, of ties the least."""
    return sequences.mode(rows, [by], pred, pred)


def model_choice(rows: DataFrame, ks: tuple[int, ...], label: str = "label") -> DataFrame:
    """k, silhouette, ari, nmi, score (silhouette + ari / 2 + nmi / 2) of k-means for each k."""
    got, agree = rows.select("id", "v", label), None
    for i, k in enumerate(ks):
        got = got.join(models.kmeans(rows, k).select("id", F.col("token").alias(f"__{i}")), "id")
    got = models.written(got)
    for i, k in enumerate(ks):
        one = evaluation.agreement(evaluation.contingency(got, label, f"__{i}")).select(F.lit(i).alias("nth"), F.lit(k).alias("k"), "ari", "nmi")
        agree = one if agree is None else agree.unionByName(one)
    s = vectors.silhouettes_by(got, tuple(f"__{i}" for i in range(len(ks)))).groupBy("nth").agg(F.avg("s").alias("silhouette"))
    return s.join(F.broadcast(agree), "nth").select("k", F.round("silhouette", 6).alias("silhouette"), "ari", "nmi", F.round(F.col("silhouette") + F.col("ari") / 2 + F.col("nmi") / 2, 6).alias("score"))


def stability(fit: Callable[[int], DataFrame], seeds: tuple[int, ...]) -> DataFrame:
    """mean_ari, std_ari of every two seeds' labels (id, token)."""
    runs = {s: fit(s).withColumnRenamed("token", f"t{s}") for s in seeds}
    out = None
    for a, b in itertools.combinations(seeds, 2):
        one = evaluation.agreement(evaluation.contingency(runs[a].join(runs[b], "id"), f"t{a}", f"t{b}")).select("ari")
        out = one if out is None else out.unionByName(one)
    return out.agg(F.round(F.avg("ari"), 6).alias("mean_ari"), F.round(F.stddev_pop("ari"), 6).alias("std_ari"), F.count(F.lit(1)).alias("pairs"))


def full_evaluation(rows: DataFrame, token: str, label: str, group: str, v: str = "v") -> DataFrame:
    """metric, value: silhouette, noise, agreement with labels, purity, vocabulary and per-group agreement of one tokenisation."""
    good = rows.where(F.col(token) >= 0)
    table = evaluation.contingency(good, label, token)
    parts = [
        vectors.silhouettes(rows, token, v).agg(F.avg("s").alias("silhouette")),
        rows.agg(F.avg((F.col(token) < 0).cast("double")).alias("noise"), F.countDistinct(F.when(F.col(token) >= 0, F.col(token))).cast("double").alias("vocabulary")),
        evaluation.agreement(table).drop("n"),
        evaluation.purity(table).select("mean_purity", "pure_share"),
        evaluation.agreement(evaluation.contingency(good, label, token, [group]), [group]).where("n >= 5").agg(F.avg("ari").alias("group_ari"), F.stddev_pop("ari").alias("group_ari_std")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.join(F.broadcast(p), how="cross")  # one row beside one row
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*[F.round(F.col(c).cast("double"), 6) for c in one.columns]))).alias("metric", "value"))


# classifiers


def classify_with(rows: DataFrame, kind: str, label: str = "label", v: str = "v") -> DataFrame:
    """id, label, pred of the held-out fifth, by gbt, svc (both one against the rest), mlp, or cross-validated lr."""
    x = models.stratified(rows, label, "id", 0.2).withColumn("features", array_to_vector(v)).withColumn("label_", F.col(label).cast("double"))
    train, test = x.where(~F.col("test")), x.where("test")
    d, k = len(rows.select(v).first()[0]), int(rows.agg(F.max(label)).first()[0]) + 1
    if kind in ("gbt", "svc"):
        base = GBTClassifier(maxIter=5, maxDepth=3, seed=0) if kind == "gbt" else LinearSVC(maxIter=8, regParam=1e-2)
        fitted = OneVsRest(classifier=base, labelCol="label_").fit(train)
    elif kind == "mlp":
        fitted = MultilayerPerceptronClassifier(layers=[d, 32, k], labelCol="label_", seed=0, maxIter=60).fit(train)
    else:
        lr = LogisticRegression(labelCol="label_", maxIter=30)
        grid = ParamGridBuilder().addGrid(lr.regParam, [1e-3, 1e-1]).build()
        fitted = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="label_", metricName="f1"), numFolds=3, seed=0).fit(train)
    return fitted.transform(test).select("id", label, F.col("prediction").cast("int").alias("pred"))


def leakage(rows: DataFrame, label: str, group: str, held: int, v: str = "v") -> DataFrame:
    """split, accuracy: random rows held out against whole groups held out, same forest."""
    x = rows.withColumn("features", array_to_vector(v)).withColumn("y", F.col(label).cast("double"))
    out = []
    for name, part in (("rows", models.stratified(x, label, "id", 0.2)), ("groups", models.group_split(x, group, held))):
        fitted = RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=6, seed=0).fit(part.where(~F.col("test")))
        acc = fitted.transform(part.where("test")).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
        out.append((name, round(float(acc or 0.0), 6)))
    return rows.sparkSession.createDataFrame(out, "split string, accuracy double")


# sequences


def bleu2(guess: Column, truth: Column) -> Column:
    """Geometric mean of clipped unigram and bigram precision times the brevity penalty, of two arrays."""
    pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    hits = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    share = lambda a, b: F.when(F.size(a) > 0, hits(a, b) / F.size(a)).otherwise(0.0)
    brief = F.when(F.size(guess) >= F.size(truth), 1.0).otherwise(F.exp(1 - F.size(truth) / F.greatest(F.size(guess), F.lit(1))))
    return brief * F.sqrt(share(guess, truth) * share(pairs(guess), pairs(truth)))


def repeat_lengths(seqs: DataFrame, context: str, longest: int, least: int) -> DataFrame:
    """context, mean_length, repeats: maximal repeats within each context."""
    out = None
    for c in [r[0] for r in seqs.select(context).distinct().collect()]:
        one = language.repeats(seqs.where(F.col(context) == c).select("seq_id", "pos", "token"), longest, least).agg(F.round(F.avg("n"), 6).alias("mean_length"), F.count(F.lit(1)).alias("repeats")).select(F.lit(c).alias(context), "mean_length", "repeats")
        out = one if out is None else out.unionByName(one)
    return out


def small_world(edges: list[tuple[str, str]], seed: int = 0, trials: int = 20) -> tuple[float, float]:
    """sigma and omega* of an undirected graph on the driver (a vocabulary's graph): clustering and path length against
    random graphs of as many nodes and edges."""
    def measures(e: set) -> tuple[float, float]:
        near: dict = {}
        for a, b in e:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        c = [sum(y in near[x] for x, y in itertools.combinations(near[v], 2)) / math.comb(len(near[v]), 2) if len(near[v]) > 1 else 0.0 for v in near]
        total = steps = 0
        for v in near:
            seen, front, depth = {v}, [v], 0
            while front:
                depth += 1
                front = list({y for x in front for y in near[x]} - seen)
                seen |= set(front)
                total, steps = total + depth * len(front), steps + len(front)
        return (sum(c) / len(c) if c else 0.0), (total / steps if steps else 0.0)

    e = {tuple(sorted(x)) for x in edges if x[0] != x[1]}
    nodes = sorted({v for x in e for v in x})
    c, path = measures(e)
    rng = np.random.default_rng(seed)
    every = list(itertools.combinations(nodes, 2))
    rand = [measures({every[i] for i in rng.choice(len(every), len(e), replace=False)}) for _ in range(trials)] if every else []
    cr, pr = (float(np.mean([r[i] for r in rand])) if rand else 0.0 for i in (0, 1))
    return (c / cr / (path / pr) if cr and pr and path else float("nan")), (cr / c if c else float("nan"))


def tail_fit(values: DataFrame, x: str, least: float = 1.0) -> DataFrame:
    """n, alpha (power law), rate (exponential), ratio: log likelihood of the power law over the exponential, above least."""
    v = values.where(F.col(x) >= least)
    s = v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.ln(F.col(x) / least)).alias("l"), F.sum(F.col(x) - least).alias("d"))
    n, l, d = F.col("n"), F.col("l"), F.col("d")
    power = n * F.ln(n / l / least) - (n / l + 1) * l
    expo = n * F.ln(n / d) - n
    return s.select("n", F.round(1 + n / l, 6).alias("alpha"), F.round(n / d, 6).alias("rate"), F.round(power - expo, 4).alias("ratio"))


def aligned_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """js in bits between the use of two codebooks (k, centroid, size), b's entries counted as their nearest of a's."""
    near = vectors.nearest(b.select(F.col("size").alias("n"), F.col("centroid").alias("w")), a.select("k", "centroid"), "k", "w", "k")
    q = near.groupBy("k").agg(F.sum("n").alias("n"))
    share = lambda d: d.join(F.broadcast(d.agg(F.sum("n").alias("all"))), how="cross").select("k", (F.col("n") / F.col("all")).alias("p_token"))
    both = share(a.select("k", F.col("size").alias("n"))).withColumn("context", F.lit("a")).unionByName(share(q).withColumn("context", F.lit("b"))).withColumnRenamed("k", "token")
    return language.js_divergence(both)
