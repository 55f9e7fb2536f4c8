"""Queries: pooling, small groups, voting, ranges, classifiers, choices among models, stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal
from ..functions.columns import log_sum_exp
from ..operators import harness, language, models, sequences, vectors
from .registry import query, table
from .sequence_queries import CTX, SEQ, events, in_context, split
from .vector_queries import CEN, NEAR, VEC, reduced, rows


@query("pooled_mean_std", f"WITH {VEC}, s AS (SELECT label, i, avg(val) AS m, stddev_pop(val) AS sd FROM x GROUP BY label, i) SELECT label, round(sum(m), 6) AS mean_total, round(sum(sd), 6) AS std_total FROM s GROUP BY label")
def pooled_mean_std(spark, d):
    p = harness.pooled(rows(spark, d), "label")
    half = F.floor(F.size("pooled") / 2).cast("int")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 6)
    return p.select("label", total(F.slice("pooled", F.lit(1), half)).alias("mean_total"), total(F.slice("pooled", half + 1, half)).alias("std_total"))


@query("absorb_small", f"WITH {VEC}, t AS (SELECT id, v, CASE WHEN id % 97 = 0 THEN 100 ELSE label END AS label FROM v), big AS (SELECT label FROM t GROUP BY label HAVING count(*) >= 30), y AS (SELECT label, unnest(v) AS val, unnest(range(1, len(v) + 1)) AS i FROM t WHERE label IN (SELECT label FROM big)), cd AS (SELECT label, i, avg(val) AS m FROM y GROUP BY label, i), cen AS (SELECT label, list(m ORDER BY i) AS c FROM cd GROUP BY label), n AS (SELECT id, cen.label AS token, row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, c), 9), cen.label) AS r FROM t, cen WHERE t.label NOT IN (SELECT label FROM big)) SELECT id, label AS token FROM t WHERE label IN (SELECT label FROM big) UNION ALL SELECT id, token FROM n WHERE r = 1")
def absorb_small(spark, d):
    r = rows(spark, d).withColumn("label", F.when(F.col("id") % 97 == 0, 100).otherwise(F.col("label")).cast("int"))
    return harness.absorbed(r, "label", 30)


@query("prune_by_neighbours")
def prune_by_neighbours(spark, d):
    r = rows(spark, d).withColumn("label", F.when(F.col("id") % 97 == 0, 100).otherwise(F.col("label")).cast("int"))
    return harness.pruned_by_neighbours(r, "label", 30)


@query("permuted_ids", "WITH p AS (SELECT label, row_number() OVER (ORDER BY (label * 48271 + 7919) % 1000003, label) - 1 AS token FROM (SELECT DISTINCT CAST(label AS BIGINT) AS label FROM embeddings)) SELECT vec_id, CAST(p.token AS INTEGER) AS token FROM embeddings e JOIN p ON p.label = e.label")
def permuted_ids(spark, d):
    return harness.permuted_ids(table(spark, d, "embeddings").select("vec_id", "label"), "label", 1).select("vec_id", "token")


@query("sequence_vote", f"WITH {NEAR} SELECT seq_id, token AS pred FROM (SELECT id % 40 AS seq_id, token, row_number() OVER (PARTITION BY id % 40 ORDER BY count(*) DESC, token) AS r FROM nc GROUP BY id % 40, token) WHERE r = 1")
def sequence_vote(spark, d):
    r = rows(spark, d)
    near = vectors.nearest(r, vectors.centroids(r)).select((F.col("id") % 40).alias("seq_id"), F.col("token").alias("pred"))
    return harness.voted(near, "seq_id", "pred")


@query("log_sum_exp", "WITH g AS (SELECT user_id, list(value / 10) AS x FROM events GROUP BY user_id) SELECT user_id, round(list_max(x) + ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))), 6) AS lse FROM g")
def log_sum_exp_query(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.col("value") / 10).alias("x"))
    return g.select("user_id", F.round(log_sum_exp(F.col("x")), 6).alias("lse"))


@query("product_aggregate", "SELECT user_id, round(exp(sum(ln(value / 50))), 6 ) AS product, round(exp(-avg(ln(value / 50))), 6) AS inverse_geometric_mean FROM events WHERE value > 25 AND value < 100 GROUP BY user_id")
def product_aggregate(spark, d):
    x = table(spark, d, "events").where("value > 25 and value < 100").groupBy("user_id")
    return x.agg(F.round(F.exp(F.sum(F.ln(F.col("value") / 50))), 6).alias("product"), F.round(F.exp(-F.avg(F.ln(F.col("value") / 50))), 6).alias("inverse_geometric_mean"))


@query("frames_in_range", "WITH s AS (SELECT user_id, min(ts) AS a FROM events GROUP BY user_id) SELECT e.user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events e JOIN s ON s.user_id = e.user_id AND e.ts >= s.a AND e.ts < s.a + INTERVAL 10 DAY GROUP BY e.user_id")
def frames_in_range(spark, d):
    e = table(spark, d, "events")
    spans = e.groupBy("user_id").agg(F.min("ts").alias("a")).withColumn("b", F.col("a") + F.expr("interval 10 days"))
    got = signal.frames_within(e, spans, F.col("ts"), F.col("a"), F.col("b"), "user_id")
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("frame_sequences", f"WITH {SEQ} SELECT seq_id // 10 AS grp, string_agg(token, ' ' ORDER BY seq_id, pos) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY seq_id // 10 ORDER BY seq_id, pos) AS r FROM seq) WHERE r <= 96 GROUP BY 1")
def frame_sequences(spark, d):
    """Frames of a group's segments one after the other, the first 96."""
    lists = sequences.assembled(events(spark, d), 1).withColumn("grp", F.floor(F.col("seq_id") / 10).cast("long"))
    g = lists.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("seq_id", "seq"))).alias("x"))
    return g.select("grp", F.array_join(F.slice(F.flatten(F.transform("x", lambda s: s["seq"])), 1, 96), " ").alias("seq"))


@query("tail_fit", "WITH v AS (SELECT count(*) AS x FROM orders GROUP BY o_custkey), w AS (SELECT * FROM v WHERE x >= 2), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(ln(x / 2.0)) AS l, CAST(sum(x - 2) AS DOUBLE) AS d FROM w) SELECT CAST(n AS BIGINT) AS n, round(1 + n / l, 6) AS alpha, round(n / d, 6) AS rate, round(n * ln(n / l / 2.0) - (n / l + 1) * l - (n * ln(n / d) - n), 4) AS ratio FROM s")
def tail_fit(spark, d):
    return harness.tail_fit(table(spark, d, "orders").groupBy("o_custkey").count().withColumnRenamed("count", "x"), "x", 2.0)


@query("repeat_lengths")
def repeat_lengths(spark, d):
    return harness.repeat_lengths(in_context(spark, d), "context", 4, 5)


@query("completion_bleu2")
def completion_bleu2(spark, d):
    seqs = events(spark, d)
    guess = language.completed(split(seqs, False).where("pos = 4").select("seq_id", "token"), language.bigram_model(split(seqs, True)), 3)
    truth = sequences.assembled(seqs.where("pos between 5 and 7"), 3).select("seq_id", F.col("seq").alias("truth"))
    return guess.join(truth, "seq_id").select("seq_id", F.round(harness.bleu2(F.col("guess"), F.col("truth")), 6).alias("bleu2"))


@query("small_world")
def small_world(spark, d):
    e = sequences.ngram_counts(events(spark, d), 2).where("n >= 2").select("t1", "t2").collect()  # a vocabulary's edges
    sigma, omega = harness.small_world([tuple(r) for r in e])
    return spark.createDataFrame([(sigma, omega)], "sigma double, omega_star double")


@query("aligned_divergence")
def aligned_divergence(spark, d):
    r = rows(spark, d)
    book = lambda x: vectors.centroids(x).select(F.col("label").alias("k"), "centroid", "size")
    return harness.aligned_divergence(book(r.where("id % 2 = 0")), book(r.where("id % 2 = 1")))


@query("split_in_two")
def split_in_two(spark, d):
    return harness.split_in_two(rows(spark, d), "label", 0)


@query("adaptive_vq")
def adaptive_vq(spark, d):
    return harness.adaptive_codebook(rows(spark, d), 16).select("k", "size")


@query("model_choice")
def model_choice(spark, d):
    return harness.model_choice(rows(spark, d), (4, 10))


@query("seed_stability")
def seed_stability(spark, d):
    r = rows(spark, d)
    return harness.stability(lambda s: models.kmeans(r, 10, s), (0, 1, 2))


@query("full_evaluation")
def full_evaluation(spark, d):
    r = rows(spark, d)
    near = vectors.nearest(r, vectors.centroids(r)).withColumn("grp", F.col("id") % 7)
    return harness.full_evaluation(near, "token", "label", "grp")


@query("noise_fraction", f"WITH {CEN} SELECT round(avg(CASE WHEN list_distance(v, c) > 1 THEN 1.0 ELSE 0.0 END), 6) AS noise FROM v JOIN cen ON cen.label = v.label")
def noise_fraction(spark, d):
    r = rows(spark, d)
    c = vectors.centroids(r).select("label", "centroid")
    from ..functions.columns import distance

    return r.join(F.broadcast(c), "label").agg(F.round(F.avg((distance(F.col("v"), F.col("centroid")) > 1).cast("double")), 6).alias("noise"))


@query("density_grid")
def density_grid(spark, d):
    """Clusters found for each setting of a small grid."""
    r = reduced(spark, d, 6)
    out = None
    for least, core in ((5, 3), (10, 5), (20, 5)):
        got = models.density_clusters(r, least, core)
        one = got.agg(F.countDistinct(F.when(F.col("token") >= 0, F.col("token"))).alias("clusters"), F.round(F.avg((F.col("token") < 0).cast("double")), 6).alias("noise")).select(F.lit(least).alias("least"), F.lit(core).alias("core"), "clusters", "noise")
        out = one if out is None else out.unionByName(one)
    return out


@query("component_cover")
def component_cover(spark, d):
    return models.covering(models.mixture_family(reduced(spark, d), "label", 6, "dp"), "label")


@query("split_leakage")
def split_leakage(spark, d):
    return harness.leakage(rows(spark, d).withColumn("grp", F.col("id") % 20), "label", "grp", 4)


for _kind in ("gbt", "svc", "mlp", "cv"):
    query(f"classify_{_kind}")(lambda spark, d, kind=_kind: harness.classify_with(rows(spark, d), kind))


@query("context_weighted_length", f"WITH {CTX} SELECT context, count(*) AS n, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median FROM cs GROUP BY context")
def context_weighted_length(spark, d):
    return in_context(spark, d).groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))
