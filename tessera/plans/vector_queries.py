"""Queries over embeddings: clusters, neighbours, silhouettes, densities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cosine, distance, doubles, unit
from ..operators import evaluation, models, sequences, vectors
from .registry import query, table

VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), x AS (SELECT id, label, unnest(v) AS val, unnest(range(1, len(v) + 1)) AS i FROM v)"
CEN = VEC + ", cd AS (SELECT label, i, avg(val) AS m FROM x GROUP BY label, i), cen AS (SELECT label, list(m ORDER BY i) AS c FROM cd GROUP BY label)"
NEAR = CEN + ", dd AS (SELECT id, v.label, cen.label AS k, round(list_distance(v, c), 9) AS d FROM v CROSS JOIN cen), nc AS (SELECT id, label, k AS token, d AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM dd) WHERE r = 1)"


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"), "label")


def reduced(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """rows with the vectors on their k leading axes: all dimensions tell, and densities can be fitted."""
    r = rows(spark, d)
    return models.pca(r, k).join(r.select("id", "label"), "id")


@query("centroids", f"WITH {CEN}, s AS (SELECT v.label, count(*) AS size, avg(pow(list_distance(v, c), 2)) AS var FROM v JOIN cen ON cen.label = v.label GROUP BY v.label) SELECT cd.label, CAST(i - 1 AS INTEGER) AS dim, round(m, 6) AS mean, size, round(var, 6) AS variance FROM cd JOIN s ON s.label = cd.label")
def centroids(spark, d):
    return vectors.centroids(rows(spark, d)).select("label", F.posexplode("centroid").alias("dim", "mean"), "size", F.round("variance", 6).alias("variance")).withColumn("mean", F.round("mean", 6))


@query("nearest_centroid", f"WITH {NEAR} SELECT id, label, token, round(dist, 6) AS dist FROM nc")
def nearest_centroid(spark, d):
    r = rows(spark, d)
    return vectors.nearest(r, vectors.centroids(r)).select("id", "label", "token", F.round("dist", 6).alias("dist"))


@query("centroid_distances", f"WITH {CEN} SELECT a.label AS a, b.label AS b, round(list_distance(a.c, b.c), 6) AS dist FROM cen a JOIN cen b ON a.label < b.label")
def centroid_distances(spark, d):
    c = vectors.centroids(rows(spark, d)).select("label", "centroid")
    return c.alias("x").join(c.alias("y"), F.col("x.label") < F.col("y.label")).select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), F.round(distance(F.col("x.centroid"), F.col("y.centroid")), 6).alias("dist"))


KNN = f"WITH {VEC}, p AS (SELECT a.id, b.id AS other, b.label, round(list_distance(a.v, b.v), 9) AS d FROM v a JOIN v b ON a.id <> b.id), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM p) WHERE r <= 5)"


@query("knn", KNN + " SELECT id, other, round(d, 6) AS dist, CAST(r AS INTEGER) AS rank FROM n")
def knn(spark, d):
    r = rows(spark, d)
    return vectors.neighbours(r, r, 5).select("id", "other", F.round("dist", 6).alias("dist"), "rank")


@query("knn_vote", KNN + " SELECT id, label AS vote FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS q FROM n GROUP BY id, label) WHERE q = 1")
def knn_vote(spark, d):
    r = rows(spark, d)
    return vectors.knn_vote(r, r, 5)


SIL = f"WITH {VEC}, p AS (SELECT a.id, a.label, b.label AS k, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM v a, v b GROUP BY a.id, a.label, b.label), q AS (SELECT id, label, max(CASE WHEN k = label THEN n END) AS size, max(CASE WHEN k = label THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN k <> label THEN s / n END) AS b FROM p GROUP BY id, label), si AS (SELECT id, label, CASE WHEN b IS NULL THEN NULL WHEN size < 2 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM q)"


@query("silhouette", SIL + " SELECT round(avg(s), 6) AS silhouette, count(*) AS n FROM si")
def silhouette(spark, d):
    return vectors.silhouettes(rows(spark, d)).agg(F.round(F.avg("s"), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@query("silhouette_per_cluster", SIL + " SELECT label, round(avg(s), 6) AS silhouette, count(*) AS n FROM si GROUP BY label")
def silhouette_per_cluster(spark, d):
    return vectors.silhouettes(rows(spark, d)).groupBy("label").agg(F.round(F.avg("s"), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@query("outlier_quantile_share", f"WITH {NEAR}, q AS (SELECT quantile_cont(dist, 0.95) AS q FROM nc) SELECT label, round(avg(CASE WHEN dist > q THEN 1.0 ELSE 0.0 END), 6) AS share FROM nc, q GROUP BY label")
def outlier_quantile_share(spark, d):
    r = rows(spark, d)
    near = vectors.nearest(r, vectors.centroids(r))
    q = near.agg(F.percentile("dist", F.lit(0.95)).alias("q"))
    return near.join(F.broadcast(q), how="cross").groupBy("label").agg(F.round(F.avg(F.when(F.col("dist") > F.col("q"), 1.0).otherwise(0.0)), 6).alias("share"))


BAYES = f"WITH {VEC}, g AS (SELECT label AS k, i, avg(val) AS m, var_pop(val) + 1e-6 AS s2 FROM x GROUP BY label, i), pr AS (SELECT label AS k, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM v)) AS lp FROM v GROUP BY label), sc AS (SELECT id, label, g.k, max(lp) - sum(pow(val - m, 2) / s2 + ln(s2) + ln(2 * pi())) / 2 AS s FROM x JOIN g ON g.i = x.i JOIN pr ON pr.k = g.k GROUP BY id, label, g.k)"


def _scored(spark, d):
    r = rows(spark, d)
    return vectors.scored(r, vectors.diagonal_gaussians(r))


@query("diag_gaussian_bayes", BAYES + " SELECT id, label, k AS pred, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, k) AS r FROM sc) WHERE r = 1")
def diag_gaussian_bayes(spark, d):
    s = _scored(spark, d).withColumn("pred", vectors.best_of(F.col("scores")))
    return s.select("id", "label", "pred", F.round(F.array_max(F.transform("scores", lambda x: x["lp"])), 4).alias("score"))


@query("loglik_bottom1pct", BAYES + ", o AS (SELECT id, label, s FROM sc WHERE k = label), q AS (SELECT label, quantile_cont(s, 0.01) AS q FROM o GROUP BY label) SELECT id, o.label, round(s, 4) AS own FROM o JOIN q ON q.label = o.label WHERE s <= q")
def loglik_bottom1pct(spark, d):
    own = _scored(spark, d).select("id", "label", F.filter("scores", lambda x: x["k"] == F.col("label"))[0]["lp"].alias("own"))
    q = own.groupBy("label").agg(F.percentile("own", F.lit(0.01)).alias("q"))
    return own.join(F.broadcast(q), "label").where("own <= q").select("id", "label", F.round("own", 4).alias("own"))


@query("worst_margins", BAYES + " SELECT id, label, round(max(CASE WHEN k <> label THEN s END) - max(CASE WHEN k = label THEN s END), 4) AS margin FROM sc GROUP BY id, label ORDER BY margin DESC, id LIMIT 20")
def worst_margins(spark, d):
    s = _scored(spark, d)
    pick = lambda same: F.array_max(F.transform(F.filter("scores", lambda x: (x["k"] == F.col("label")) == F.lit(same)), lambda x: x["lp"]))
    return s.select("id", "label", F.round(pick(False) - pick(True), 4).alias("margin")).orderBy(F.desc("margin"), "id").limit(20)


@query("anomaly_foreign_share", BAYES + ", o AS (SELECT id, label, s FROM sc WHERE k = label), q AS (SELECT label, quantile_cont(s, 0.01) AS q FROM o GROUP BY label), p AS (SELECT id, k AS pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, k) AS r FROM sc) WHERE r = 1) SELECT o.label, count(*) AS anomalies, round(avg(CASE WHEN pred <> o.label THEN 1.0 ELSE 0.0 END), 6) AS foreign_share FROM o JOIN q ON q.label = o.label JOIN p ON p.id = o.id WHERE s <= q GROUP BY o.label")
def anomaly_foreign_share(spark, d):
    low = loglik_bottom1pct(spark, d).select("id", "label")
    pred = diag_gaussian_bayes(spark, d).select("id", "pred")
    return low.join(pred, "id").groupBy("label").agg(F.count(F.lit(1)).alias("anomalies"), F.round(F.avg((F.col("pred") != F.col("label")).cast("double")), 6).alias("foreign_share"))


@query("group_bayes_vote", BAYES + ", gs AS (SELECT id % 50 AS grp, k, sum(s) AS s FROM sc GROUP BY 1, 2) SELECT grp, k AS pred, round(s, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(s, 6) DESC, k) AS r FROM gs) WHERE r = 1")
def group_bayes_vote(spark, d):
    """Sum of log densities over a sequence of vectors (here by id), then the best class: the family's prediction."""
    s = _scored(spark, d).select((F.col("id") % 50).alias("grp"), F.explode("scores").alias("s"))
    g = s.groupBy("grp", F.col("s.k").alias("k")).agg(F.sum("s.lp").alias("s"))
    return g.groupBy("grp").agg(F.min_by("k", F.struct(-F.round("s", 6), F.col("k"))).alias("pred"), F.round(F.max("s"), 3).alias("score"))


@query("cosine_to_centroid", f"WITH {CEN} SELECT id, v.label, round(list_cosine_similarity(v, c), 6) AS cosine FROM v JOIN cen ON cen.label = v.label")
def cosine_to_centroid(spark, d):
    r = rows(spark, d)
    return r.join(F.broadcast(vectors.centroids(r).select("label", "centroid")), "label").select("id", "label", F.round(cosine(F.col("v"), F.col("centroid")), 6).alias("cosine"))


@query("l2_normalise", f"WITH {VEC} SELECT id, round(list_sum(list_transform(v, lambda z: z / sqrt(list_dot_product(v, v)))), 6) AS total FROM v")
def l2_normalise(spark, d):
    return rows(spark, d).select("id", F.round(F.aggregate(unit(F.col("v")), F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("standardise", f"WITH {VEC}, s AS (SELECT i, avg(val) AS m, stddev_pop(val) AS sd FROM x GROUP BY i) SELECT id, round(sum((val - m) / (sd + 1e-6)), 5) AS total FROM x JOIN s ON s.i = x.i GROUP BY id")
def standardise(spark, d):
    return models.standardised(rows(spark, d)).select("id", F.round(F.aggregate("z", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("covariance", f"WITH {VEC} SELECT a.label, CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(covar_samp(a.val, b.val), 6) AS cov FROM x a JOIN x b ON a.id = b.id AND a.i <= b.i WHERE b.i <= 4 GROUP BY a.label, a.i, b.i")
def covariance(spark, d):
    r = rows(spark, d)
    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.sequence(i, F.lit(3)), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("v", i).alias("a"), F.get("v", j).alias("b"))))))
    return r.select("label", pairs.alias("p")).groupBy("label", "p.i", "p.j").agg(F.round(F.covar_samp("p.a", "p.b"), 6).alias("cov"))


@query("residual_vq_fixed", f"WITH {CEN}, rs AS (SELECT id, v.label, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS rest, v FROM v JOIN cen ON cen.label = v.label), fx AS (SELECT id % 4 AS k, unnest(rest) AS val, unnest(range(1, len(rest) + 1)) AS i FROM rs), fd AS (SELECT k, i, avg(val) AS m FROM fx GROUP BY k, i), fine AS (SELECT k, list(m ORDER BY i) AS c FROM fd GROUP BY k), co AS (SELECT id, v, k FROM (SELECT id, v, cen.label AS k, row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, c), 9), cen.label) AS r FROM v CROSS JOIN cen) WHERE r = 1), lf AS (SELECT id, k, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS rest FROM co JOIN cen ON cen.label = co.k) SELECT id, k * 4 + f AS token FROM (SELECT id, lf.k, fine.k AS f, row_number() OVER (PARTITION BY id ORDER BY round(list_distance(rest, c), 9), fine.k) AS r FROM lf CROSS JOIN fine) WHERE r = 1")
def residual_vq_fixed(spark, d):
    r = rows(spark, d)
    coarse = vectors.centroids(r).select(F.col("label").cast("long").alias("k"), "centroid")
    left = r.join(F.broadcast(coarse), F.col("label") == F.col("k")).select("id", F.zip_with("v", "centroid", lambda a, b: a - b).alias("v"), (F.col("id") % 4).alias("g"))
    fine = vectors.centroids(left, "g").select(F.col("g").alias("k"), "centroid")
    return vectors.quantised(r, coarse, fine, 4).select("id", "token")


@query("hdp_merge_components", f"WITH RECURSIVE {CEN}, dd AS (SELECT a.label AS a, b.label AS b, list_distance(a.c, b.c) AS d FROM cen a JOIN cen b ON a.label < b.label), e AS (SELECT a, b FROM dd WHERE d < (SELECT quantile_cont(d, 0.25) FROM dd)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT label, label FROM cen UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n) SELECT n AS label, min(m) AS super FROM r GROUP BY n")
def hdp_merge_components(spark, d):
    c = vectors.centroids(rows(spark, d)).select("label", "centroid")
    return models.merged_components(c, 0.25)


@query("ari_nmi", f"WITH {NEAR}, t AS (SELECT label AS a, token AS b, count(*) AS n FROM nc GROUP BY label, token), s AS (SELECT CAST(sum(n) AS DOUBLE) AS t, sum(n * (n - 1) / 2.0) AS sij FROM t), ra AS (SELECT sum(n) AS n FROM t GROUP BY a), rb AS (SELECT sum(n) AS n FROM t GROUP BY b), h AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ra) AS si, (SELECT sum(n * (n - 1) / 2.0) FROM rb) AS sj, (SELECT -sum(n / t * ln(n / t)) FROM ra, s) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM rb, s) AS hb, (SELECT sum(n / t * ln(n * t / (na * nb))) FROM (SELECT n, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS na, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb FROM t), s) AS mi) SELECT CAST(t AS BIGINT) AS n, round((sij - si * sj / (t * (t - 1) / 2)) / ((si + sj) / 2 - si * sj / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure, round(mi / ln(2.0), 6) AS mi_bits FROM s, h")
def ari_nmi(spark, d):
    return evaluation.agreement(evaluation.contingency(nearest_centroid(spark, d), "label", "token"))


@query("purity", f"WITH {NEAR}, t AS (SELECT token AS b, label AS a, count(*) AS n FROM nc GROUP BY token, label), c AS (SELECT b, sum(n) AS t, max(n) / CAST(sum(n) AS DOUBLE) AS top FROM t GROUP BY b) SELECT round(avg(top), 6) AS mean_purity, round(sum(CASE WHEN top >= 0.5 THEN t ELSE 0 END) / CAST(sum(t) AS DOUBLE), 6) AS pure_share, count(*) AS clusters FROM c")
def purity(spark, d):
    return evaluation.purity(evaluation.contingency(nearest_centroid(spark, d), "label", "token"))


@query("context_entropy_per_token", f"WITH {NEAR}, t AS (SELECT token AS b, label AS a, count(*) AS n, sum(count(*)) OVER (PARTITION BY token) AS t FROM nc GROUP BY token, label) SELECT b, CAST(max(t) AS BIGINT) AS n, round(abs(sum(n / CAST(t AS DOUBLE) * log2(n / CAST(t AS DOUBLE)))), 6) AS entropy FROM t GROUP BY b")
def context_entropy_per_token(spark, d):
    return evaluation.class_entropy(evaluation.contingency(nearest_centroid(spark, d), "label", "token"))


@query("confusion_norm", f"WITH {NEAR} SELECT label AS a, token AS b, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE), 6) AS share FROM nc GROUP BY label, token")
def confusion_norm(spark, d):
    return evaluation.normalised(evaluation.contingency(nearest_centroid(spark, d), "label", "token"))


@query("kfold", "SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings")
def kfold(spark, d):
    return models.folds(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 5)


@query("stratified_split", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id * 48271 % 1000003, vec_id) <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY label) * 0.2) AS INTEGER)) AS test FROM embeddings")
def stratified_split(spark, d):
    return models.stratified(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.2)


@query("group_split", "SELECT event_id, user_id, (SELECT count(*) FROM (SELECT DISTINCT user_id AS u FROM events) q WHERE (q.u * 48271 % 1000003, q.u) <= (e.user_id * 48271 % 1000003, e.user_id)) <= 11 AS test FROM events e")
def group_split(spark, d):
    return models.group_split(table(spark, d, "events").select("event_id", "user_id"), "user_id", 11)


@query("kmeans_vq")
def kmeans_vq(spark, d):
    return models.kmeans(rows(spark, d), 10)


@query("bisecting_kmeans")
def bisecting_kmeans(spark, d):
    return models.bisecting(rows(spark, d), 8)


@query("gmm_family")
def gmm_family(spark, d):
    return models.mixture_family(reduced(spark, d), "label", 3, "em").select("label", "component", F.round("weight", 6).alias("weight"))


@query("dpgmm_family")
def dpgmm_family(spark, d):
    return models.mixture_family(reduced(spark, d), "label", 6, "dp").select("label", "component", F.round("weight", 6).alias("weight"))


@query("family_predict")
def family_predict(spark, d):
    r = reduced(spark, d)
    return models.family_predict(r.withColumn("seq_id", F.col("id") % 50), models.mixture_family(r, "label", 4, "dp"), "label")


@query("per_context_kmeans")
def per_context_kmeans(spark, d):
    return models.per_group_kmeans(rows(spark, d), "label", 5, 30).select("id", "label", "token")


@query("hdbscan_labels")
def hdbscan_labels(spark, d):
    return models.density_clusters(reduced(spark, d), 10, 5)


@query("ward_labels")
def ward_labels(spark, d):
    return models.ward(rows(spark, d), 10)


@query("acoustic_refine")
def acoustic_refine(spark, d):
    return models.refine(rows(spark, d)).history(spark)


@query("pca_project")
def pca_project(spark, d):
    return models.pca(rows(spark, d), 8)


@query("random_projection")
def random_projection(spark, d):
    return models.random_projection(rows(spark, d), 8)


@query("rf_bag")
def rf_bag(spark, d):
    return models.classify(rows(spark, d), "rf")


@query("lr_bag")
def lr_bag(spark, d):
    return models.classify(rows(spark, d), "lr")


@query("dtw_proxy")
def dtw_proxy(spark, d):
    return models.dtw_ward(rows(spark, d), "label", 0.05)


@query("ema_codebook")
def ema_codebook(spark, d):
    r = rows(spark, d)
    return models.ema_codebook(r, vectors.centroids(r).select(F.col("label").alias("k"), "centroid", "size"), 0.9).select("k", F.round("size", 6).alias("size"))
