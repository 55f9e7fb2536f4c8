"""Queries of tokenizers, of the families their labels make, and of what is told from sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, tokenizers, vectors
from .registry import query
from .sequence_queries import TYPES, in_context
from .vector_queries import CEN, VEC, reduced, rows


def _moments(covariance):
    off = "0.0" if covariance == "diagonal" else "sum(CASE WHEN a.i <> b.i THEN 2 * c ELSE 0 END)"
    return f"""WITH {VEC}, t AS (SELECT id, label, CAST(id % 4 AS INTEGER) AS token, val, i FROM x), n AS (SELECT label, token, count(DISTINCT id) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 5),
c AS (SELECT a.label, a.token, a.i AS ai, b.i AS bi, covar_samp(a.val, b.val) AS c FROM t a JOIN t b ON a.id = b.id AND a.i <= b.i GROUP BY ALL),
s AS (SELECT label, token, sum(CASE WHEN ai = bi THEN c + 0.001 END) AS trace, {off.replace('a.i', 'ai').replace('b.i', 'bi')} AS rest FROM c GROUP BY 1, 2)
SELECT n.label, n.token AS component, round(n / sum(n) OVER (PARTITION BY n.label), 6) AS weight, round(trace, 4) AS trace, round(rest, 3) AS rest FROM n JOIN s ON s.label = n.label AND s.token = n.token"""


def _family(spark, d, covariance):
    r = rows(spark, d).withColumn("token", (F.col("id") % 4).cast("int"))
    f = tokenizers.moments_family(r, "label", "token", covariance)
    size = F.size("mean")
    trace = F.aggregate(F.filter("cov", lambda c, i: i % (size + 1) == 0), F.lit(0.0), lambda a, x: a + x)
    return f.select("label", "component", F.round("weight", 6).alias("weight"), F.round(trace, 4).alias("trace"), F.round(F.aggregate("cov", F.lit(0.0), lambda a, x: a + x) - trace, 3).alias("rest"))


@query("moments_family", _moments("full"))
def moments_family(spark, d):
    return _family(spark, d, "full")


@query("moments_family_diagonal", _moments("diagonal"))
def moments_family_diagonal(spark, d):
    return _family(spark, d, "diagonal")


@query("kmeans_family")
def kmeans_family(spark, d):
    return tokenizers.family(rows(spark, d), "label", "kmeans", 4).select("label", "component", F.round("weight", 6).alias("weight"))


@query("density_family")
def density_family(spark, d):
    return tokenizers.family(reduced(spark, d), "label", "density").select("label", "component", F.round("weight", 6).alias("weight"))


@query("gate_agreement")
def gate_agreement(spark, d):
    r = rows(spark, d).withColumn("seq_id", F.col("label").cast("long") * 10 + F.col("id") % 10)
    return tokenizers.gate_agreement(tokenizers.gated(r, tokenizers.family(r, "label", "kmeans", 4, "diagonal"), "label"))


@query("per_context_kmeans_shared")
def per_context_kmeans_shared(spark, d):
    return models.per_group_kmeans(rows(spark, d), "label", 5, 30, disjoint=False).select("id", "label", "token")


@query("hp1_evaluate")
def hp1_evaluate(spark, d):
    return tokenizers.hp1_evaluate(in_context(spark, d), TYPES)


@query("classify_context")
def classify_context(spark, d):
    x = tokenizers.sequence_vectors(in_context(spark, d), TYPES)
    label = F.coalesce(*[F.when(F.col("context") == t, i) for i, t in enumerate(TYPES)])
    return tokenizers.classify_context(x.select("id", label.alias("label"), F.concat("bag", "order").alias("v")), "label", k=3)


_TOKENS = CEN.replace("label FROM embeddings", "CAST(vec_id % 12 AS INTEGER) AS label FROM embeddings")


@query("closest_types", f"WITH {_TOKENS}, p AS (SELECT a.label AS a, b.label AS b, round(list_distance(a.c, b.c), 9) AS d FROM cen a JOIN cen b ON a.label < b.label) SELECT a, b, round(d, 6) AS d FROM p ORDER BY p.d, a, b LIMIT 1")
def closest_types(spark, d):
    """The first pair that a merge of near types takes."""
    r = rows(spark, d).withColumn("token", (F.col("id") % 12).cast("int"))
    c = vectors.centroids(r, "token")
    a, b = tokenizers.closest_pairs(c, 1e9)[0]
    both = c.where(F.col("token") == a).select(F.col("token").alias("a"), F.col("centroid").alias("x")).crossJoin(c.where(F.col("token") == b).select(F.col("token").alias("b"), F.col("centroid").alias("y")))  # one row
    return both.select("a", "b", F.round(models.vectors.distance(F.col("x"), F.col("y")), 6).alias("d"))


@query("adaptive_history")
def adaptive_history(spark, d):
    r = rows(spark, d).select("id", "v", (F.col("id") % 40).alias("seq_id"), F.floor(F.col("id") / 40).alias("pos"), F.col("label").alias("token"))
    return tokenizers.adapted(r, outers=2, merges=2).history(spark)
