"""Queries of the small relational operators, and of sequences and vectors where these are used."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import affine, id_hash
from ..operators import evaluation, harness, language, sequences, tabular, vectors
from . import event_queries, harness_queries  # noqa: F401  their oracles are built on
from .registry import ORACLES, query, table
from .sequence_queries import CTX, SEQ, TYPES, events, in_context
from .vector_queries import CEN, NEAR, VEC, rows

_HASH = "((CAST({k} AS BIGINT) * 7919 + CAST({p} AS BIGINT) * 104729 + {s}) * 48271) % 1000003"


@query("first_rows", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 100")
def first_rows(spark, d):
    return tabular.first_rows(table(spark, d, "events"), 100, "ts", "event_id").select("event_id", "user_id")


@query("random_rows", f"SELECT event_id FROM events ORDER BY {_HASH.format(k='event_id', p='0', s=5 * 15485863)}, event_id LIMIT 200")
def random_rows(spark, d):
    return tabular.random_rows(table(spark, d, "events"), 200, "event_id", 5).select("event_id")


_WITH = lambda t: f"SELECT user_id FROM events WHERE event_type = '{t}' AND value > 80"


def _users(spark, d, kind):
    return table(spark, d, "events").where((F.col("event_type") == kind) & (F.col("value") > 80)).select("user_id")


@query("key_intersection", f"{_WITH('click')} INTERSECT {_WITH('error')}")
def key_intersection(spark, d):
    return _users(spark, d, "click").intersect(_users(spark, d, "error"))


@query("key_difference", f"{_WITH('click')} EXCEPT {_WITH('error')}")
def key_difference(spark, d):
    return _users(spark, d, "click").exceptAll(_users(spark, d, "error")).distinct().join(_users(spark, d, "error"), "user_id", "left_anti")


@query("vocabulary_union", "SELECT DISTINCT token FROM (SELECT event_type AS token FROM events UNION ALL SELECT l_returnflag || l_linestatus FROM lineitem)")
def vocabulary_union(spark, d):
    lists = [table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s")), table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("s"))]
    return lists[0].select(F.explode("s").alias("token")).unionByName(lists[1].select(F.explode("s").alias("token"))).distinct()


@query("best_rows", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def best_rows(spark, d):
    return tabular.best_rows(table(spark, d, "events"), "event_type", "value", "event_id").select("event_type", "event_id", "value")


_BROKEN = "CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 13 = 0 THEN NULL ELSE value END"


@query("repaired_values", f"SELECT event_type, count(*) AS n, round(sum(CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0 ELSE x END), 4) AS total FROM (SELECT event_type, {_BROKEN} AS x FROM events) GROUP BY event_type")
def repaired_values(spark, d):
    n = lambda k: F.col("event_id") % k == 0
    x = F.when(n(7), float("nan")).when(n(11), float("inf")).when(n(13), None).otherwise(F.col("value"))
    e = table(spark, d, "events").select("event_type", tabular.repaired(x).alias("x"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"))


_CELLS = ", ".join(f"coalesce(avg(value) FILTER (WHERE event_type = '{t}'), 0) AS {t}" for t in TYPES)
_LIST = "[" + ", ".join(TYPES) + "]"


@query("pivot_statistics", f"WITH w AS (SELECT user_id, {_CELLS} FROM events GROUP BY user_id) SELECT user_id, " + ", ".join(f"round({t}, 6) AS {t}" for t in TYPES) + f", round(list_avg({_LIST}), 6) AS row_mean, round(list_stddev_pop({_LIST}), 6) AS row_std FROM w")
def pivot_statistics(spark, d):
    return tabular.pivot_statistics(table(spark, d, "events"), "user_id", "event_type", TYPES, "value")


_FACTOR = "CASE WHEN event_id % 997 = 0 THEN 0 ELSE (value - 50) / 25 END"


@query("signed_product", f"""WITH f AS (SELECT user_id, {_FACTOR} AS x FROM events), g AS (SELECT user_id, count(*) FILTER (WHERE x < 0) AS m, count(*) FILTER (WHERE x = 0) AS zeros, sum(log10(abs(x))) FILTER (WHERE x <> 0) AS s FROM f GROUP BY user_id)
SELECT user_id, CASE WHEN zeros > 0 THEN 0 WHEN m % 2 = 1 THEN -1 ELSE 1 END AS sign, CASE WHEN zeros = 0 THEN round(coalesce(s, 0), 6) END AS log10_magnitude, zeros FROM g""")
def signed_product(spark, d):
    x = F.when(F.col("event_id") % 997 == 0, 0.0).otherwise((F.col("value") - 50) / 25)
    return tabular.signed_product(table(spark, d, "events").select("user_id", x.alias("x")), "user_id", "x")


@query("weighted_centroids", f"WITH {VEC} SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(sum((1 + id % 3) * val) / sum(1 + id % 3), 6) AS mean FROM x GROUP BY label, i")
def weighted_centroids(spark, d):
    r = rows(spark, d).withColumn("w", 1 + F.col("id") % 3)
    return tabular.weighted_centroids(r, "label", "w").withColumn("mean", F.round("mean", 6))


@query("covariance_full", f"WITH {VEC} SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(covar_samp(a.val, b.val), 5) AS cov FROM x a JOIN x b ON a.id = b.id AND a.i <= b.i GROUP BY a.i, b.i")
def covariance_full(spark, d):
    return tabular.co_moments(rows(spark, d), []).select("i", "j", F.round("cov", 5).alias("cov"))


_VOC = "WITH e AS (SELECT CAST(user_id % 21 AS BIGINT) - 10 AS em, CAST(floor(value) AS INTEGER) % 9 - 1 AS tok, event_type AS ctx, ts, event_id FROM events)"


@query("build_vocs", _VOC + " SELECT abs(em) AS seq_id, row_number() OVER (PARTITION BY abs(em) ORDER BY ts, event_id) - 1 AS pos, tok AS token, ctx AS context FROM e WHERE tok >= 0 AND em <> 0 AND ctx IN ('click', 'view', 'purchase')")
def build_vocs(spark, d):
    e = table(spark, d, "events").select(((F.col("user_id") % 21).cast("long") - 10).alias("em"), (F.floor("value").cast("int") % 9 - 1).alias("tok"), F.col("event_type").alias("ctx"), "ts", "event_id")
    return tabular.coded_vocabulary(e, "em", "tok", "ctx", ["click", "view", "purchase"], ["ts", "event_id"])


_REAL = ORACLES["dependency_by_context"]
_MIXED = _REAL.replace(SEQ, SEQ.replace("seq AS (", "s0 AS (") + f", seq AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY {_HASH.format(k='seq_id', p='pos', s=15485863 * 3)}, pos) - 1 AS pos, token, value FROM s0)")


@query("dependency_gain", f"SELECT r.context, r.dependency AS ordered, s.dependency AS shuffled, round(r.dependency - s.dependency, 6) AS gain FROM ({_REAL}) r JOIN ({_MIXED}) s ON s.context = r.context")
def dependency_gain(spark, d):
    rows_ = in_context(spark, d)
    real, mixed = language.dependency(rows_, ["context"]), language.dependency(sequences.shuffled(rows_, 3), ["context"])
    both = real.select("context", F.col("dependency").alias("ordered")).join(mixed.select("context", F.col("dependency").alias("shuffled")), "context")
    return both.withColumn("gain", F.round(F.col("ordered") - F.col("shuffled"), 6))


@query("agreement_spread", f"SELECT count(*) AS groups, round(avg(ari), 5) AS mean, round(stddev_samp(ari), 5) AS std FROM ({ORACLES['ari_per_group']})")
def agreement_spread(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    per = evaluation.agreement(evaluation.contingency(joined, "quality", "toxic", ["source"]), ["source"]).where("n >= 5")
    return per.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg("ari"), 5).alias("mean"), F.round(F.stddev_samp("ari"), 5).alias("std"))


@query("two_sided_range", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) - 2 * stddev_samp(value), 6) AS low, round(avg(value) + 2 * stddev_samp(value), 6) AS high FROM events GROUP BY event_type")
def two_sided_range(spark, d):
    return tabular.two_sided(table(spark, d, "events"), "value", ["event_type"])


@query("verdict_table", "WITH s AS (SELECT event_type, avg(value) / 100 AS m, stddev_samp(value) / 100 AS sd FROM events GROUP BY event_type) SELECT event_type, printf('%.3f ± %.3f', m, sd) AS cell, CASE WHEN m >= 0.55 THEN 'pass' WHEN m >= 0.5 THEN 'partial' ELSE 'fail' END AS verdict, m = (SELECT max(m) FROM s) AS best FROM s")
def verdict_table(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg((F.avg("value") / 100).alias("m"), (F.stddev_samp("value") / 100).alias("sd"))
    return tabular.verdicts(s, "event_type", "m", "sd", 0.55, 0.5)


_U, _W = _HASH.format(k="event_id", p="0", s=15485863 * 4), _HASH.format(k="event_id", p="0", s=15485863 * 5)


@query("hash_noise", f"SELECT event_id, round(value + 0.5 * sqrt(-2 * ln(({_U} + 1) / 1000004.0::DOUBLE)) * cos(2 * pi() * ({_W}) / 1000003.0::DOUBLE), 6) AS noisy FROM events")
def hash_noise(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.col("value") + tabular.hash_noise(F.col("event_id"), F.lit(0), 0.5, 4), 6).alias("noisy"))


def _leak_sql(token):
    return f"WITH c AS (SELECT {token} AS token, label, count(*) AS c FROM embeddings GROUP BY 1, 2), p AS (SELECT token, max(c) AS best, sum(c) AS a, count(*) AS labels FROM c GROUP BY token) SELECT CAST(sum(a) AS BIGINT) AS n, count(*) AS tokens, CAST(sum(CASE WHEN labels > 1 THEN 1 ELSE 0 END) AS BIGINT) AS shared, round(sum(best) / sum(a), 6) AS accuracy FROM p"


@query("id_range_leak", _leak_sql("label * 100 + vec_id % 7"))
def id_range_leak(spark, d):
    """Ids of groups apart tell the group."""
    e = table(spark, d, "embeddings").select("label", (F.col("label") * 100 + F.col("vec_id") % 7).alias("token"))
    return tabular.range_leak(e, "token", "label")


@query("id_range_shared", _leak_sql("vec_id % 7"))
def id_range_shared(spark, d):
    """Ids from one range for all groups do not."""
    return tabular.range_leak(table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("token")), "token", "label")


_HELD = _HASH.format(k="event_id", p="0", s=15485863 * 9) + " % 5 = 0"


@query("within_each_user", f"WITH g AS (SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events WHERE NOT ({_HELD}) GROUP BY 1, 2) WHERE r = 1), n AS (SELECT user_id, count(*) AS n_train FROM events WHERE NOT ({_HELD}) GROUP BY 1) SELECT e.user_id, max(n_train) AS n_train, count(*) AS n_test, round(avg(CASE WHEN e.event_type = g.event_type THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events e JOIN g ON g.user_id = e.user_id JOIN n ON n.user_id = e.user_id WHERE {_HELD} GROUP BY e.user_id")
def within_each_user(spark, d):
    return tabular.within_each(table(spark, d, "events"), "user_id", "event_id", "event_type", id_hash(F.col("event_id"), F.lit(0), 9) % 5 == 0)


@query("json_fields", "SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_text, CAST(2 AS INTEGER) AS n_tags, event_type || '!' AS second_tag FROM events")
def json_fields(spark, d):
    doc = F.to_json(F.struct("event_type", "user_id", F.array("event_type", F.concat("event_type", F.lit("!"))).alias("tags")))
    e = table(spark, d, "events").select("event_id", doc.alias("doc"))
    tags = F.from_json(F.get_json_object("doc", "$.tags"), "array<string>")
    return e.select("event_id", F.get_json_object("doc", "$.event_type").alias("event_type"), F.get_json_object("doc", "$.user_id").alias("user_text"), F.size(tags).alias("n_tags"), tags[1].alias("second_tag"))


@query("fbank_affine", f"WITH {VEC} SELECT id, round(sum((val - 15.41663) / (2 * 6.55582)), 6) AS total FROM x GROUP BY id")
def fbank_affine(spark, d):
    return rows(spark, d).select("id", F.round(F.aggregate(affine(F.col("v"), 15.41663, 2 * 6.55582), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_NOISE = CEN.replace("label FROM embeddings", "CASE WHEN vec_id % 13 = 0 THEN -1 ELSE label END AS label FROM embeddings")


@query("noise_to_nearest", f"WITH {_NOISE}, dd AS (SELECT id, cen.label AS token, round(list_distance(v, c), 9) AS d FROM v JOIN cen ON v.label = -1 AND cen.label <> -1) SELECT id, token FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, token) AS r FROM dd) WHERE r = 1 UNION ALL SELECT id, label FROM v WHERE label <> -1")
def noise_to_nearest(spark, d):
    r = rows(spark, d).withColumn("label", F.when(F.col("id") % 13 == 0, -1).otherwise(F.col("label")))
    known = r.where("label <> -1")
    near = vectors.nearest(r.where("label = -1"), vectors.centroids(known)).select("id", "token")
    return known.select("id", F.col("label").alias("token")).unionByName(near)


@query("oracle_components", NEAR.join(["WITH ", ", s AS (SELECT id, CAST(k % 3 AS BIGINT) AS g, CAST(k // 3 AS BIGINT) AS component, -d AS lp FROM dd) SELECT id, g * 10 + component AS token FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(lp, 9) DESC, g, component) AS r FROM s) WHERE r = 1"]))
def oracle_components(spark, d):
    r = rows(spark, d)
    pairs = r.select("id", "v").crossJoin(F.broadcast(vectors.centroids(r).select("label", "centroid")))  # a row for each label
    dist = F.round(F.sqrt(F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)), 9)
    scores = pairs.select("id", (F.col("label") % 3).cast("long").alias("g"), F.floor(F.col("label") / 3).cast("long").alias("component"), (-dist).alias("lp"))
    return harness.component_ids(scores, "g", "component", "lp", 10)


@query("sequence_repeats", ORACLES["maximal_repeats"].replace("l_returnflag || l_linestatus AS token", "l_orderkey || ':' || l_returnflag || l_linestatus AS token").replace(">= 5", ">= 2"))
def sequence_repeats(spark, d):
    """Repeats within one sequence: its tokens carry its name, so that no other sequence counts."""
    named = table(spark, d, "lineitem").withColumn("token", F.concat("l_orderkey", F.lit(":"), "l_returnflag", "l_linestatus"))
    return language.repeats(sequences.from_rows(named, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "token"), 4, 2)


@query("profile_joined_back", f"WITH {CTX}, p AS (SELECT seq_id, count(*) AS n, count(DISTINCT token) AS n_unique FROM seq GROUP BY seq_id) SELECT p.seq_id, m.context, n, n_unique, round(1 - n_unique / CAST(n AS DOUBLE), 6) AS repetition FROM p JOIN m ON m.seq_id = p.seq_id")
def profile_joined_back(spark, d):
    from ..operators import features

    seqs = in_context(spark, d)
    return features.diversity(events(spark, d)).select("seq_id", "n", "n_unique", "repetition").join(seqs.select("seq_id", "context").distinct(), "seq_id")


