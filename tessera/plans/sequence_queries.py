"""Queries over the token sequences of events (a user's event types in time) and of orders (return flags by line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import id_hash
from ..operators import features, language, sequences
from .registry import query, table

TYPES = ["click", "error", "purchase", "signup", "view"]

#: The sequences in SQL, for the oracles.
SEQ = "seq AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token, value FROM events)"
CTX = SEQ + """, m AS (SELECT seq_id, token AS context FROM (SELECT seq_id, token, row_number() OVER (PARTITION BY seq_id ORDER BY count(*) DESC, token) AS r FROM seq GROUP BY seq_id, token) WHERE r = 1),
cs AS (SELECT seq.*, m.context FROM seq JOIN m ON m.seq_id = seq.seq_id)"""
BI = "bi AS (SELECT * FROM (SELECT seq_id, pos, token AS t1, lead(token) OVER (PARTITION BY seq_id ORDER BY pos) AS t2 FROM seq) WHERE t2 IS NOT NULL)"
TRI = "tri AS (SELECT * FROM (SELECT seq_id, pos, token AS t1, lead(token) OVER (PARTITION BY seq_id ORDER BY pos) AS t2, lead(token, 2) OVER (PARTITION BY seq_id ORDER BY pos) AS t3 FROM seq) WHERE t3 IS NOT NULL)"
HASH = "((CAST(seq_id AS BIGINT) * 7919 + CAST(pos AS BIGINT) * 104729 + {s}) * 48271) % 1000003"


def events(spark: SparkSession, d: str) -> DataFrame:
    return sequences.from_rows(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ("value",))


def in_context(spark: SparkSession, d: str) -> DataFrame:
    """With context: the mode of the sequence's tokens."""
    seqs = events(spark, d)
    return seqs.join(sequences.mode(seqs, ["seq_id"], "token", "context"), "seq_id")


def split(rows: DataFrame, train: bool) -> DataFrame:
    held = id_hash(F.col("seq_id"), F.lit(0), 1) % 5 == 0
    return rows.where(~held if train else held)


HELD = HASH.format(s=15485863).replace("CAST(pos AS BIGINT) * 104729", "0") + " % 5 = 0"


@query("build_sequences", f"WITH {CTX} SELECT seq_id, string_agg(token, ' ' ORDER BY pos) AS seq, CAST(count(*) AS INTEGER) AS seq_len, any_value(context) AS context FROM cs WHERE context IN (SELECT context FROM m GROUP BY context HAVING count(*) >= 20) GROUP BY seq_id HAVING count(*) >= 2")
def build_sequences(spark, d):
    rows = in_context(spark, d)
    lists = sequences.assembled(rows, 2).join(rows.select("seq_id", "context").distinct(), "seq_id")
    return sequences.in_frequent_groups(lists, "context", 20).select("seq_id", F.array_join("seq", " ").alias("seq"), "seq_len", "context")


@query("first_seen_mode", f"WITH {SEQ} SELECT seq_id, token AS mode FROM (SELECT seq_id, token, row_number() OVER (PARTITION BY seq_id ORDER BY count(*) DESC, min(pos)) AS r FROM seq GROUP BY seq_id, token) WHERE r = 1")
def first_seen_mode(spark, d):
    return sequences.first_mode(events(spark, d), ["seq_id"], "token", "pos", "mode")


@query("topk_groups_semi", "WITH k AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 20) SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM k)")
def topk_groups_semi(spark, d):
    return sequences.in_largest_groups(table(spark, d, "events"), "user_id", 20).select("event_id", "user_id", "event_type")


@query("bigram_counts", f"WITH {SEQ}, {BI} SELECT t1, t2, count(*) AS n FROM bi GROUP BY t1, t2")
def bigram_counts(spark, d):
    return sequences.ngram_counts(events(spark, d), 2)


@query("trigram_counts", f"WITH {SEQ}, {TRI} SELECT t1, t2, t3, count(*) AS n FROM tri GROUP BY t1, t2, t3")
def trigram_counts(spark, d):
    return sequences.ngram_counts(events(spark, d), 3)


@query("transition_matrix", f"WITH {SEQ}, {BI}, c AS (SELECT t1, t2, count(*) AS n FROM bi GROUP BY t1, t2) SELECT t1, t2, n, round(n / CAST(sum(n) OVER (PARTITION BY t1) AS DOUBLE), 6) AS p FROM c")
def transition_matrix(spark, d):
    return features.transitions(events(spark, d)).withColumn("p", F.round("p", 6))


@query("transition_pivot", f"WITH {SEQ}, {BI} SELECT t1, " + ", ".join(f"CAST(sum(CASE WHEN t2 = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {t}" for t in TYPES) + " FROM bi GROUP BY t1")
def transition_pivot(spark, d):
    return sequences.ngrams(events(spark, d), 2).groupBy("t1").pivot("t2", TYPES).count().fillna(0)


PMI = f"""{SEQ}, {BI}, c AS (SELECT t1, t2, count(*) AS n FROM bi GROUP BY t1, t2), u AS (SELECT token, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM seq) AS p FROM seq GROUP BY token),
pmi AS (SELECT c.t1, c.t2, n, round(log2(n / CAST((SELECT count(*) FROM bi) AS DOUBLE) / (a.p * b.p)), 6) AS pmi FROM c JOIN u a ON a.token = t1 JOIN u b ON b.token = t2)"""


@query("entry_bigrams", f"WITH {PMI} SELECT t1 AS token, t2 AS next_token, n, round(n / CAST(sum(n) OVER (PARTITION BY t1) AS DOUBLE), 6) AS p_next, pmi FROM pmi")
def entry_bigrams(spark, d):
    """token, next_token, n, p_next, pmi: the flagship."""
    seqs = events(spark, d)
    p = features.transitions(seqs).select("t1", "t2", F.round("p", 6).alias("p_next"))
    return language.pmi(seqs).join(p, ["t1", "t2"]).select(F.col("t1").alias("token"), F.col("t2").alias("next_token"), "n", "p_next", "pmi")


@query("pmi_table", f"WITH {PMI} SELECT * FROM pmi")
def pmi_table(spark, d):
    return language.pmi(events(spark, d))


@query(
    "seq_features_18",
    f"""WITH {SEQ}, {BI}, {TRI}, v AS (SELECT count(DISTINCT token) AS v FROM seq),
ty AS (SELECT seq_id, token, count(*) AS c, sum(count(*)) OVER (PARTITION BY seq_id) AS n FROM seq GROUP BY seq_id, token),
uni AS (SELECT seq_id, CAST(max(n) AS BIGINT) AS a_length, count(*) AS b_richness, round(sum(-(c / CAST(n AS DOUBLE)) * log2(c / CAST(n AS DOUBLE))), 6) AS d_entropy, round(max(c / CAST(n AS DOUBLE)), 6) AS m_max_freq, round(min(c / CAST(n AS DOUBLE)), 6) AS n_min_freq, round(stddev_pop(c / CAST(n AS DOUBLE)), 6) AS o_std_freq, round(avg(c / CAST(n AS DOUBLE)), 6) AS p_mean_freq FROM ty GROUP BY seq_id),
pr AS (SELECT seq_id, t1, t2, count(*) AS c, count(*) / CAST(sum(count(*)) OVER (PARTITION BY seq_id, t1) AS DOUBLE) AS p FROM bi GROUP BY seq_id, t1, t2),
b AS (SELECT seq_id, sum(c) AS al, count(*) AS f, round(avg(p), 6) AS g, round(stddev_pop(p), 6) AS h, round(max(p), 6) AS i, round(min(p), 6) AS j, sum(CASE WHEN t1 = t2 THEN c ELSE 0 END) AS se FROM pr GROUP BY seq_id),
t AS (SELECT seq_id, count(*) AS l FROM (SELECT DISTINCT seq_id, t1, t2, t3 FROM tri) GROUP BY seq_id)
SELECT uni.seq_id, a_length, b_richness, round(b_richness / CAST(v AS DOUBLE), 6) AS c_versatility, d_entropy, round(coalesce(f / CAST(al AS DOUBLE), 0), 6) AS e_transition_rate, coalesce(f, 0) AS f_unique_transitions, coalesce(g, 0) AS g_mean_out, coalesce(h, 0) AS h_std_out, coalesce(i, 0) AS i_max_out, coalesce(j, 0) AS j_min_out, round(coalesce(se / CAST(al AS DOUBLE), 0), 6) AS k_self_loop, coalesce(l, 0) AS l_unique_trigrams, m_max_freq, n_min_freq, o_std_freq, p_mean_freq, round(coalesce(f, 0) / CAST(v * (v - 1) AS DOUBLE), 6) AS q_density, v AS r_n_types_total
FROM uni LEFT JOIN b ON b.seq_id = uni.seq_id LEFT JOIN t ON t.seq_id = uni.seq_id, v""",
)
def seq_features_18(spark, d):
    return features.eighteen(events(spark, d), len(TYPES))


for _share in (False, True):
    _cols = ", ".join((f"round(sum(CASE WHEN token = '{t}' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS n_{t}" if _share else f"CAST(sum(CASE WHEN token = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{t}") for t in TYPES)
    query("bag_l1" if _share else "bag_counts", f"WITH {SEQ} SELECT seq_id, {_cols} FROM seq GROUP BY seq_id")(lambda spark, d, share=_share: features.bag(events(spark, d), TYPES, share))


DIVERSITY = f"""WITH {SEQ}, ty AS (SELECT seq_id, token, count(*) AS c, sum(count(*)) OVER (PARTITION BY seq_id) AS n FROM seq GROUP BY seq_id, token)
SELECT seq_id, CAST(max(n) AS BIGINT) AS n, count(*) AS n_unique, round(abs(-sum(c / CAST(n AS DOUBLE) * ln(c / CAST(n AS DOUBLE)))), 6) AS entropy_nats, round(CASE WHEN count(*) > 1 THEN -sum(c / CAST(n AS DOUBLE) * ln(c / CAST(n AS DOUBLE))) / ln(count(*)) ELSE 0 END, 6) AS evenness, round(1 - count(*) / CAST(max(n) AS DOUBLE), 6) AS repetition, round(max(c / CAST(n AS DOUBLE)), 6) AS max_share, round(count(*) / CAST(max(n) AS DOUBLE), 6) AS richness_rate FROM ty GROUP BY seq_id"""


@query("diversity", DIVERSITY)
def diversity(spark, d):
    return features.diversity(events(spark, d))


@query("bag_aggregates", DIVERSITY.replace("SELECT seq_id, CAST(max(n) AS BIGINT) AS n, count(*) AS n_unique,", "SELECT seq_id, " + ", ".join(f"round(sum(CASE WHEN token = '{t}' THEN c ELSE 0 END) / CAST(max(n) AS DOUBLE), 6) AS n_{t}" for t in TYPES) + ", CAST(max(n) AS BIGINT) AS n, count(*) AS n_unique,"))
def bag_aggregates(spark, d):
    seqs = events(spark, d)
    return features.bag(seqs, TYPES, True).join(features.diversity(seqs), "seq_id")


@query("bag_bigram", f"WITH {SEQ}, {BI} SELECT seq_id, t1, t2, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY seq_id) AS DOUBLE), 6) AS share FROM bi GROUP BY seq_id, t1, t2")
def bag_bigram(spark, d):
    c = sequences.ngrams(events(spark, d), 2).groupBy("seq_id", "t1", "t2").agg(F.count(F.lit(1)).alias("c"))
    return c.join(c.groupBy("seq_id").agg(F.sum("c").alias("all")), "seq_id").select("seq_id", "t1", "t2", F.round(F.col("c") / F.col("all"), 6).alias("share"))


PROFILE = "pf AS (SELECT context, token, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY context) AS DOUBLE) AS p_token, count(*) / CAST(sum(count(*)) OVER (PARTITION BY token) AS DOUBLE) AS p_context FROM cs GROUP BY context, token)"


@query(
    "context_features",
    f"""WITH {CTX}, {BI}, {PROFILE}, tr AS (SELECT t1, t2, count(*) / CAST(sum(count(*)) OVER (PARTITION BY t1) AS DOUBLE) AS p FROM bi GROUP BY t1, t2),
u AS (SELECT seq_id, cs.context, round(avg(log2(greatest(p_token, 1e-4))), 6) AS log_p_token, round(avg(log2(greatest(p_context, 1e-4))), 6) AS log_p_context, round(sum(-greatest(p_token, 1e-4) * log2(greatest(p_token, 1e-4))), 6) AS uncertainty FROM cs JOIN pf ON pf.context = cs.context AND pf.token = cs.token GROUP BY seq_id, cs.context),
b AS (SELECT seq_id, round(avg(log2(p)), 6) AS log_p_transition, round(pow(2.0, -avg(log2(p))), 6) AS inverse_geometric_mean, round(count(*) / CAST(count(DISTINCT bi.t1 || ' ' || bi.t2) AS DOUBLE), 6) AS linearity FROM bi JOIN tr ON tr.t1 = bi.t1 AND tr.t2 = bi.t2 GROUP BY seq_id)
SELECT u.*, log_p_transition, inverse_geometric_mean, linearity FROM u LEFT JOIN b ON b.seq_id = u.seq_id""",
)
def context_features(spark, d):
    return features.conditioned(in_context(spark, d))


DEP = """c AS (SELECT t1, t2, count(*) AS n FROM bi GROUP BY t1, t2), h1 AS (SELECT sum(-p * log2(p)) AS h1 FROM (SELECT sum(n) / CAST((SELECT sum(n) FROM c) AS DOUBLE) AS p FROM c GROUP BY t2)),
h2 AS (SELECT -sum(n / CAST((SELECT sum(n) FROM c) AS DOUBLE) * log2(n / CAST(r AS DOUBLE))) AS h2 FROM (SELECT n, sum(n) OVER (PARTITION BY t1) AS r FROM c)) SELECT round(h1, 6) AS h1, round(h2, 6) AS h2, round(CASE WHEN h1 > 0 THEN (h1 - h2) / h1 ELSE 0 END, 6) AS dependency FROM h1, h2"""


@query("dependency_real", f"WITH {SEQ}, {BI}, {DEP}")
def dependency_real(spark, d):
    return language.dependency(events(spark, d))


@query("dependency_shuffled", f"WITH {SEQ.replace('seq AS', 's0 AS')}, seq AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY {HASH.format(s=15485863 * 3)}, pos) - 1 AS pos, token, value FROM s0), {BI}, {DEP}")
def dependency_shuffled(spark, d):
    return language.dependency(sequences.shuffled(events(spark, d), 3))


@query("dependency_by_context", f"WITH {CTX}, {BI}, c AS (SELECT context, t1, t2, count(*) AS n FROM bi JOIN m ON m.seq_id = bi.seq_id GROUP BY context, t1, t2), a AS (SELECT *, sum(n) OVER (PARTITION BY context) AS al, sum(n) OVER (PARTITION BY context, t1) AS r FROM c), h2 AS (SELECT context, -sum(n / CAST(al AS DOUBLE) * log2(n / CAST(r AS DOUBLE))) AS h2 FROM a GROUP BY context), k AS (SELECT context, sum(n) / CAST(max(al) AS DOUBLE) AS p FROM a GROUP BY context, t2), h1 AS (SELECT context, sum(-p * log2(p)) AS h1 FROM k GROUP BY context) SELECT h1.context, round(h1, 6) AS h1, round(h2, 6) AS h2, round(CASE WHEN h1 > 0 THEN (h1 - h2) / h1 ELSE 0 END, 6) AS dependency FROM h1 JOIN h2 ON h1.context = h2.context")
def dependency_by_context(spark, d):
    return language.dependency(in_context(spark, d), ["context"])


@query(
    "compressibility",
    f"WITH {SEQ}, l AS (SELECT token, lag(token) OVER (PARTITION BY seq_id ORDER BY pos) AS l1, lag(token, 2) OVER (PARTITION BY seq_id ORDER BY pos) AS l2 FROM seq), g1 AS (SELECT count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM l GROUP BY token), g2 AS (SELECT count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY l1) AS DOUBLE) AS p FROM l GROUP BY l1, token), g3 AS (SELECT count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY l1, l2) AS DOUBLE) AS p FROM l GROUP BY l1, l2, token) "
    + " UNION ALL ".join(f'SELECT {n} AS "order", round(-sum(n * log2(p + 1e-12)) / CAST(sum(n) AS DOUBLE), 6) AS bits FROM g{n}' for n in (1, 2, 3)),
)
def compressibility(spark, d):
    return language.compressibility(events(spark, d))


MODEL = f"""{SEQ}, {BI}, tr AS (SELECT *, {HELD} AS held FROM bi), vo AS (SELECT DISTINCT token FROM seq WHERE NOT {HELD}), c AS (SELECT t1, t2, count(*) AS n FROM tr WHERE NOT held GROUP BY t1, t2),
g AS (SELECT a.token AS t1, b.token AS t2, coalesce(n, 0) AS n FROM vo a CROSS JOIN vo b LEFT JOIN c ON c.t1 = a.token AND c.t2 = b.token),
mo AS (SELECT t1, t2, (n + 1.0) / CAST(sum(n) OVER (PARTITION BY t1) + (SELECT count(*) FROM vo) AS DOUBLE) AS p FROM g), be AS (SELECT t1, t2 AS guess FROM (SELECT t1, t2, row_number() OVER (PARTITION BY t1 ORDER BY round(p, 12) DESC, t2) AS r FROM mo) WHERE r = 1)"""


@query("bigram_lm_bits", f"WITH {MODEL} SELECT round(avg(coalesce(-log2(p), log2((SELECT count(*) FROM vo)))), 6) AS bits, round(avg(CASE WHEN guess = tr.t2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM tr LEFT JOIN mo ON mo.t1 = tr.t1 AND mo.t2 = tr.t2 LEFT JOIN be ON be.t1 = tr.t1 WHERE held")
def bigram_lm_bits(spark, d):
    seqs = events(spark, d)
    return language.next_token(split(seqs, False), language.bigram_model(split(seqs, True)))


@query("compression_ratio", f"WITH {MODEL} SELECT round(round(avg(coalesce(-log2(p), log2((SELECT count(*) FROM vo)))), 6) / log2((SELECT count(*) FROM vo)), 6) AS ratio FROM tr LEFT JOIN mo ON mo.t1 = tr.t1 AND mo.t2 = tr.t2 WHERE held")
def compression_ratio(spark, d):
    seqs = events(spark, d)
    v = split(seqs, True).agg(F.countDistinct("token").alias("v"))
    return language.next_token(split(seqs, False), language.bigram_model(split(seqs, True))).join(F.broadcast(v), how="cross").select(F.round(F.col("bits") / F.log2("v"), 6).alias("ratio"))


@query(
    "cloze_bits",
    f"WITH {MODEL}, {TRI}, h AS (SELECT t1, t2, t3, count(*) AS n FROM tri WHERE {HELD} GROUP BY t1, t2, t3), s AS (SELECT a.t1, b.t2 AS t3, a.t2 AS t, a.p * b.p AS s FROM mo a JOIN mo b ON b.t1 = a.t2), z AS (SELECT t1, t3, sum(s) AS z FROM s GROUP BY t1, t3), gu AS (SELECT t1, t3, t AS guess FROM (SELECT t1, t3, t, row_number() OVER (PARTITION BY t1, t3 ORDER BY round(s, 12) DESC, t) AS r FROM s) WHERE r = 1) SELECT round(-sum(n * log2(s.s / z)) / CAST(sum(n) AS DOUBLE), 6) AS bits, round(sum(CASE WHEN guess = h.t2 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM h JOIN s ON s.t1 = h.t1 AND s.t3 = h.t3 AND s.t = h.t2 JOIN z ON z.t1 = h.t1 AND z.t3 = h.t3 JOIN gu ON gu.t1 = h.t1 AND gu.t3 = h.t3",
)
def cloze_bits(spark, d):
    seqs = events(spark, d)
    return language.cloze(split(seqs, False), language.bigram_model(split(seqs, True)))


@query(
    "completion_greedy",
    f"WITH {MODEL}, e AS (SELECT seq_id, token FROM seq WHERE pos = 4 AND {HELD}), s1 AS (SELECT seq_id, guess AS a FROM e JOIN be ON be.t1 = token), s2 AS (SELECT seq_id, a, guess AS b FROM s1 JOIN be ON be.t1 = a), s3 AS (SELECT seq_id, a, b, guess AS c FROM s2 JOIN be ON be.t1 = b), w AS (SELECT seq_id, string_agg(substr(token, 1, 1), '' ORDER BY pos) AS truth, count(*) AS k FROM seq WHERE pos BETWEEN 5 AND 7 GROUP BY seq_id HAVING count(*) = 3) SELECT s3.seq_id, a || ' ' || b || ' ' || c AS guess, CAST(levenshtein(substr(a, 1, 1) || substr(b, 1, 1) || substr(c, 1, 1), truth) AS INTEGER) AS edits FROM s3 JOIN w ON w.seq_id = s3.seq_id",
)
def completion_greedy(spark, d):
    seqs = events(spark, d)
    guess = language.completed(split(seqs, False).where("pos = 4").select("seq_id", "token"), language.bigram_model(split(seqs, True)), 3)
    truth = sequences.assembled(seqs.where("pos between 5 and 7"), 3).select("seq_id", F.col("seq").alias("truth"))
    letters = lambda c: F.array_join(F.transform(c, lambda t: F.substring(t, 1, 1)), "")
    return guess.join(truth, "seq_id").select("seq_id", F.array_join("guess", " ").alias("guess"), F.levenshtein(letters("guess"), letters("truth")).alias("edits"))


@query(
    "unigram_ppl",
    f"WITH {CTX}, tr AS (SELECT * FROM cs WHERE NOT {HELD}), te AS (SELECT context, token, count(*) AS n FROM cs WHERE {HELD} GROUP BY context, token), v AS (SELECT count(DISTINCT token) AS v, count(*) AS gn FROM tr), o AS (SELECT context, token, count(*) AS c FROM tr GROUP BY context, token), onn AS (SELECT context, count(*) AS cn FROM tr GROUP BY context), g AS (SELECT token, count(*) AS g FROM tr GROUP BY token) SELECT te.context, round(pow(2.0, -sum(n * log2((coalesce(c, 0) + 1) / CAST(coalesce(cn, 0) + v AS DOUBLE))) / CAST(sum(n) AS DOUBLE)), 6) AS own_ppl, round(pow(2.0, -sum(n * log2((coalesce(g, 0) + 1) / CAST(gn + v AS DOUBLE))) / CAST(sum(n) AS DOUBLE)), 6) AS global_ppl FROM te LEFT JOIN o ON o.context = te.context AND o.token = te.token LEFT JOIN onn ON onn.context = te.context LEFT JOIN g ON g.token = te.token, v GROUP BY te.context",
)
def unigram_ppl(spark, d):
    rows = in_context(spark, d)
    return language.perplexity(split(rows, True), split(rows, False), "context")


@query("context_entropy_ttr", f"WITH {CTX}, c AS (SELECT context, token, count(*) AS n FROM cs GROUP BY context, token), a AS (SELECT *, sum(n) OVER (PARTITION BY context) AS al FROM c) SELECT context, CAST(max(al) AS BIGINT) AS n, count(*) AS vocabulary, round(sum(-(n / CAST(al AS DOUBLE)) * log2(n / CAST(al AS DOUBLE))), 6) AS entropy, round(count(*) / CAST(max(al) AS DOUBLE), 6) AS ttr FROM a GROUP BY context")
def context_entropy_ttr(spark, d):
    prof = features.context_profile(in_context(spark, d))
    return prof.groupBy("context").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("vocabulary"), F.round(F.sum(-F.col("p_token") * F.log2("p_token")), 6).alias("entropy"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("ttr"))


@query("js_divergence", f"WITH {CTX}, {PROFILE}, g AS (SELECT DISTINCT context FROM pf), t AS (SELECT DISTINCT token FROM pf), x AS (SELECT a.context AS a, b.context AS b, t.token, coalesce(p.p_token, 0) AS pa, coalesce(q.p_token, 0) AS pb FROM g a JOIN g b ON a.context < b.context CROSS JOIN t LEFT JOIN pf p ON p.context = a.context AND p.token = t.token LEFT JOIN pf q ON q.context = b.context AND q.token = t.token) SELECT a, b, round(sum(CASE WHEN pa > 0 THEN pa * log2(pa / ((pa + pb) / 2)) ELSE 0 END + CASE WHEN pb > 0 THEN pb * log2(pb / ((pa + pb) / 2)) ELSE 0 END) / 2, 6) AS js FROM x GROUP BY a, b")
def js_divergence(spark, d):
    return language.js_divergence(features.context_profile(in_context(spark, d)))


@query("kl_distinctiveness", f"WITH {CTX}, {PROFILE} SELECT token, round(sum(p_context * log2(p_context * (SELECT count(DISTINCT context) FROM pf))), 6) AS kl, arg_min(context, (-round(p_context, 9), context)) AS owner FROM pf GROUP BY token")
def kl_distinctiveness(spark, d):
    return language.distinctiveness(features.context_profile(in_context(spark, d)))


def _grams(n: int) -> str:
    cols = " || ' ' || ".join(["token"] + [f"lead(token, {k}) OVER w" for k in range(1, n)])
    head = " || ' ' || ".join(["token"] + [f"lead(token, {k}) OVER w" for k in range(1, n - 1)])
    tail = " || ' ' || ".join([f"lead(token, {k}) OVER w" for k in range(1, n)])
    return f"g{n} AS (SELECT gram, head, tail, count(*) AS c FROM (SELECT {cols} AS gram, {head} AS head, {tail} AS tail FROM lf WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE gram IS NOT NULL GROUP BY gram, head, tail HAVING count(*) >= 5)"


@query("maximal_repeats", "WITH lf AS (SELECT l_orderkey AS seq_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_returnflag || l_linestatus AS token FROM lineitem), " + ", ".join(map(_grams, (2, 3, 4))) + ' SELECT 2 AS n, gram, c AS "count" FROM g2 WHERE NOT EXISTS (SELECT 1 FROM g3 WHERE (g3.head = g2.gram OR g3.tail = g2.gram) AND g3.c = g2.c) UNION ALL SELECT 3, gram, c FROM g3 WHERE NOT EXISTS (SELECT 1 FROM g4 WHERE (g4.head = g3.gram OR g4.tail = g3.gram) AND g4.c = g3.c) UNION ALL SELECT 4, gram, c FROM g4')
def maximal_repeats(spark, d):
    rows = table(spark, d, "lineitem").withColumn("token", F.concat("l_returnflag", "l_linestatus"))
    return language.repeats(sequences.from_rows(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "token"), 4, 5)


@query("graph_metrics", f"WITH {SEQ}, {BI}, e AS (SELECT t1, t2 FROM bi GROUP BY t1, t2 HAVING count(*) >= 2), no AS (SELECT t1 AS v FROM e UNION SELECT t2 FROM e), u AS (SELECT t1 AS a, t2 AS b FROM e WHERE t1 <> t2 UNION SELECT t2, t1 FROM e WHERE t1 <> t2), dg AS (SELECT a, count(*) AS d FROM u GROUP BY a), tr AS (SELECT x.a, count(*) AS t FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = y.b AND z.b = x.a GROUP BY x.a), cc AS (SELECT avg(CASE WHEN d > 1 THEN coalesce(t, 0) / CAST(d * (d - 1) AS DOUBLE) ELSE 0 END) AS c FROM no LEFT JOIN dg ON dg.a = v LEFT JOIN tr ON tr.a = v) SELECT (SELECT count(*) FROM no) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / CAST((SELECT count(*) * (count(*) - 1) FROM no) AS DOUBLE), 6) AS density, round(c, 6) AS clustering FROM cc")
def graph_metrics(spark, d):
    return language.graph(events(spark, d))


@query("perturb_truncate", f"WITH {SEQ} SELECT seq_id, CAST(pos AS INTEGER) AS pos, token FROM seq WHERE pos < 10")
def perturb_truncate(spark, d):
    return sequences.truncated(events(spark, d).drop("value"), 10)


@query("perturb_drop_hash", f"WITH {SEQ} SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS INTEGER) AS pos, token FROM seq WHERE {HASH.format(s=15485863 * 5)} % 100 >= 20")
def perturb_drop_hash(spark, d):
    return sequences.dropped(events(spark, d).drop("value"), 20, 5)


@query("length_bands", f"WITH {SEQ}, n AS (SELECT seq_id, count(*) AS n FROM seq GROUP BY seq_id) SELECT CASE WHEN n >= 2 AND n < 55 THEN '2-54' WHEN n >= 55 AND n < 70 THEN '55-69' WHEN n >= 70 AND n < 200 THEN '70-199' END AS band, count(*) AS sequences, CAST(sum(n) AS BIGINT) AS tokens FROM n GROUP BY 1")
def length_bands(spark, d):
    n = events(spark, d).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(sequences.length_band(F.col("n"), (2, 55, 70, 200)).alias("band")).agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"))
