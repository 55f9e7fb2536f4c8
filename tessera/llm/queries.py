"""The queries of the training-data operators, and what DuckDB says in their place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, lines, mixing, neighbours, ppm, quality, secrets, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ppm.score_documents(docs, F.crc32(docs["doc_id"].cast("string")) % 7 == 2)


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed(table(spark, sf_dir, "documents"), block=mixing.BLOCK).select("doc_id", "source", "mix_block", "mix_slot", "mix_position", "mix_exact")


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors["vec_id"] % 20 == 0)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP3 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

OP6 = f"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
v AS (SELECT w.conv_id, w.perspective, greatest(CAST(floor(t.turn / {chat.PART}.0) AS BIGINT), 0) AS part, t.turn, t.role, t.text, t.role = w.perspective AS own,
 '{chat.OPEN}' || CASE WHEN t.role = w.perspective THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS head, t.text || '<|im_end|>' || chr(10) AS body
 FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - length(body) AS b FROM v)
SELECT conv_id, perspective, part, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own, string_agg(head || body, '' ORDER BY turn, role, text) AS rendered,
 coalesce(string_agg(CAST(b AS BIGINT) || ':' || CAST(b + length(body) AS BIGINT), ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS mask, CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars
FROM o GROUP BY conv_id, perspective, part
"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.DEFAULT_RULES)
_GLOBS = ", ".join(f"({i}, '{g}', '{g.replace('*', '%')}')" for i, g in enumerate(url_filter.DEFAULT_BLOCK_GLOBS))
OP7 = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), {UPPER}, {LOWER}) AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*', 0) AS path FROM a),
r(verdict, rh, rp) AS (VALUES {_RULES}),
g(n, pattern, pat) AS (VALUES {_GLOBS}),
won AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM h, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
hit AS (SELECT page_id, arg_min(g.pattern, n) AS pattern FROM h, g WHERE host || path LIKE pat GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(won.verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
FROM h LEFT JOIN won ON won.page_id = h.page_id LEFT JOIN hit ON hit.page_id = h.page_id
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id
"""

ORACLE = {"op10_ngram_jaccard_join": OP10, "op3_decontaminate": OP3, "op6_chat_perspectives": OP6, "op7_url_filter": OP7}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
