import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components
from tests.llm.test_lines import brute as without_lines
from tests.llm.test_ppm import brute as scores
from tests.llm.test_secrets import base_spans

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "pages", "conversations", "embeddings", "labels"]


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: entry.queries()[name](spark, SF)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_equals_sql(run, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel, got = c.sql(entry.oracle_sql()[name]), run(name)
    cols = sorted(rel.columns)
    assert sorted(got.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    assert sorted((tuple(r[x] for x in cols) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_op1(spark, run):
    import zlib

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    from tessera.llm.ppm import CLASSES
    from pyspark.sql import functions as F

    langs = spark.createDataFrame([(x,) for x in {r["lang"] for r in rows}], "l string").select("l", F.pmod(F.xxhash64("l"), F.lit(CLASSES)).alias("c"))
    same = {r["l"]: r["c"] for r in langs.collect()}  # languages may share a class
    want = scores([(r["doc_id"], r["text"], same[r["lang"]], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows])
    for r in run("op1_ppm_score").collect():
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_op2(run, docs):
    want = without_lines(docs)
    got = {r["doc_id"]: r["text_sha256"] for r in run("op2_fuzzy_lines").collect()}
    assert got == {d: None if t is None else hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}


def test_op3(spark, run, docs):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in run("op3_decontaminate").collect()]
    assert sorted(got) == sorted(contaminated(docs, bench))


def test_op4_and_op5(run, docs):
    assert sorted(r["doc_id"] for r in run("op4_quality_classifier").collect()) == sorted(d for d, _ in docs)
    mix = run("op5_pfair_mix").collect()
    assert sorted(r["doc_id"] for r in mix) == sorted(d for d, _ in docs) and len({r["mix_position"] for r in mix}) == len(docs)


def test_op8(run, docs):
    text = dict(docs)
    for r in run("op8_secret_scan").collect():
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(text[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_op9(spark, run):
    import numpy as np

    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in run("op9_projection_forest").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hit = 0
    for q, near in got.items():
        s = (x * x[ids == q]).sum(1)
        s[ids == q] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:20]]) & {i for i, _ in near})
        assert len(near) == 20 and all(v == pytest.approx(float((x[ids == i] * x[ids == q]).sum()), abs=1e-12) for i, v in near)
    assert hit >= 0.9 * 20 * len(got)


def test_op10(run, docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in run("op10_ngram_jaccard_join").collect()]
    assert sorted(got) == sorted(components(docs))
