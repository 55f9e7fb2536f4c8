import random

import numpy as np
import pytest

from tessera.llm import quality

SF = "/root/testdata/sf0.01"
GOOD, BAD = "alpha beta gamma delta epsilon".split(), "BAD!! $$$ XX".split()


def test_held_out_accuracy(spark):
    """Fitted on the labels of two thirds of the documents, judged on the rest."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.judged(spark, docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r["keep"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["keep"] for r in got if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(junk) <= 0.1


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string, keep string, p_site string"
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, f"{words} {i}" if i % 2 else "BAD!! BAD!! BAD!! " * 5, "h", "en", "c", "c") for i in range(60)]
    rows += [(100, None, None, None, "c", "c"), (101, "", "h", "en", "c", "c"), (None, words, None, "en", "c", "c"), (1, f"{words} 1", "h", "en", "c", "c"), (102, "long words here " * 20000, "h", "en", "c", "c")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (41, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.judged(spark, docs, labels).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["keep"] for r in out}
    assert by[41] and by[59] and not by[42] and not by[100] and not by[101]
    left = {r["doc_id"] for r in quality.kept(spark, docs, labels).collect()}
    assert 41 in left and 42 not in left and 101 not in left
    assert quality.judged(spark, docs.limit(0), labels).count() == 0
    free = quality.judged(spark, docs, labels.limit(0)).collect()
    assert all(r["keep"] == (r["doc_id"] not in (100, 101)) for r in free)


def test_sparse_sites_shrink():
    assert quality.strength(0.0, 0.1, 0.5) > quality.strength(0.2, 0.0, 0.5) >= 1.0
    x = np.array([[0.0], [1.0]] * 50)
    w = quality.fit(x, np.zeros(0, int), np.zeros(0, int), x[:, 0], 0)
    assert w[1] > 3 and w[0] == pytest.approx(-w[1] / 2, rel=0.3)


def test_sites_leave_each_document_out(spark):
    """p_site against sums over the other documents of host and path, by plain loops."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(GOOD if rng.random() < 0.7 else BAD) for _ in range(rng.randrange(5, 60))), rng.choice(["a", "b", None, "c"]) if i else "alone", rng.choice(["x", "y", None])) for i in range(80)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    got = quality.judged(spark, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    p, n = {r["doc_id"]: r["p_document"] for r in got}, len(docs)
    mean = sum(p.values()) / n
    groups = lambda key: {k: [r for r in got if key(r) == k] for k in {key(r) for r in got}}
    host, site = (lambda r: r["host"]), (lambda r: (r["host"], r["path"]))
    total = lambda rows: sum(p[r["doc_id"]] for r in rows)
    hosts, sites = groups(host), groups(site)
    noise = lambda k: mean * (1 - mean) * k / n
    k_host = quality.strength(sum(len(g) * (total(g) / len(g) - mean) ** 2 for g in hosts.values()) / n, noise(len(hosts)), mean)
    up = {k: (k_host * mean + total(g)) / (k_host + len(g)) for k, g in hosts.items()}
    k_path = quality.strength(sum(len(g) * (total(g) / len(g) - up[k[0]]) ** 2 for k, g in sites.items()) / n, noise(len(sites)), mean)
    for r in got:
        others = [x for x in hosts[r["host"]] if x["doc_id"] != r["doc_id"]]
        above = (k_host * mean + total(others)) / (k_host + len(others))
        near = [x for x in others if x["path"] == r["path"]]
        assert abs(r["p_site"] - (k_path * above + total(near)) / (k_path + len(near))) < 1e-9
    alone = next(r for r in got if r["doc_id"] == 0)
    assert abs(alone["p_site"] - mean) < 1e-9
