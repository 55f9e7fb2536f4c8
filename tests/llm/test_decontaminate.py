import hashlib
import random
import re

import pytest

from tessera.llm import decontaminate as dc

DOCS, BENCH = "doc_id long, text string, hash string, w string", "item_id long, text string, len string"
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(t):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, n=10):
    wins = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(len(w) - n + 1, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if (got := wins.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k + 1, k + m + 1))
                    items |= got
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    return out


def tables(spark, docs, bench):
    return spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOCS), spark.createDataFrame([(*b, "clash") for b in bench], BENCH)


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(80)] + ["É", "The", "über"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    bench = [(i, text(rng.choice([3, 8, 10, 25]))) for i in range(12)] + [(50, None), (51, ""), (52, "!!"), (53, text(12)), (54, "w1 w2 w3"), (55, "W1, w2; W3")]
    docs = [(d, f"{text(rng.randint(0, 40))} {rng.choice(bench)[1] if rng.random() < 0.4 else ''} {text(5)}") for d in range(60)]
    docs += [(100, None), (101, ""), (102, "w1 " * 9 + "w2 w3"), (103, "word " * 20000 + (bench[0][1] or "")), (104, "a"), (104, "a"), (104, bench[0][1]), (None, bench[1][1]), (105, (bench[2][1] + " ") * 3)]
    return docs, bench


def test_equals_brute_force(spark, fixture):
    docs, bench = fixture
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in dc.contamination(*tables(spark, docs, bench)).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, bench), key=str)


def test_shuffled_set_finds_the_same(spark, fixture, monkeypatch):
    docs, bench = fixture
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    got = [r["n_hit"] for r in dc.contamination(*tables(spark, docs, bench)).orderBy("doc_id", "n_words", "n_hit").collect()]
    assert sorted(got) == sorted(r[2] for r in brute(docs, bench))


def test_documents_or_spans_go(spark):
    bench = [(1, "one two three four five six seven eight nine ten")]
    docs = [(1, "Keep this. One two three, four five six seven eight nine ten! And that."), (2, "clean text"), (3, None)]
    d, b = tables(spark, docs, bench)
    assert sorted(r["doc_id"] for r in dc.decontaminate(d, b).collect()) == [2, 3]
    out = {r["doc_id"]: r["text"] for r in dc.decontaminate(d, b, drop="spans").collect()}
    assert out == {1: "Keep this. And that.", 2: "clean text", 3: None}
    with pytest.raises(ValueError):
        dc.decontaminate(d, b, drop="words")


def test_empty_tables(spark):
    d, b = tables(spark, [], [])
    assert dc.contamination(d, b).count() == 0
    d, _ = tables(spark, [(1, "a b")], [])
    r = dc.contamination(d, b).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (2, 0, False)
