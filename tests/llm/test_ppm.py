import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ppm

SCHEMA = "doc_id long, text string, lang string, held boolean, cls string"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs):
    """docs: (id, text, lang, held). Byte by byte, from counts of whole contexts."""
    tokens = {i: [w for w in re.split("[\x20\x09-\x0d]+", lowered(t or "")) if w] + [""] for i, t, _, _ in docs}
    count, trie, langs = Counter(), defaultdict(Counter), Counter()

    def coded(words):
        line = [ppm.PAD] * (ppm.ORDER - 1) + [ppm.SPACE] + list("".join(w + " " for w in words[:-1]).encode()) + [ppm.END]
        for i in range(ppm.ORDER, len(line)):
            yield tuple(line[i - ppm.ORDER : i]), line[i]

    for i, _, lang, held in docs:
        if not held:
            langs[lang] += 1
            for w in tokens[i]:
                count[w] += 1
            for ctx, s in coded(tokens[i]):
                for j in range(ppm.ORDER + 1):
                    trie[lang, ctx[ppm.ORDER - j :]][s] += 1
    n_all, kinds = sum(count.values()), len(count)
    out = {}
    for i, _, lang, _ in docs:
        base = sum(math.log10((count[w] + 1) / (n_all + kinds + 1)) for w in tokens[i])
        score = math.log10((langs[lang] + 1) / (sum(langs.values()) + ppm.CLASSES))
        for ctx, s in coded(tokens[i]):
            out_of = set()
            for j in range(ppm.ORDER, -1, -1):
                here = {k: v for k, v in trie[lang, ctx[ppm.ORDER - j :]].items() if k not in out_of}
                n = sum(here.values())
                if s in here:
                    score += math.log10((2 * here[s] - 1) / (2 * n))
                    break
                if here:
                    score += math.log10(len(here) / (2 * n))
                out_of |= set(here)
            else:
                score -= math.log10(ppm.SYMBOLS - len(out_of))
        out[i] = (len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n_all, base, score)
    return out


def scored(spark, docs):
    df = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA)
    return ppm.score_documents(df, F.col("held")).collect()


def test_equals_brute_force(spark):
    rng = random.Random(1)
    syllables = ["th", "er", "on", "é", "au", "re", "Qu", "x9", "ß"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    docs = [(i, rng.choice([" ", "\n"]).join(word() for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr"]), i % 4 == 2) for i in range(40)]
    docs += [(100, None, "en", False), (101, "", None, True), (102, " \n\t ", "fr", None), (103, "zzz " * 3000, "en", True)]
    want = brute(docs)
    got = scored(spark, docs)
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] == pytest.approx(score, abs=1e-6)


def test_probabilities_sum_to_one():
    pieces = [ppm.BEGIN + t + b" \x09" for t in (b"the then", b"a ab the", b"the")]
    node = ppm.nodes_of(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), np.zeros(3, np.uint8))
    nodes, counts = np.unique(node, return_counts=True)
    context = nodes[0] >> np.uint64(8) << np.uint64(8)
    symbols = [b for b in range(256) if b not in (0x0A, 0x0B, 0x0C, 0x0D)]
    asked = context | np.array(symbols, np.uint64)
    everything = np.r_[nodes, asked]
    logp = ppm.costs(everything, np.r_[counts, np.zeros(len(asked), np.int64)])[len(nodes) :]
    assert np.sum(10.0**logp) == pytest.approx(1.0)


def test_rows_repeat_and_tables_may_be_empty(spark):
    docs = [(1, "a b", "en", False), (1, "a b", "en", False), (2, "a", "en", True), (None, "a", None, True)]
    got = scored(spark, docs)
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "None"]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert scored(spark, []) == []
    alone = scored(spark, [(1, "a", "en", True)])
    assert alone[0]["train_tokens"] == 0 and alone[0]["base_score"] == 0.0


def test_long_texts_are_cut_between_words_and_keep_their_contexts(monkeypatch):
    monkeypatch.setattr(ppm, "STRETCH", 40)
    text = b" ".join(b"w%d" % (i * i) for i in range(60)) + b" " + b"x" * 100 + b" z"
    pieces = ppm.cut_text(text)
    whole = ppm.BEGIN + text + b" \x09"
    assert len(pieces) > 5 and b"".join(p[ppm.ORDER :] for p in pieces) == whole[ppm.ORDER :]
    sizes = lambda some: np.array([len(p) for p in some])
    nodes = [ppm.nodes_of(np.frombuffer(b"".join(some), np.uint8), sizes(some), np.ones(len(some), np.uint8)) for some in (pieces, [whole])]
    assert np.array_equal(*nodes)
    assert all(p.endswith((b" ", b" \x09")) for p in pieces)
    assert ppm.cut_text(None) == [ppm.BEGIN + b"\x09"]


def test_order_of_words_matters(spark):
    line = "the cat sat on a mat and it ate "
    got = scored(spark, [(1, line * 20, "en", False), (2, line, "en", True), (3, " ".join(sorted(line.split())), "en", True)])
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[2] > score[3] + 5


def test_shards_hold_what_they_gather(monkeypatch):
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 1000, 300).astype(np.uint64)) for _ in range(9)]
    monkeypatch.setattr(ppm, "GATHER", 500)
    keys, counts = ppm.total((ppm.shut_keys(r), ppm.shut(np.ones(len(r), np.int32))) for r in rows)
    want = np.unique(np.concatenate(rows), return_counts=True)
    assert np.array_equal(keys, want[0]) and np.array_equal(counts, want[1])


@pytest.mark.parametrize("stretch", [10, 50, 10_000])
def test_blocks_add_up_whatever_their_stretches(monkeypatch, stretch):
    monkeypatch.setattr(ppm, "STRETCH", stretch)
    texts = [b"a bc a", b"", b"the then the " * 9, b"bc"]
    pieces = [(i, len(p), 1 + i % 2, i != 1, 1, p) for i, t in enumerate(texts) for p in ppm.cut_text(t)]
    rows = np.array([p[:5] for p in pieces], ppm.PIECE)
    block = ppm.Block(ppm.shut(np.frombuffer(b"".join(p[5] for p in pieces), np.uint8)), rows.tobytes(), 7)
    words = block.summed(block.words, block.word_piece, np.ones(len(block.words.keys)))
    nodes = block.summed(block.nodes, block.node_piece(), np.ones(len(block.nodes.keys)))
    by_text = lambda v: np.bincount(rows["row"], weights=v).tolist()
    assert by_text(words) == [3, 0, 27, 1]
    assert by_text(nodes) == [8, 1, len(b"the then the " * 9) + 1, 4]
    assert block.trained(block.words, block.word_piece).sum() == 31
    assert block.trained(block.nodes, block.node_piece()).sum() == sum(by_text(nodes)) - 1
    assert len(block.words.keys) == 4 and all(np.all(np.diff(block.nodes.keys[i:j]) > 0) for i, j in zip(block.nodes.begin, block.nodes.begin[1:]) if j > i + 1)
