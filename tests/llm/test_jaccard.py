import random
import re

from tessera.llm import jaccard

SCHEMA = "doc_id long, text string, key string, n long"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(400)] + ["É", "The", "a"]
    passage = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            w = (rng.choice(docs)[1] or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + rng.choice([0, 1, 1, 2])] = rng.choice([[], [rng.choice(vocab)]])
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 6, 8, 12, 20, 40, 90, 200, 600]))]
            if rng.random() < 0.4:
                w += passage
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    return docs


def joined(spark, docs):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    docs = corpus(rng, 400) + [(1000, None), (1001, ""), (1002, "x"), (1003, "X"), (1004, "long " * 30000), (1004, "long " * 30000), (None, "lonely words that no one shares here")]
    assert joined(spark, docs) == brute(docs)


def test_chain_of_near_copies(spark):
    """Neighbours link, ends do not; all are one component."""
    w = [f"t{i}" for i in range(120)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join(w)))
        w[2 * i % 120] = f"u{i}"
    assert joined(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert joined(spark, []) == []


def test_one_of_each(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "", 1), (1, "A b c d e f", "", 1), (2, None, "", 1), (5, "", "", 1)], SCHEMA)
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(df).collect()) == [1, 2, 5]


def test_components_in_one_task_and_by_rounds(spark):
    from tessera.llm.components import components

    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    df = spark.createDataFrame(links, "u long, v long")
    up = {x: x for link in links for x in link}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    want = sorted((x, root(x)) for x in up if root(x) != x)
    assert sorted(map(tuple, components(df).collect())) == want == sorted(map(tuple, components(df, at_once=0).collect()))


def test_ids_beyond_doubles_and_repeated_rows(spark):
    big, w = 2**53 + 1, " ".join(f"t{i}" for i in range(30))
    docs = [(big, w), (None, "a b c d e f g"), (big + 2, w + " u"), (big, "quite another text with this id"), (5, ""), (5, ""), (None, w)]
    assert [r[2] for r in joined(spark, docs) if r[1] == 26 or r[1] == 27] == [big, big, big]
    kept = jaccard.one_of_each(spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], SCHEMA))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(big, w), (0, "a b c d e f g"), (big, "quite another text with this id"), (5, ""), (5, "")])
    twice = spark.createDataFrame([(1, w, "x", 1), (1, w, "y", 2), (2, "other words here now", "z", 3)], SCHEMA)
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(twice).collect()) == [1, 2]


def test_a_common_passage_makes_few_candidates(spark, monkeypatch):
    """2,000 unlinked texts share a passage of 60 words: what is compared stays far below all pairs."""
    from tessera.llm import buckets

    rng, seen = random.Random(1), []
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(90, 110))) + " " + passage) for i in range(2000)]
    real = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    assert {r[2] for r in joined(spark, docs)} == set(range(2000))
    assert sum(seen) < 2000 and buckets.CHUNK == 1024
