import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import jaccard, lines

SCHEMA = "doc_id long, text string, line string, key string"


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(90))] for _ in range(2))
        assert lines.edits(a, b) == plain_edits(a, b)


def words(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.findall("[0-9a-z\x80-\U0010ffff]+", low)


def test_simhash():
    rng = np.random.default_rng(0)
    n = np.array([1, 5, 255, 256, 1000, 3])
    w = rng.integers(0, 2**63, n.sum(), dtype=np.uint64)
    first = np.cumsum(n) - n
    for got, a, k in zip(lines.simhash(w, first, n), first, n):
        bits = [(2 * sum(int(x) >> b & 1 for x in w[a : a + k]) > k) << b for b in range(64)]
        assert int(got) == sum(bits)


def brute(docs):
    seen = {}
    for d, t in sorted((d, t) for d, t in docs if t):
        for i, line in enumerate(t.split("\n")):
            w = words(line)
            if len(w) >= lines.MIN_WORDS:
                seen.setdefault(tuple(w), []).append((d, i))
    entries = list(seen)
    flat = " \n".join(" ".join(e) for e in entries).encode()
    _, _, first, n, hashed = lines.entry_lines([flat]) if entries else (0, 0, np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64))
    sims = [int(x) for x in lines.simhash(hashed, first, n)]
    pairs = [int(x) for x in lines.simhash(lines.word_pairs(hashed, first, n), first, n)]
    up = list(range(len(entries)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(entries):
        for j, b in enumerate(entries[:i]):
            if (sims[i] ^ sims[j]).bit_count() <= lines.HAMMING and (pairs[i] ^ pairs[j]).bit_count() <= lines.PAIR_HAMMING and 100 * plain_edits(a, b) <= 20 * max(len(a), len(b)):
                up[root(i)] = root(j)
    groups = {}
    for i, e in enumerate(entries):
        groups.setdefault(root(i), []).extend(seen[e])
    gone = {x for g in groups.values() for x in g if x != min(g)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def test_equals_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)] + ["É", "The"]
    pool, docs = [], []
    for d in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            if pool and rng.random() < 0.6:
                w = rng.choice(pool).split()
                for _ in range(rng.choice([0, 0, 1, 1, 2])):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            else:
                w = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 20, 60, 120, 300]))]
            pool.append(" ".join(w))
            own.append(rng.choice([" ", ", "]).join(w) + rng.choice(["", ".", "!!"]))
        docs.append((d, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "again " * 20000), (104, "again " * 20000)]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in docs], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(df).collect()}
    assert got == brute(docs)
    assert any(got[d] != t for d, t in docs)


def test_repeated_rows_and_empty_table(spark):
    a = "one two three four five six"
    df = spark.createDataFrame([(1, a, "", ""), (1, a, "", ""), (2, a, "", ""), (None, a, "", "")], SCHEMA)
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in lines.without_repeated_lines(df).collect()), key=str)
    assert len(got) == 4 and sum(t == a for *_, t in got) in (1, 2)
    assert lines.without_repeated_lines(df.limit(0)).count() == 0


def test_lists_of_alike_lines_share_a_pair():
    """Whatever the order of pairs, and wherever the edits fall: apart, side by side, only insertions or only deletions."""
    rng = random.Random(12)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    shared = checked = 0
    for case in range(3000):
        words = rng.choice([4, 30, 1000])
        a = [rng.randrange(words) for _ in range(rng.randint(5, 70))]
        b, at, kinds = list(a), rng.randrange(len(a)), rng.choice([[0], [1], [2], [0, 1, 2]])
        for _ in range(rng.randint(0, len(a) // 4)):
            at = min(len(b) - 1, rng.choice([at, at + 1, at + 2, rng.randrange(len(b))]))
            kind = rng.choice(kinds)
            if kind == 0:
                b[at] = rng.randrange(words)
            elif kind == 1:
                b.insert(rng.choice([at, len(b)]), rng.randrange(words))
            else:
                b.pop(at)
        if min(len(a), len(b)) < lines.NEAR_WORDS or 100 * plain_edits(a, b) > 20 * max(len(a), len(b)):
            continue
        flat = lines.mix64(np.array(a + b, np.uint64) + np.uint64(1000 * case))
        n = np.array([len(a), len(b)])
        line, pair, _, _ = lines.prefixes(flat, np.cumsum(n) - n, n, none)
        checked += 1
        shared += bool(set(pair[line == 0].tolist()) & set(pair[line == 1].tolist()))
    assert shared == checked > 1000


def test_finds_all_pairs_of_edit_similarity(spark):
    """Edit similarity alone decides: lines that are alike but far apart by SimHash, of many lengths, among common words."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    docs, want = [], 0
    for n in (5, 9, 10, 14, 20, 33, 60, 150):
        for _ in range(12):
            a = [rng.choice(vocab[:40] if rng.random() < 0.5 else vocab) for _ in range(n)]
            b = list(a)
            for _ in range(n // 5):
                at = rng.randrange(len(b))
                rng.choice([lambda: b.__setitem__(at, rng.choice(vocab)), lambda: b.insert(at, rng.choice(vocab)), lambda: b.pop(at)])()
            alike = len(b) >= lines.MIN_WORDS and 100 * plain_edits(a, b) <= 20 * max(len(a), len(b))
            want += alike
            docs += [(2 * len(docs), " ".join(a)), (2 * len(docs) + 1, " ".join(b))]
    df = spark.createDataFrame([(*x, "", "") for x in docs], SCHEMA)
    assert sum(r["__dropped"] for r in lines.without_repeated_lines(df).collect()) == want > 80


def test_short_and_unspaced_lines(spark):
    chinese = "今天的天气非常好我们一起去公园散步吧"
    texts = ["theand thble reingwh thorin", "one", chinese, "你好，世界。", "---"]
    near = "one two three four five", "one two three four"
    docs = [(1, "\n".join(texts)), (2, "\n".join(texts)), (3, chinese.replace("公园", "湖边")), (4, "one two three fours"), (5, near[0]), (6, near[1])]
    df = spark.createDataFrame([(*x, "", "") for x in docs], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(df).collect()}
    assert got == {1: docs[0][1], 2: "---", 3: "", 4: "one two three fours", 5: near[0], 6: ""}


def of_buckets(texts):
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    rows = pd.DataFrame({"text": [t.encode() for t in texts]})
    got = list(lines.buckets(lines.index(1, SimpleNamespace(value=none))(iter([rows]))))
    return pd.concat(got) if got else pd.DataFrame({"kind": []})


def test_lines_that_share_a_common_pair_are_not_handed_on():
    """A pair of words that many unlike lines have is a large bucket of which nothing is left to ask."""
    rng = random.Random(5)
    got = of_buckets([f"c{g} d{g} " + " ".join(f"r{rng.randrange(10**9)}" for _ in range(10)) for g in range(5) for _ in range(300)])
    assert len(got) <= 30  # of 224,250 pairs chance leaves a few within the bounds


def test_near_copies_are_handed_on_as_a_forest():
    """Two groups of near copies: the pairs that are given reach all of a group, and are fewer than its lines."""
    rng = random.Random(6)
    texts = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(40)]
        for k in range(200):
            own = list(base)
            own[rng.randrange(40)] = f"g{g}n{k}"
            texts.append(" ".join(own))
    got = of_buckets(texts)
    pairs = got[got["kind"] == "pair"]
    key = np.concatenate([lines.line_keys(w, f, n) for _, _, f, n, w in [lines.entry_lines([t.encode()]) for t in texts]])
    assert len(pairs) == 2 * 199
    at = {int(k): i for i, k in enumerate(key)}
    least = lines.smallest(np.array([at[int(k)] for k in pairs["u"]]), np.array([at[int(k)] for k in pairs["v"]]), np.arange(400))
    assert least.tolist() == [0] * 200 + [200] * 200
    assert set(got.loc[got["kind"] == "member", "u"]) == set(key.tolist())


def test_only_words_of_lines_asked_for():
    rows = pd.DataFrame({"text": [b"a b\n--\nc d e\nf", b"g h"], "places": [[2], [0]]})
    got = pd.concat(lines.words_of(iter([rows])))
    assert [len(w) // 8 for w in got["words"]] == [3, 2]


def test_links_of_few_are_handed_on_whole():
    """Three near copies are three pairs, and nothing is left to ask of their bucket."""
    got = of_buckets([" ".join([*(f"w{i}" for i in range(30)), f"x{k}"]) for k in range(3)])
    assert got["kind"].tolist() == ["pair"] * 3


def test_of_few():
    """A chain goes whole; a clique of six stays, but for the links of one that hangs on it."""
    i, j = np.array([(a, b) for b in range(6) for a in range(b)] + [(0, 6), (6, 7), (7, 8)]).T
    assert lines.of_few(i, j, 9).tolist() == [False] * 15 + [True] * 3


def test_a_pair_of_overlapping_groups_is_asked_for_once(spark):
    """Groups of the same lines but one each are one; those of a long chain, which have no more than a line in common, stay."""
    rows = [(b, u, 0 if b else 1) for b in range(20) for u in range(20) if u != b]
    rows += [(100 + b, 1000 + 9 * b + k, 1000 + 9 * b) for b in range(10) for k in range(10)]
    members = spark.createDataFrame(rows, "bucket long, u long, v long")
    got = lines.merged(members).toPandas()
    near, chain = got[got["u"] < 1000], got[got["u"] >= 1000]
    assert sorted(near["u"]) == list(range(20)) and near["bucket"].nunique() == 1
    assert sorted(zip(chain["bucket"], chain["u"])) == sorted((b, u) for b, u, _ in rows if u >= 1000)


def test_long_lines_that_share_a_common_pair_are_not_handed_on():
    """Parities of enough bits tell lines of more than a hundred words apart."""
    rng = random.Random(7)
    got = of_buckets([" ".join([*(f"c{i}" for i in range(12)), *(f"r{rng.randrange(10**9)}" for _ in range(100))]) for _ in range(200)])
    assert len(got) <= 200  # of 19,900 pairs


def test_a_bucket_of_many_links_is_held_in_little_memory():
    """1,500 near copies have more than a million links in each of their buckets; two workers share an executor's memory."""
    base = [f"w{i}" for i in range(40)]
    rows = pd.DataFrame({"text": [" ".join([*base[:20], f"n{k}", *base[21:]]).encode() for k in range(1500)]})
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    packed = pd.concat(lines.index(1, SimpleNamespace(value=none))(iter([rows])))
    tracemalloc.start()
    pairs = pd.concat(lines.buckets(iter([packed])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (pairs["kind"] == "pair").sum() == 1499 and pairs.loc[pairs["kind"] == "member", "u"].nunique() == 1500
    assert most < 90e6


def test_no_links_need_no_rows_from_python(spark):
    """Rows from Python would start workers of another kind in each executor, which stay beside the others."""
    none = spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))
    for got in (lines.verified(none, none), jaccard.verified(none, none, none)):
        assert "ExistingRDD" not in got._jdf.queryExecution().toString()
        assert got.dtypes == [("u", "bigint"), ("v", "bigint")] and got.isEmpty()


def test_packed_rows_are_read_as_they_were_and_take_less_room():
    rng = np.random.default_rng(6)
    for n in (0, 1, 3000):
        rows = np.zeros(n, lines.ROW)
        rows["pair"], rows["n"], rows["lo"], rows["span"] = np.sort(rng.integers(0, 1 << 32, n)), rng.integers(5, 30, n), rng.integers(0, 30, n), rng.integers(0, 256, n)
        rows["few"], rows["more"], rows["key"] = rng.integers(0, 1 << 63, n), rng.integers(0, 1 << lines.MORE, n), rng.integers(-(1 << 63), 1 << 63, n)
        assert (lines.of_planes(lines.to_planes(rows)) == rows).all()
        assert (lines.of_planes(lines.to_planes(rows[::-1])) == rows[::-1]).all()
    rows["n"] = rows["lo"] = rows["span"] = 0  # what is left are gaps, parities and the key
    rows["few"], rows["more"] = 1 << 9, 1 << 5
    packed = pa.compress(lines.to_planes(rows), codec="lz4", asbytes=True)
    assert len(packed) < 11.6 * n


def test_parities_are_kept_for_long_lines_and_lines_asked_for_only(spark):
    """Half of what is known of a line was its parity, which went through all joins with lines; shorter ones are told apart in buckets."""
    long = " ".join(f"w{i}" for i in range(lines.LONG))
    rows = pd.DataFrame({"doc_id": ["1"], "text_hash": [1], "text": [f"a b c\n{long}\nd e f g h".encode()], "places": [[0, 1]]})
    listed, asked = pd.concat(lines.list_lines(iter([rows]))), pd.concat(lines.words_of(iter([rows])))
    assert [x is None for x in listed["bits"]] == [True, False, True] and "p0" not in listed
    assert asked["n"].tolist() == [3, lines.LONG] and (asked["sketch"].iloc[1] == listed["bits"].iloc[1]).all()
    assert np.bitwise_count(asked["sketch"].iloc[0].view(np.uint64)).sum() in (1, 3)


def test_pairs_are_handed_on_with_the_bits_in_which_they_differ():
    got = of_buckets([" ".join([*(f"w{i}" for i in range(30)), *own]) for own in (["x"], ["x", "x"], ["y"])])
    assert sorted(got["bucket"]) == [1, 1, 2]  # two of a word leave no bit


def test_long_lines_beside_lines_without_bits(spark):
    """A line of LONG words and one of fewer link, and so do two of more; unlike long ones that share much do not."""
    w = [f"w{i}" for i in range(lines.LONG + 20)]
    texts = [w[: lines.LONG], w[: lines.LONG - 1], [*w[: lines.LONG - 30], *(f"u{i}" for i in range(50))], [*w[::-1], "z"], w[::-1]]
    df = spark.createDataFrame([(i, " ".join(x), "", "") for i, x in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["__dropped"] for r in lines.without_repeated_lines(df).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}
