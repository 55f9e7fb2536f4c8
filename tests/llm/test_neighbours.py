import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(rows, k):
    good = {}
    for i, v in rows:
        x = None if v is None or any(a is None for a in v) else np.array(v, np.float32).astype(float)
        if i is not None and x is not None and np.isfinite(x).all() and x.any():
            good[i] = np.r_[x, np.zeros(8 - len(x))]  # shorter ones count as if zeros followed
    ids = sorted(good)
    m = np.stack([good[i] for i in ids]) if ids else np.zeros((0, 8))
    out = {}
    for i in ids:
        if i % 20 == 0:
            near = sorted((-float((m[j] * good[i]).sum()), ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA)
    out = {}
    for r in neighbours.nearest(df, df["vec_id"] % 20 == 0, 20, **how).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_all_leaves_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.5, 3)).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(1000, 1100)]  # a vector with many copies
    rows += [(20000, None), (20020, [0.0] * 8), (20040, [float("nan")] * 8), (20060, [1.0] * 7 + [None]), (20080, [1.0] * 3), (None, [1.0] * 8), (20100, [float("inf")] * 8)]
    want, got = brute(rows, 20), found(spark, rows, most=10**6)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((10, 8))
    rows = [(i, (centres[i % 10] + rng.standard_normal(8)).tolist()) for i in range(4000)]
    want, got = brute(rows, 20), found(spark, rows, most=40)
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_few_or_no_rows(spark):
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0] * 8)]) == {}
    assert found(spark, [(0, [1.0] * 8), (1, [2.0] * 8)]) == {0: [(1, 16.0)]}


def test_ties_between_different_vectors(spark):
    """300 distinct vectors of one score: the smallest ids are found."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(300) + 1
    rows = [(0, [1.0, 0.0])] + [(int(i), [1.0, 0.001 * j]) for j, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df["vec_id"] == 0, k=20, most=10**6).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21)) and {r["score"] for r in got} == {1.0}


def test_lengths_differ(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [1.0, 1.0, 5.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df["vec_id"] == 0, k=5, most=10**6).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 3.0), (2, 3.0)]


def test_single_precision_is_sent_as_such(spark):
    """The answers of floats are those of the same values as doubles, to the last bit."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(12).astype(np.float32).tolist()) for i in range(700)] + [(i, [1.5] * 12) for i in range(700, 760)]
    ask = lambda kind: neighbours.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), F.col("vec_id") % 20 == 0, leaf=32)
    kinds = {kind: ask(kind) for kind in ("float", "double")}
    a, b = (sorted(map(tuple, df.collect())) for df in kinds.values())
    assert a == b and len(a) == 38 * 20
