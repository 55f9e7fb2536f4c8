from collections import Counter

from fractions import Fraction
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

SCHEMA = "doc_id long, source string, text string, mix string"


@pytest.mark.parametrize("weights", [[1], [1, 1, 1], [5, 3, 1], [0.5, 0.25, 0.125, 0.125], [1000, 1, 1, 1, 7], list(range(1, 40))])
def test_schedule_stays_within_a_block(weights):
    parts = mixing.parts_of(weights, 1024)
    assert sum(parts) == 1024 and min(parts) >= 1
    slots = mixing.schedule(parts)
    assert sorted(t for s in slots for t in s) == list(range(1024))
    had = [0] * len(parts)
    owner = {t: s for s, ts in enumerate(slots) for t in ts}
    for t in range(1024):
        had[owner[t]] += 1
        for s, p in enumerate(parts):
            assert abs(had[s] - (t + 1) * p / 1024) < 1


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_every_row_once_and_shares_hold(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "t", "clash") for i in range(3000)] + [(7, None, None, "x"), (None, "hot", "a", "x"), (7, "s1", "t", "x"), (7, "s1", "t", "x")]
    out = mixing.placed(table(spark, rows), block=4, weights={"hot": 2.0, "s0": 1.0, "s3": 1.0}).collect()
    assert len(out) == len(rows) and Counter((r["doc_id"], r["source"]) for r in out) == Counter((a, b) for a, b, *_ in rows)
    at = [r["mix_position"] for r in out]
    assert len(set(at)) == len(at)
    exact = sorted((r["mix_position"], r["source"]) for r in out if r["mix_exact"])
    seen = Counter()
    total = 2.0 + 1.0 * (len({r[1] for r in rows}) - 1)
    for k, (_, s) in enumerate(exact[: len(exact) // 4 * 4], 1):
        seen[s] += 1
        if k % 4 == 0:
            for name in {r[1] for r in rows}:
                w = (2.0 if name == "hot" else 1.0) / total
                assert abs(seen[name] / 4 - k / 4 * w) < 1.5  # blocks; weights are rounded to parts of a period


def test_physical_order_and_columns(spark):
    rows = [(i, f"s{i % 3}", "t", "c") for i in range(500)]
    df = table(spark, rows)
    want = [r["doc_id"] for r in mixing.placed(df).orderBy("mix_position").collect()]
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = out.withColumn("p", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    assert [r["doc_id"] for r in got] == want


def test_empty_table(spark):
    assert mixing.mixed(table(spark, [])).count() == 0


@pytest.mark.parametrize("weights", [[1.0] * 20, [5000**0.5] + [526**0.5] * 19, [0.7, 0.1, 1e-4, 0.3]])
def test_target_weights_hold_over_many_periods(weights):
    """Shares of the target weights themselves, not of parts of a period, while all sources have rows."""
    total, n = sum(weights), 60_000
    had = [0] * len(weights)
    for t, s, i in mixing.slots_of(mixing.whole(weights), [n] * len(weights)):
        if t >= n:
            break
        assert i == had[s]
        had[s] += 1
        if t % 997 == 0 or t == n - 1:
            assert all(abs(h - (t + 1) * w / total) < 1 + 1e-6 for h, w in zip(had, weights))
    assert sum(had) == n


def test_placed_rows_keep_target_shares(spark):
    rows = [(i, f"s{i % 20}", "t", "c") for i in range(30_000)]
    out = mixing.placed(table(spark, rows), block=1).where("mix_exact").select("mix_slot", "source").orderBy("mix_slot").collect()
    assert len({r["mix_slot"] for r in out}) == len(out) > 29_000
    seen = Counter()
    for k, r in enumerate(out, 1):
        seen[r["source"]] += 1
        assert r["mix_slot"] == k - 1 and abs(seen[r["source"]] - k / 20) < 1


def test_query_rows_keep_to_their_windows(spark):
    """Every block of the query's rows lies in its window by the exact target weights, as long as the mix is exact."""
    from tessera.llm import queries

    rows = queries.op5_pfair_mix(spark, "/root/testdata/sf0.01").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    exact = {s: Fraction(n**0.5) for s, n in sizes.items()}
    total = sum(exact.values())
    for r in rows:
        w, i, t = exact[r["source"]] / total, r["mix_block"], r["mix_slot"]
        if r["mix_exact"]:
            assert floor(i / w) <= t < ceil((i + 1) / w)
    assert len({r["mix_position"] for r in rows}) == len(rows)


def test_deviation_over_a_million_slots():
    weights = mixing.whole([0.7005, 0.2, 0.0995])
    total, seen, worst = sum(weights), [0, 0, 0], 0.0
    for t, s, i in mixing.slots_of(weights, [10**6] * 3):
        seen[s] += 1
        if t % 997 == 0 or t == 10**6:
            worst = max(worst, *(abs(n - (t + 1) * w / total) for n, w in zip(seen, weights)))
        if t >= 10**6:
            break
    assert worst < 1


def test_large_tables_have_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SLOTS", 10)
    df = spark.createDataFrame([(i if i % 3 else None, i % 2, "x", i) for i in range(2000)], "doc_id long, source int, mix_slot string, mix_position int")
    rows = mixing.placed(df).collect()
    assert len({r["_mix_position"] for r in rows}) == 2000 and {r["mix_slot"] for r in rows} == {"x"}
    assert max(r["mix_block"] for r in rows) < 10
    assert mixing.mixed(df).columns == df.columns and mixing.mixed(df.limit(0)).count() == 0


def test_named_blocks_and_order_do_not_depend_on_size(spark, monkeypatch):
    """A mix of few slots and small buckets is that of many slots and one bucket: no switch by the number of rows."""
    df = table(spark, [(i if i % 7 else None, f"s{i % 3}", f"t{i}", "c") for i in range(2000)])
    place = lambda: sorted((r["text"], r["mix_block"], r["mix_slot"], r["mix_position"], r["mix_exact"]) for r in mixing.placed(df, block=16).collect())
    want = place()
    assert max(r[1] for r in want) > 40
    monkeypatch.setattr(mixing, "MOST_SLOTS", 10)
    monkeypatch.setattr(mixing, "SLOTS_HELD", 50, raising=False)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 100)
    assert place() == want
