"""Mixing sources to target weights by Pfair scheduling.

Time is in slots of one block. Block i of a source of weight w is released at floor(i / w) and due at
ceil((i + 1) / w); in each slot the released block of the earliest deadline goes first. Weights are exact fractions and
every block there is gets its slot within these bounds: a source has never had a block more or less than its share of the
slots so far, by the target weights themselves, as long as it has rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, partitions, settle, small

BLOCK, ROWS_PER_BUCKET = 16, 4096
MOST_SOURCES = 100_000
#: Where no block is named, blocks are as large as it takes for so many slots at most.
MOST_SLOTS = 1_000_000
#: Slots that the driver holds at a time.
SLOTS_HELD = 250_000


def parts_of(weights: list[float], period: int) -> list[int]:
    """Whole parts of the period, one at least each, by largest remainders."""
    total = sum(weights)
    exact = [max(w / total * period, 1.0) for w in weights]
    parts = [int(x) for x in exact]
    order = sorted(range(len(parts)), key=lambda i: (parts[i] - exact[i], i))
    short = period - sum(parts)
    for i in order[: max(short, 0)]:
        parts[i] += 1
    while sum(parts) > period:  # the least shares were raised to one part
        most = max(range(len(parts)), key=lambda i: (parts[i], -i))
        parts[most] -= min(parts[most] - 1, sum(parts) - period)
    for i in range(period - sum(parts)):
        parts[order[i % len(order)]] += 1
    return parts


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    unit = lcm(*(x.denominator for x in exact))
    return [int(x * unit) for x in exact]


def slots_of(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(slot, source, block) of all blocks, in order of slots; a slot for which no block is released stays empty."""
    total = sum(weights)
    waiting = [(0, s, 0) for s, n in enumerate(blocks) if n]
    ready: list[tuple[int, int, int]] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), s, i))
        due, s, i = heapq.heappop(ready)
        assert due > t
        yield t, s, i
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))
        t += 1


def schedule(parts: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks in one period of sum(parts) slots."""
    slots: list[list[int]] = [[] for _ in parts]
    for t, s, _ in slots_of(parts, parts):
        slots[s].append(t)
    return slots


def written(spark, weights: list[int], blocks: list[int]) -> tuple[DataFrame, int]:
    """__k, mix_block, mix_slot of all blocks, and the slot in which the first source gives its last block."""
    end, pieces, rows = None, [], []

    def put() -> None:
        k, i, t = np.array(rows, np.int64).reshape(-1, 3).T
        pieces.append(settle(spark.createDataFrame(pd.DataFrame({"__k": k.astype(np.int32), "mix_block": i, "mix_slot": t}), "__k int, mix_block long, mix_slot long"), "slots"))
        rows.clear()

    for t, s, i in slots_of(weights, blocks):
        end = t if end is None and i + 1 == blocks[s] else end
        rows.append((s, i, t))
        if len(rows) == SLOTS_HELD:
            put()
    if rows or not pieces:
        put()
    out = pieces[0]
    for more in pieces[1:]:
        out = out.unionByName(more)
    return out, end or 0


def placed(docs: DataFrame, weights: dict[str, float] | None = None, block: int | None = None, temperature: float = 0.5, seed: int = 0, *, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with mix_block, mix_slot, mix_position and mix_exact (with underscores before where docs has such columns).

    Each row is placed once. Within a source rows are in the order of a hash of their ids, however many they are, and
    cut into blocks of `block` rows. Only where none is named the size matters: BLOCK rows or, for more than MOST_SLOTS
    of these, more. mix_position is unique and orders the mix. mix_exact:
    before the first source is used up; from there its slots stay empty and the others keep their shares of the rest.
    Target weights: as given, by the source as text (a source not named has the least of them; a weight of 0 counts as a
    thousandth of the rest), else sizes to the power of temperature. A null source is one of its own. Rows with a null
    id are in the order of a hash of their other columns, repeated rows next to each other; each is placed. Texts are
    not read but for that. An empty table gives an empty one. More than MOST_SOURCES sources raise ValueError.
    """
    spark = docs.sparkSession
    known = docs.groupBy(docs[source].cast("string").alias("s")).count().limit(MOST_SOURCES + 1).collect()
    if len(known) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    known.sort(key=lambda r: (r["s"] is not None, r["s"] or ""))
    block = block or max(BLOCK, -(-sum(r["count"] for r in known) // MOST_SLOTS))
    least = min(weights.values()) if weights else 0.0
    want = [weights.get(r["s"], least) if weights else r["count"] ** temperature for r in known]
    some = sum(w for w in want if w > 0) / 1000 or 1.0
    want = [w if w > 0 else some for w in want]
    of_slot, end = written(spark, whole(want), [-(-r["count"] // block) for r in known])
    block_name, slot_name, position_name, exact_name = (free(docs, c) for c in ("mix_block", "mix_slot", "mix_position", "mix_exact"))
    k, s, buckets, h, bucket, before, r, at = (free(docs, f"__{c}") for c in ("k", "s", "buckets", "hash", "bucket", "before", "r", "at"))
    of_source = spark.createDataFrame([(x["s"], i, -(-x["count"] // ROWS_PER_BUCKET)) for i, x in enumerate(known)], f"`{s}` string, `{k}` int, `{buckets}` int")
    rest = [docs[f"`{f.name}`"] for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.join(F.broadcast(of_source), docs[source].cast("string").eqNullSafe(F.col(s)))
    rows = rows.withColumn(h, F.when(docs[doc_id].isNull(), F.xxhash64(*rest, F.lit(seed))).otherwise(F.xxhash64(docs[doc_id], F.lit(seed))))
    # buckets are ranges of the hash: the order within a source is the hash's for any number of them
    rows = rows.withColumn(bucket, F.shiftright((F.shiftright(h, 32) + F.lit(1 << 31)) * F.col(buckets), 32).cast("int"))
    counts = rows.groupBy(k, bucket).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(k, bucket, (F.sum("n").over(Window.partitionBy(k).orderBy(bucket)) - F.col("n")).alias(before))
    ranked = rows.withColumn(r, F.row_number().over(Window.partitionBy(k, bucket).orderBy(h, docs[doc_id])) - 1)
    ranked = ranked.join(settle(offsets, "offsets"), [k, bucket]).withColumn(at, F.col(before) + F.col(r))
    ranked = ranked.withColumn(block_name, F.floor(F.col(at) / block).cast("long"))
    slots = small(of_slot.select(F.col("__k").alias(k), F.col("mix_block").alias(block_name), F.col("mix_slot").alias(slot_name)))
    out = ranked.join(slots, [k, block_name])
    out = out.withColumn(position_name, F.col(slot_name) * block + F.col(at) % block).withColumn(exact_name, F.col(slot_name) <= end)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], block_name, slot_name, position_name, exact_name)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, **how) -> DataFrame:
    """docs, their rows in the order of the mix: partitions one after the other, each sorted. Edge cases as of placed."""
    position = free(docs, "mix_position")
    rows = settle(placed(docs, weights, **how), "placed")
    last = rows.agg(F.max(position)).first()[0]
    n = partitions(docs.sparkSession)
    part = F.floor(F.col(position) * n / F.lit((last or 0) + 1)).cast("int")
    dealt = rows.repartitionById(n, part) if hasattr(rows, "repartitionById") else rows.repartitionByRange(n, position)
    return dealt.sortWithinPartitions(position).select(*[F.col(f"`{c}`") for c in docs.columns])
