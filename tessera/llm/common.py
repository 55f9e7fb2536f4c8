"""What the training-data operators share: the shared folder, ASCII lower-casing, word patterns, packed rows."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own only where it is unset and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or "/tmp/tessera-shared").rstrip("/")


#: Rows that go to Python at a time while a table is written: texts may be long, and workers' memory is bounded.
ARROW_ROWS, ARROW_CONF = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Packed rows may have tens of KB each: so many bytes of them go at a time.
PACKED_BYTES, BYTES_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def settle(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and outlives lost executors. packed: Python reads
    packed rows on the way."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {c: spark.conf.get(c) for c in (ARROW_CONF, *[BYTES_CONF] * packed)}
    rows = int(before[ARROW_CONF])
    spark.conf.set(ARROW_CONF, str(min(ARROW_ROWS, rows) if rows > 0 else ARROW_ROWS))
    if packed:
        spark.conf.set(BYTES_CONF, str(PACKED_BYTES))
    try:
        df.write.parquet(path)
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What Python has freed goes back to the system: workers outlive their tasks and else keep it beside the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # other systems' libraries
        pass


def giving_back(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run, which gives back at its end what it has freed."""

    @wraps(run)
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        give_back()

    return whole


def no_links(spark: SparkSession) -> DataFrame:
    """An empty table of links. One made of Python rows would start Python workers of another kind in each executor."""
    return spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))


#: Written tables up to so many rows are broadcast in joins, larger ones shuffled.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A written table, marked to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free(df: DataFrame, name: str) -> str:
    """name, or the first of it with underscores before it that no column has."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z only. lower() does just that, and faster, where all characters are ASCII; it would also change other letters."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds) on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A 64-bit number for each byte, and what its place in a word is raised by; odd, so that it has an inverse.
LETTER = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
RAISE = 0xD1342543DE82EF95
#: For bytes.translate: A-Z to a-z.
BYTES_DOWN = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bytes hashed at a time.
STRETCH = 1 << 16


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RAISE to the power of 0, 1, ... n - 1, and the inverses of these, modulo 2^64."""
    up, down = np.full(n, RAISE, np.uint64), np.full(n, pow(RAISE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def hashed_runs(raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each run of bytes that are no gaps; the last byte is a gap. Equal runs have equal hashes."""
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.r_[0, edge]
    first, past = edge[::2], edge[1::2]
    out = np.empty(len(first), np.uint64)
    cut = np.searchsorted(first, np.arange(0, len(raw), STRETCH))
    for i, j in zip(cut, np.r_[cut[1:], len(first)]):
        if j > i:
            a, b = first[i], past[j - 1]
            up, down = powers(1 << int(max(b - a, STRETCH) - 1).bit_length())
            sums = np.zeros(b - a + 1, np.uint64)
            np.multiply(LETTER.take(raw[a:b]), up[: b - a], out=sums[1:])
            np.cumsum(sums, out=sums)
            begin = first[i:j] - a
            out[i:j] = (sums[past[i:j] - a] - sums[begin]) * down[begin]
    return mix64(out + (past - first).astype(np.uint64)), first


def word_hashes(texts: list[bytes], space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, with the index of each word's text.

    space: 256 booleans, true for bytes between words.
    """
    raw = np.frombuffer(b"\x20".join([*texts, b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    gap = space[raw]
    gap[ends - 1] = True
    words, first = hashed_runs(raw, gap)
    return words, np.searchsorted(ends, first, side="right")


def blocks(batches: Iterator[pd.DataFrame], most: int, column: str = "text") -> Iterator[pd.DataFrame]:
    """Frames of about so many bytes in a binary column, one row at least: an Arrow batch may hold many long texts or few short ones."""
    held, size = [], 0
    for b in batches:
        part = b[column].map(len).cumsum().to_numpy() // most
        for _, rows in b.groupby(part, sort=False):
            own = int(rows[column].map(len).sum())
            if held and size + own > most:
                yield pd.concat(held)
                held, size = [], 0
            held.append(rows)
            size += own
    if held:
        yield pd.concat(held)


#: Rows that tell how common things are, and how many common things are known to all tasks.
SAMPLE, COMMON = 8_000, 100_000
#: Bits by which common things are looked up first.
TOP = 20


def sample_of(rows: DataFrame, by: str) -> DataFrame:
    """About SAMPLE of the rows, by a hash column. It only ever decides in what order or at what cost things are done."""
    every = max(1, rows.count() // SAMPLE)
    return rows.where(F.pmod(F.xxhash64(by), F.lit(every)) == 0)


def common_ones(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(thing long, c) of a sample -> the most common things, sorted (uint64), and how common: 1 to 255, on a scale of logarithms."""
    got = counted.groupBy("thing").agg(F.sum("c").alias("c")).where("c > 2").orderBy(F.desc("c"), "thing").limit(COMMON).toPandas()
    thing = got["thing"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(thing)
    return thing[order], np.minimum(8 * np.log2(np.maximum(got["c"].to_numpy(float), 1)), 255).astype(np.uint8)[order]


def looked_up(things: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How common things are; 0 if not among the common ones."""
    keys, rank = known
    out = np.zeros(len(things), np.uint8)
    if not len(keys) or not len(things):
        return out
    # most are told from the common ones by their first bits
    there = np.zeros(1 << TOP, bool)
    there[keys >> np.uint64(64 - TOP)] = True
    at = np.flatnonzero(there[things >> np.uint64(64 - TOP)])
    i = np.minimum(np.searchsorted(keys, things[at]), len(keys) - 1)
    out[at] = np.where(keys[i] == things[at], rank[i], 0)
    return out
