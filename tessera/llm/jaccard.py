"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its 5-word shingles (64-bit hashes). Sets are in size bands of ratio 1.25, so a link joins
sets of one band or of two next to each other. For each band the shingles' universe is dealt by hash into m segments.
Linked sets differ in at most h shingles, so by the pigeonhole principle they agree in a segment, or in one of the q
segments for which one-deletion neighbourhoods are kept differ by one shingle at most: m + q > h. Each set may leave out
r segments, whichever it likes, if there are 2r more: it leaves out the most crowded ones, those that are empty or whose
shingles are all common ones (a sample tells; any choice is exact). How many segments, how many with neighbourhoods, and
r are chosen for each band by cost, from the share of common shingles that the sample has in that band.

Buckets of sets with a common key give candidates. First each goes with one member of its bucket only (a star);
verified stars are joined to components, and then just those members of a bucket are compared that are not yet in one
component. Nothing is capped: every pair with a common key is verified, or already connected, or excluded by a bound
(sizes; parity sketches, whose differing bits cannot exceed the differing shingles).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, exp
from types import MappingProxyType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import connected, gathered, packed, take
from .common import BYTES_DOWN, blocks, common_ones, giving_back, looked_up, mix64, no_links, partitions, sample_of, settle, small, word_hashes

SHINGLE, PERCENT = 5, 80
SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Odd numbers for the places of words in a shingle.
PLACES = mix64(np.arange(SHINGLE, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
#: What a crowded bucket costs, in index entries.
CROWDED_COST = 50
BLOCK_BYTES = 1_500_000
#: Index entries held before they are dealt out: the more, the larger the packed rows.
HELD = 1_000_000
#: Members verified against one centre in one group.
GROUP = 512
#: How common an empty segment is taken to be; common shingles are less.
EMPTIEST = 256
NONE_COMMON = (np.zeros(0, np.uint64), np.zeros(0, np.uint8))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle), distinct and sorted by both. A text of fewer words has one shingle, of none none."""
    words, of = word_hashes(texts, SPACES)
    n = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(n) - n
    last = starts[of] + n[of] - np.arange(len(words))  # words left in the text, this one included
    sh = np.minimum(last, SHINGLE).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(words))):
            sh[: len(words) - k] += np.where(last[: len(words) - k] > k, words[k:] * PLACES[k], np.uint64(0))
    keep = (last >= SHINGLE) | (np.arange(len(words)) == starts[of])
    of, sh = of[keep], mix64(sh[keep])
    first, n = bounds(of, len(texts))
    for a, k in zip(first.tolist(), n.tolist()):
        sh[a : a + k].sort()
    new = np.r_[True, (of[1:] != of[:-1]) | (sh[1:] != sh[:-1])] if len(of) else np.zeros(0, bool)
    return of[new], sh[new]


def bounds(of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(of, minlength=texts)
    return np.cumsum(n) - n, n


def set_keys(of: np.ndarray, sh: np.ndarray, texts: int) -> np.ndarray:
    """64 bits for each set, from the sum of its shingles' hashes and its size; as int64."""
    first, n = bounds(of, texts)
    out = np.zeros(texts, np.uint64)
    some = n > 0
    with np.errstate(over="ignore"):
        if len(sh):
            out[some] = mix64(np.add.reduceat(mix64(sh + np.uint64(0x51ED270B)), first[some]) + n[some].astype(np.uint64))
    return out.view(np.int64)


def sketches(of: np.ndarray, sh: np.ndarray, texts: int) -> list[np.ndarray]:
    """For each set 64-bit words, a power of two of them, with two bits or more for each shingle: bit b is the parity
    of the shingles that hash to b. Halves laid over each other give the sketch of half the size."""
    _, n = bounds(of, texts)
    size = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(n, 1) / 32)).clip(0).astype(np.int64))
    base = np.cumsum(size) - size
    bit = (mix64(sh + np.uint64(0x2545F491)) & (64 * size[of] - 1).astype(np.uint64)).astype(np.int64)
    ones = np.bincount(64 * base[of] + bit, minlength=int(64 * size.sum())).astype(np.uint8) & 1
    return np.split(np.packbits(ones, bitorder="little").view(np.int64), base[1:]) if texts else []


def apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded: no more than the shingles in which the sets differ."""
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.floor(F.size(x) / 2).cast("int")), xor)
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda n, w: n + F.bit_count(w))
    return F.when(F.size(a) > F.size(b), bits(half(a), b)).when(F.size(a) < F.size(b), bits(a, half(b))).otherwise(bits(a, b))


def may_link(n: Column, m: Column, a: Column, b: Column) -> Column:
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (9 * apart(a, b) <= n + m)


@lru_cache
def band_starts(most: int) -> np.ndarray:
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out)


#: Steps in which the share of common shingles is told.
SHARES = 20


@lru_cache
def plan(band: int, share: int = 0) -> tuple[int, int, int]:
    """(segments, of them with one-deletion neighbourhoods, crowded ones that a set may leave out) of a band in which
    share / SHARES of the shingles are common ones, at least cost."""
    lo = 1
    for _ in range(band):
        lo = lo * 5 // 4 + 1
    hi = lo * 5 // 4
    h, n = (hi + hi * 5 // 4) // 9, (lo + hi) / 2
    rare = n * (1 - share / SHARES)
    best = None
    for r in sorted({0, 1, 2, 3, 4, 6, 8, *(ceil(h * f) for f in (0.02, 0.03, 0.05, 0.08))}):
        for q in sorted({0, 1, 2, 3, 4, 6, 8, 12, h // 2, h + 1}):
            m = h + 1 + 2 * r - q
            if m < 1 or q > m or (m == 1 and r):
                continue
            p, free = (exp(-rare / m) if m > 1 else 0.0), m - q
            over = sum((k - r) * comb(free, k) * p**k * (1 - p) ** (free - k) for k in range(r + 1, min(free, r + 40) + 1)) if free < 900 else max(0.0, free * p - r)
            cost = m + q * n / m + CROWDED_COST * (over + q * p * (1 + n / m))
            if best is None or cost < best[0]:
                best = (cost, m, q, r)
    return best[1:]


def bands(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(band_starts(int(n.max(initial=1))), n, side="right") - 1


def entries(of: np.ndarray, sh: np.ndarray, texts: int, common: tuple[np.ndarray, np.ndarray] = NONE_COMMON, shares: dict[int, int] = MappingProxyType({})) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, upper) of all index entries; upper: for the band below the text's own. common, shares: what is
    common, and the share that it has in each band; all entries that are to meet need the same shares."""
    _, n = bounds(of, texts)
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    own = bands(n)
    plans = np.array([plan(b, shares.get(b, 0)) for b in range(int(own.max()) + 1)])
    out = []
    crowd = looked_up(sh, common)
    salt = mix64(sh + np.uint64(0x9D2C5680))
    for upper in (False, True):
        band = own - upper
        live = (band >= 0) & (n > 0)
        m, q, r = (np.where(live, plans[np.maximum(band, 0), i], 0) for i in range(3))
        base = np.cumsum(m) - m  # first segment of each text
        take = live[of]
        text = of[take]
        seg = base[text] + (salt[take] % np.maximum(m[text], 1).astype(np.uint64)).astype(np.int64)
        token = mix64(sh[take] ^ np.uint64(0xC2B2AE3D))
        total = int(m.sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, seg, token)
        size = np.bincount(seg, minlength=total)
        owner = np.repeat(np.arange(texts), m)
        place = np.arange(total) - base[owner]
        label = mix64((band[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
        crowded = np.full(total, EMPTIEST, np.int64)  # empty segments are the most crowded ones
        np.minimum.at(crowded, seg, crowd[take])
        may = (crowded > 0) & (place >= q[owner])  # where neighbourhoods are kept, nothing may be left out
        which = np.flatnonzero(may)
        which = which[np.lexsort((place[which], -crowded[which], owner[which]))]
        nth = np.arange(len(which)) - np.searchsorted(owner[which], owner[which], side="left")
        keep = np.ones(total, bool)
        keep[which[nth < r[owner[which]]]] = False
        out.append((owner[keep], mix64(label[keep] ^ mix64(sums[keep])), np.full(int(keep.sum()), upper)))
        near = place[seg] < q[text]
        with np.errstate(over="ignore"):
            out.append((text[near], mix64(label[seg[near]] ^ mix64(sums[seg[near]] - token[near])), np.full(int(near.sum()), upper)))
    return tuple(np.concatenate(x) for x in zip(*out))


def lowered(texts: pd.Series) -> list[bytes]:
    return [t.translate(BYTES_DOWN) for t in texts]


def count_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in blocks(batches, BLOCK_BYTES):
        thing, c = np.unique(shingle_sets(lowered(rows["text"]))[1], return_counts=True)
        yield pd.DataFrame({"thing": thing.view(np.int64), "c": c})


def count_common(shared):
    """(band, shingles, common ones) of a sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in blocks(batches, BLOCK_BYTES):
            of, sh = shingle_sets(lowered(rows["text"]))
            n = np.bincount(of, minlength=len(rows))
            yield pd.DataFrame({"band": bands(n)[n > 0], "n": n[n > 0], "common": np.bincount(of[looked_up(sh, shared.value) > 0], minlength=len(rows))[n > 0]})

    return run


PACKED = "part int, keys binary, at binary, sets binary, key long, n long, sketch array<long>"


def index(parts: int, shared, shares: dict[int, int]):
    """Two kinds of rows. Documents: doc_id, text_hash, set key, size, sketch. Index entries, packed: one row for each
    block and part, with keys (32 bits), set keys, and which is whose."""
    columns = ["doc_id", "text_hash", "part", "keys", "at", "sets", "key", "n", "sketch"]

    def dealt(held: list[tuple]) -> Iterator[pd.DataFrame]:
        if held:
            text, key, upper, names = (np.concatenate(x) for x in zip(*held))
            out = [(None, 0, *x, 0, 0, None) for x in packed(text, key, upper, names, parts)]
            if out:
                yield pd.DataFrame(out, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, names, entries_held = [], 0, 0
        for rows in blocks(batches, BLOCK_BYTES):
            texts = lowered(rows["text"])
            of, sh = shingle_sets(texts)
            keys, sk = set_keys(of, sh, len(texts)), sketches(of, sh, len(texts))
            n = np.bincount(of, minlength=len(texts))
            part = (mix64(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "part": part, "keys": None, "at": None, "sets": None, "key": keys, "n": n.astype(np.int64), "sketch": sk})
            once = np.zeros(len(texts), bool)
            once[np.unique(keys, return_index=True)[1]] = True
            new = once[of]
            text, key, upper = entries(of[new], sh[new], len(texts), shared.value, shares)
            held.append((text + names, key, upper, keys))
            names, entries_held = names + len(keys), entries_held + len(key)
            if entries_held >= HELD:
                yield from dealt(held)
                held, names, entries_held = [], 0, 0
        yield from dealt(held)

    return run


def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as they are; stars (u, v); and, of buckets of three and more sets, the members (bucket, u; upper)."""
    plain = {"doc_id": None, "text_hash": 0, "n": 0, "sketch": None}
    by_part: dict[int, list] = {}
    for b in batches:
        one = b["keys"].isna()
        yield b.loc[one, ["doc_id", "text_hash", "n", "sketch"]].assign(kind="document", bucket=0, u=b["key"][one], v=0, upper=False)
        b = b[~one]
        take(by_part, b)
    for kind, bucket, u, v, upper in gathered(by_part):
        yield pd.DataFrame(plain | {"kind": kind, "bucket": bucket, "u": u, "v": v, "upper": upper})


def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in blocks(batches, BLOCK_BYTES):
        of, sh = shingle_sets(lowered(rows["text"]))
        first, n = bounds(of, len(rows))
        yield pd.DataFrame({"key": set_keys(of, sh, len(rows)), "set": [sh[a : a + k].tobytes() for a, k in zip(first, n)]})


def verify(rows: pd.DataFrame) -> pd.DataFrame:
    """A centre (u = v) and sets to hold against it: the pairs that link."""
    centre = (rows["u"] == rows["v"]).to_numpy()
    own = np.frombuffer(rows["set"][centre].iloc[0], np.uint64)
    rest = rows[~centre]
    n = np.array([len(s) // 8 for s in rest["set"]], np.int64)
    flat = np.frombuffer(b"".join(rest["set"]), np.uint64)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    common = np.bincount(np.repeat(np.arange(len(n)), n), weights=own[at] == flat, minlength=len(n)).astype(np.int64)
    good = 100 * common >= PERCENT * (n + len(own) - common)
    return rest.loc[good, ["u", "v"]]


def verified(pairs: DataFrame, sized: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs (u, v) of set keys, those that link. sized: key, and rep, a document that has the set."""
    if pairs.isEmpty():
        return no_links(docs.sparkSession)
    centres = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    asked = pairs.join(centres, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"))
    asked = settle(asked.unionByName(centres.select(F.col("v").alias("u"), "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))), "asked")
    reps = settle(sized.join(asked.select(F.col("u").alias("key")).distinct(), "key", "left_semi").select("rep.doc_id", "rep.text_hash").distinct(), "reps")
    near = small(reps)
    texts = docs.join(near, docs["doc_id"].eqNullSafe(near["doc_id"]) & (docs["text_hash"] == near["text_hash"]), "left_semi")
    sets = texts.select("text").mapInPandas(sets_of, "key long, set binary")
    return settle(sets.join(small(asked), asked["u"] == sets["key"]).select("u", "v", "salt", "set").groupBy("v", "salt").applyInPandas(verify, "u long, v long"), "linked")


def may_link_sizes(n: np.ndarray, m: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """The bounds of may_link, of arrays."""
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (9 * flips <= n + m)


def rooted_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n, root of each row of docs; root is null for empty sets. A written table."""
    spark = docs.sparkSession
    kind, parts = docs.schema[doc_id].dataType.simpleString(), partitions(spark)
    # ids go through Python as strings, which are exact beside nulls
    rows = docs.select(docs[doc_id].cast("string").alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("text"))
    some = settle(sample_of(rows, "text_hash").select("text"), "sample")
    shared = spark.sparkContext.broadcast(common_ones(some.mapInPandas(count_shingles, "thing long, c long")))
    told = some.mapInPandas(count_common(shared), "band int, n long, common long").groupBy("band").agg((F.sum("common") / F.sum("n")).alias("share")).collect()  # a row for each band
    shares = {r["band"]: int(r["share"] * SHARES) for r in told}
    dealt = rows.mapInPandas(giving_back(index(parts, shared, shares)), f"doc_id string, text_hash long, {PACKED}").repartition(parts, "part")
    found = settle(dealt.mapInPandas(giving_back(buckets), "kind string, doc_id string, text_hash long, bucket long, u long, v long, upper boolean, n long, sketch array<long>"), "buckets", packed=True)
    shared.destroy()
    known = found.where("kind = 'document'").select("doc_id", "text_hash", F.col("u").alias("key"), "n", "sketch")
    sized = settle(known.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "text_hash")).alias("rep")), "sized")
    side = lambda x: sized.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    stars = found.where("kind = 'star'").select("u", "v").distinct().join(side("u"), "u").join(side("v"), "v").where(may_link(F.col("nu"), F.col("nv"), F.col("su"), F.col("sv")))
    stars = settle(stars.select("u", "v", apart(F.col("su"), F.col("sv")).alias("flips")), "stars")
    members = found.where("kind = 'member'").select("bucket", "u", "upper").distinct()
    final = connected(stars, members, sized.select("key", "n", "sketch"), may_link_sizes, lambda pairs: verified(pairs, sized, rows))
    rooted = known.join(final, known["key"] == final["node"], "left").select(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root"))
    return settle(rooted, "rooted")


def of_components(rooted: DataFrame, *what: Column) -> DataFrame:
    """rooted with aggregates of the components of several rows; null for the others."""
    several = rooted.where("n > 0").groupBy(F.col("root").alias("__root")).agg(F.count(F.lit(1)).alias("__rows"), *what).where("__rows > 1")
    return rooted.join(small(settle(several, "groups")), F.col("root") == F.col("__root"), "left")


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links): one row per row of docs.

    Texts with equal sets link; a null, empty or blank text has no shingle and links with nothing. Rows that repeat an
    id are one document if their texts link, and each is returned. A null id never is the least unless it is alone.
    Texts of any length are read whole. An empty table gives an empty one; other columns are not read, whatever their names.
    """
    out = of_components(rooted_documents(docs, doc_id, text), F.min("doc_id").alias("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each component: the one of the least id (null is greatest), then of the least
    hash of its text. Of rows that repeat both id and text one stays, unless their text is empty: those link with nothing."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    found = of_components(rooted_documents(docs, doc_id, text), F.min(first).alias("keep")).where(F.col("keep").isNotNull())
    again = settle(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("__n"), F.first("keep").alias("keep")), "again")
    told = again.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "__n", (F.col("keep.id").eqNullSafe(F.col("doc_id")) & (F.col("keep.hash") == F.col("text_hash"))).alias("__stays"))
    same = docs[doc_id].eqNullSafe(F.col("__d")) & (F.xxhash64(docs[text]) == F.col("__h"))
    gone, twice = told.where(~F.col("__stays")), settle(told.where("__stays and __n > 1"), "twice")
    out = docs.join(small(settle(gone.select("__d", "__h"), "gone")), same, "left_anti")
    if twice.isEmpty():
        return out
    marked = out.join(small(twice.select("__d", "__h")), same, "left")
    alone, repeated = marked.where(F.col("__h").isNull()), marked.where(F.col("__h").isNotNull()).dropDuplicates(["__d", "__h"])
    return alone.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
