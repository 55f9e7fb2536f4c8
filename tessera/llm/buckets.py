"""Buckets of members with a common key: packed rows, stars, and what is compared of larger buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, mix64, partitions, settle
from .components import components


def packed(owner: np.ndarray, key: np.ndarray, flag: np.ndarray, names: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(part, keys, at, sets) for each part. owner: index into names (int64); key: 64 bits, of which the upper half
    chooses the part and the lower half is kept; at: owners among sets, with the flag as lowest bit."""
    part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    owner, key, flag, part = owner[order], key[order], flag[order], part[order]
    edge = np.searchsorted(part, np.arange(parts + 1))
    for p, (a, b) in enumerate(zip(edge, edge[1:])):
        if b > a:
            own, at = np.unique(owner[a:b], return_inverse=True)
            yield p, key[a:b].astype(np.uint32).tobytes(), (at.astype(np.uint32) << np.uint32(1) | flag[a:b]).tobytes(), names[own].tobytes()


def take(by_part: dict[int, list], rows: pd.DataFrame) -> None:
    for p, k, at, sets in zip(rows["part"], rows["keys"], rows["at"], rows["sets"]):
        who = np.frombuffer(at, np.uint32)
        by_part.setdefault(p, []).append((np.frombuffer(k, np.uint32), np.frombuffer(sets, np.int64)[who >> 1], (who & 1).astype(bool)))


def gathered(by_part: dict[int, list]) -> Iterator[tuple[str, np.ndarray | int, np.ndarray, np.ndarray | int, np.ndarray | bool]]:
    """(kind, bucket, u, v, flag). "star": each member u of a bucket with its least member v that has no flag; pairs
    are distinct within a part. "member": the members u of buckets of three and more; buckets of the same members
    are given once. A bucket without an unflagged member gives nothing."""
    for p in sorted(by_part):
        key, who, flag = (np.concatenate(x) for x in zip(*by_part.pop(p)))
        order = np.argsort(key, kind="stable")
        again = np.r_[key[order][1:] == key[order][:-1], False]
        order = order[again | np.r_[False, again[:-1]]]  # keys that are not alone
        order = order[np.lexsort((flag[order], who[order], key[order]))]
        key, who, flag = key[order], who[order], flag[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])] if len(key) else np.zeros(0, bool)
        key, who, flag = key[new], who[new], flag[new]
        if not len(key):
            continue
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        run = np.repeat(np.arange(len(first)), size)
        centre = np.minimum.reduceat(np.where(flag, len(key), np.arange(len(key))), first)
        live = (centre < len(key)) & (size > 1)
        c = centre[run]
        star = live[run] & (c != np.arange(len(key)))
        if star.any():
            pairs = np.unique(np.stack([who[star], who[c[star]]], 1), axis=0)
            yield "star", 0, pairs[:, 0], pairs[:, 1], False
        with np.errstate(over="ignore"):
            name = np.add.reduceat(mix64(who.view(np.uint64) * np.uint64(2) + flag), first)
        once = np.zeros(len(first), bool)
        once[np.unique(name, return_index=True)[1]] = True
        rest = (live & (size > 2) & once)[run]
        if rest.any():
            yield "member", name.view(np.int64)[run[rest]], who[rest], 0, flag[rest]


#: Members of one component in a bucket are compared in pieces of about so many.
CHUNK = 1024
#: Members compared at once with all of a piece.
ROWS_AT_ONCE = 256
#: How often members of large buckets are tried with their nearest before all pairs that are still apart are.
TURNS = 6


def open_members(members: DataFrame, roots: DataFrame, sides: DataFrame) -> DataFrame:
    """Members (bucket, u, upper) of the buckets whose members are in several components, in pieces of bounded size.

    The members of a bucket's largest component are dealt over pieces and the others go to every piece: so each two of
    different components meet, members of one component need not, and no piece grows with the bucket.
    """
    rooted = members.join(roots, members["u"] == roots["node"], "left").select("bucket", "u", "upper", F.coalesce("root", "u").alias("root"))
    kinds = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    split = kinds.groupBy("bucket").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("c", "root"))["root"].alias("main")).where("kinds > 1")
    split = split.select("bucket", "main", F.ceil(F.col("size") / CHUNK).cast("int").alias("pieces"))
    rows = rooted.join(split, "bucket").join(sides, rooted["u"] == sides["key"]).drop("key")
    rows = rows.withColumn("home", F.pmod(F.xxhash64("u"), F.col("pieces")).cast("int")).withColumn("other", F.col("root") != F.col("main"))
    piece = F.when(F.col("other") & (F.col("pieces") > 1), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array("home"))
    rows = rows.select("bucket", F.explode(piece).alias("piece"), "home", "u", "root", "upper", "other", "n", "sketch")
    return rows.withColumn("own", F.col("home") == F.col("piece")).drop("home")


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches (a power of two of 64-bit words each) as a matrix of the shortest one's width: halves laid over each other."""
    width = min(map(len, sketches))

    def fold(s: np.ndarray) -> np.ndarray:
        while len(s) > width:
            s = s[: len(s) // 2] ^ s[len(s) // 2 :]
        return s

    return np.stack([fold(np.asarray(s)) for s in sketches]).view(np.uint64)


def piece_pairs(sketch: np.ndarray, n: np.ndarray, u: np.ndarray, root: np.ndarray, other: np.ndarray, own: np.ndarray, upper: np.ndarray, may: Callable, turn: int | None) -> Iterator[pd.DataFrame]:
    """Pairs of one piece that may link (by may(n, m, flips)) and are in different components: all, or, in a turn, for each
    member that is not of the largest one the nearest (from turn 1 on among half of the others, by hash)."""
    which = np.flatnonzero(other)
    for a in range(0, len(which), ROWS_AT_ONCE):
        i = which[a : a + ROWS_AT_ONCE]
        flips = np.zeros((len(i), len(u)), np.int64)
        for w in range(sketch.shape[1]):
            flips += np.bitwise_count(sketch[i, w][:, None] ^ sketch[:, w][None, :])
        ahead = u[i][:, None] < u[None, :]
        here = ~other[None, :] | np.where(ahead, own[i][:, None], own[None, :])  # two that go everywhere: at home with the smaller
        good = may(n[i][:, None], n[None, :], flips) & (root[i][:, None] != root[None, :]) & ~(upper[i][:, None] & upper[None, :]) & here
        if turn is not None:
            if turn:
                good &= mix64((u[i][:, None] ^ u[None, :]).view(np.uint64) + np.uint64(turn)) & np.uint64(1) == 0
            flips[~good] = 1 << 40
            j, x = flips.argmin(1), np.flatnonzero(good.any(1))
            j = j[x]
        else:
            x, j = np.nonzero(good & (~other[None, :] | ahead))
        if len(x):
            yield pd.DataFrame({"u": u[i][x], "v": u[j], "flips": flips[x, j]})


def compared(may: Callable, turn: int | None):
    """Of open_members, the pairs (u, v, flips) to verify. Pieces lie together; they are read one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def ready(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            bucket, piece, n, u, root = (rows[c].to_numpy() for c in ("bucket", "piece", "n", "u", "root"))
            other, own, upper = (rows[c].to_numpy(bool) for c in ("other", "own", "upper"))
            sketches = rows["sketch"].tolist()
            whole = folded(sketches) if len({len(s) for s in sketches}) == 1 else None
            edge = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (piece[1:] != piece[:-1]), True])
            found = []
            for x, y in zip(edge, edge[1:]):
                sketch = folded(sketches[x:y]) if whole is None else whole[x:y]
                found += piece_pairs(sketch, n[x:y], u[x:y], root[x:y], other[x:y], own[x:y], upper[x:y], may, turn)
                if len(found) > 500:
                    yield pd.concat(found)
                    found = []
            if found:
                yield pd.concat(found)

        for b in batches:
            if not len(b):
                continue
            bucket, piece = b["bucket"].to_numpy(), b["piece"].to_numpy()
            begins = np.flatnonzero((bucket[1:] != bucket[:-1]) | (piece[1:] != piece[:-1])) + 1
            if held and (held[-1]["bucket"].iloc[-1], held[-1]["piece"].iloc[-1]) != (bucket[0], piece[0]):
                yield from ready(pd.concat(held))
                held = []
            if len(begins):
                yield from ready(pd.concat([*held, b.iloc[: begins[-1]]]))
                held, b = [], b.iloc[begins[-1] :]
            held.append(b)
        if held:
            yield from ready(pd.concat(held))

    return run


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs (u, v) of different roots."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    return pairs.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")


def connected(tried: DataFrame, members: DataFrame, sides: DataFrame, may: Callable, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the components that links among the candidates make.

    tried: a written table of candidate pairs (u, v, flips); members: (bucket, u, upper), of which all two of a bucket
    are candidates; sides: key, n, sketch. verified keeps the links of a table of pairs. First each u is tried with its
    nearest, then all pairs that are still apart; then the same with the members of buckets that may link by may, in
    TURNS turns at most, as long as many of the nearest link.
    """
    spark = sides.sparkSession
    links = verified(settle(tried.groupBy("u").agg(F.min_by("v", F.struct("flips", "v")).alias("v")), "nearest"))
    rest = settle(between(tried, components(links)).join(links, ["u", "v"], "left_anti"), "between")
    links = settle(links.unionByName(verified(rest)), "links")
    turn: int | None = 0
    while True:
        roots = components(links)
        rows = open_members(members, roots, sides).repartition(partitions(spark), "bucket", "piece").sortWithinPartitions("bucket", "piece")
        pairs = rows.mapInPandas(giving_back(compared(may, turn)), "u long, v long, flips long")
        if turn is not None:
            pairs = pairs.groupBy("u").agg(F.min_by("v", F.struct("flips", "v")).alias("v"))
        pairs = settle(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        tried = pairs.count()
        if not tried and not turn:
            return roots
        found = verified(pairs)
        links = settle(links.unionByName(found), "links")
        if turn is None:
            return components(links)
        turn = turn + 1 if turn + 1 < TURNS and 10 * found.count() >= tried > 0 else None
