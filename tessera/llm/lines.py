"""Fuzzy line deduplication.

Lines are normalised to words and equal ones are one entry. Entries whose edit similarity over words is 0.8 or more link,
and every such pair is found by a prefix filter: each line is listed by the first of its pairs of words in a row, in one
order of all pairs, by so many that no t edits touch all of them (see prefix_lengths); so lines that are alike share one.
The order is from rare to common as far as a sample tells; what is found does not depend on it. Members of a bucket are
candidates where lengths and places allow it and the parities of their words (each edit flips two bits at most) do; these
are exact bounds. One occurrence of each connected group stays: the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import connected
from .common import BROADCAST_ROWS, BYTES_DOWN, blocks, common_ones, free, giving_back, hashed_runs, looked_up, mix64, no_links, partitions, sample_of, settle, small
from .components import components, forest, smallest

#: HAMMING, PAIR_HAMMING: SimHashes are no bound any more, all 64 bits may differ.
MIN_WORDS, HAMMING, PAIR_HAMMING, PERCENT = 1, 64, 64, 80
#: Lines of fewer words are alike only if they are equal.
NEAR_WORDS = -(-100 // (100 - PERCENT)) - 1
#: Between words of a line: ASCII that is neither letter nor digit.
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: For bytes.translate: 1 for these, 0 for others.
PARTED = BETWEEN.astype(np.uint8).tobytes()
#: Beyond ASCII: spaces and punctuation, which part words too, and letters of scripts without spaces, each a word.
GAPS = re.compile("[\u00a0\u00ab\u00bb\u2000-\u206f\u3000-\u3004\u3008-\u3020\u3030\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
#: What is below U+0800 of these, in UTF-8; all others begin with a byte of 0xE0 or more.
LOW_GAPS = b"\xc2\xa0", b"\xc2\xab", b"\xc2\xbb"
#: Bits of a parity, in longs; larger buckets than ALL_PAIRS are not compared in one task, but tried by stars first.
PARITY, ALL_PAIRS = 4, 4096
#: Lines of so many words and more hold their parity from the first: the fewer bits of a bucket tell shorter ones apart.
LONG = 100
BLOCK_BYTES = 1_500_000
#: For each byte, its bits as counters of 8 bits.
SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b) for b in range(8))


def simhash(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of runs of words: bit b is set where more than half of the words' hashes have it."""
    out = np.zeros(len(first), np.uint64)
    if not len(words):
        return out
    # runs of up to 255 words fit the counters; longer ones are summed in such pieces
    pieces = -(-n // 255)
    run = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + 255 * nth
    whole = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for byte in range(8):
        sums = np.add.reduceat(SPREAD[(words >> np.uint64(8 * byte)) & np.uint64(0xFF)], begin)
        for b in range(8):
            count = np.add.reduceat((sums >> np.uint64(8 * b)) & np.uint64(0xFF), whole).astype(np.int64)
            out |= (2 * count > n).astype(np.uint64) << np.uint64(8 * byte + b)
    return out


def entry_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, first word, words, all word hashes) of the lines with MIN_WORDS words or more; their words lie together."""
    whole = b"\n".join([*texts, b""])
    raw = np.frombuffer(whole, np.uint8)
    if not len(raw):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    stops = np.flatnonzero(raw == 0x0A)
    words, first = hashed_runs(raw, np.frombuffer(whole.translate(PARTED), bool))
    n = np.diff(np.searchsorted(first, stops), prepend=0)
    of = np.searchsorted(ends, stops, side="right")
    nth = np.arange(len(stops)) - np.searchsorted(stops, np.r_[0, ends[:-1]])[of]
    keep = n >= MIN_WORDS
    return of[keep], nth[keep], np.cumsum(n[keep]) - n[keep], n[keep], words if n[~keep].sum() == 0 else words[np.repeat(keep, n)]


def line_keys(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits of each line's words in order, as int64."""
    if not len(words):
        return np.zeros(0, np.int64)
    place = (np.arange(len(words)) - np.repeat(first, n)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(mix64(words ^ mix64(place)), first) + n.astype(np.uint64)).view(np.int64)


def lowered(rows: pd.DataFrame) -> list[bytes]:
    plain = lambda t: t.isascii() or np.frombuffer(t, np.uint8).max() < 0xE0 and not (LOW_GAPS[0][:1] in t and any(x in t for x in LOW_GAPS))
    spaced = lambda t: t if plain(t) else UNSPACED.sub(r" \1 ", GAPS.sub(" ", t.decode())).encode()
    return [spaced(t).translate(BYTES_DOWN) for t in rows["text"]]


def word_pairs(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each word and the next of its line; the last word stands with none."""
    follow = np.r_[words[1:], np.zeros(min(1, len(words)), np.uint64)]
    follow[first + n - 1] = 0
    return mix64(words ^ (follow << np.uint64(1)) ^ (follow >> np.uint64(63)))


def parities(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of runs of words: 64 * PARITY bits, each set where an odd number of words fall on it."""
    out = np.zeros((len(first), PARITY), np.uint64)
    if len(words):
        bit = np.uint64(1) << (words & np.uint64(63))
        where = (words >> np.uint64(6)) % np.uint64(PARITY)
        for i in range(PARITY):
            out[:, i] = np.bitwise_xor.reduceat(np.where(where == i, bit, np.uint64(0)), first)
    return out


def list_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in blocks(batches, BLOCK_BYTES):
        text, line, first, n, words = entry_lines(lowered(rows))
        far, bits = n >= LONG, np.full(len(n), None, object)
        long = n[far]
        for i, own in zip(np.flatnonzero(far), parities(words[np.repeat(far, n)], np.cumsum(long) - long, long).view(np.int64)):
            bits[i] = own
        yield pd.DataFrame({"doc_id": rows["doc_id"].iloc[text].to_numpy(), "text_hash": rows["text_hash"].to_numpy()[text], "line": line, "key": line_keys(words, first, n), "n": n, "bits": bits})


def count_things(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in blocks(batches, BLOCK_BYTES):
        _, _, first, n, words = entry_lines(lowered(rows))
        thing, count = np.unique(word_pairs(words, first, n), return_counts=True)
        yield pd.DataFrame({"thing": thing.view(np.int64), "c": count})


def edits_allowed(n):
    return (100 - PERCENT) * n // 100


#: Steps by which each line's prefix is narrowed; any number of them finds the same pairs.
NARROWED = 5


def edits_to_touch(chosen: np.ndarray, first: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Fewest edits of each line that touch all chosen word pairs: one edit touches two neighbours at most."""
    at = np.flatnonzero(chosen)
    starts = np.r_[True, at[1:] != at[:-1] + 1][: len(at)] | (at == begin[at])
    nth = np.arange(len(at))
    nth -= np.maximum.accumulate(np.where(starts, nth, 0))
    return np.diff(np.searchsorted(at[nth & 1 == 0], np.r_[first, len(chosen)]))


def prefix_lengths(nth: np.ndarray, first: np.ndarray, n: np.ndarray, line: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many of its word pairs, in the order nth, each line is listed by.

    Take a line of n words and one of m words, m >= n, with t(m) edits at most. If the lists share no pair, then all k
    pairs of one list are touched by edits: that of the line whose list ends first in the order of all. A list is long
    enough if that takes more than t(m) edits for any m: either as pairs that lie apart take more edits, or by number, as
    m - n of the edits insert and touch one pair each, which leaves 2 t(m) - (m - n) pairs. (The longer line loses m - n
    words, each of which touches two; for it m = n is the case that counts.)
    """
    longer = np.arange(int(n.max()) * 100 // (100 - PERCENT) + 200)
    shared = np.minimum.accumulate((longer - 2 * edits_allowed(longer))[::-1])[::-1]  # with a line of so many words or more
    low, high = edits_allowed(n), n - np.maximum(shared[n], 1) + 1
    for _ in range(NARROWED):
        mid = (low + high) // 2
        touched = edits_to_touch(nth < mid[line], first, begin)
        from_m = np.maximum(n, -(-100 * touched // (100 - PERCENT)))  # lines from which on so many edits are allowed
        enough = mid > np.maximum(n - shared[from_m], 0)
        low, high = np.where(enough, low, mid), np.where(enough, mid, high)
    return np.where(n >= NEAR_WORDS, high, 0)


def prefixes(words: np.ndarray, first: np.ndarray, n: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(line, word pair, its first and last place): distinct pairs of each line of which lines that are alike have one in
    common that no edit touches."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair, line, begin = word_pairs(words, first, n), np.repeat(np.arange(len(n)), n), np.repeat(first, n)
    rank = looked_up(pair, common).astype(np.uint64)
    order = np.argsort(line.astype(np.uint64) << np.uint64(40) | rank << np.uint64(32) | pair & np.uint64(0xFFFFFFFF), kind="stable")
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - begin
    take = prefix_lengths(nth, first, n, line, begin)
    place, pair = order - begin, pair[order]
    head = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (line[1:] != line[:-1])])
    tail = np.r_[head[1:], len(pair)] - 1
    kept = head - begin[head] < take[line[head]]
    head, tail = head[kept], tail[kept]
    return line[head], pair[head], place[head], place[tail]


#: What a bucket knows of a member: a word pair's lower half, words, first place of the pair and how far to its last, entry, 120 bits of parity.
ROW = np.dtype([("pair", "u4"), ("n", "u2"), ("lo", "u2"), ("span", "u1"), ("key", "i8"), ("few", "u8"), ("more", "u8")])
CAP, SPAN, FEW, MORE = 65535, 255, 64, 56
#: Pairs compared at a time, pairs of the buckets that are worked on together, and links held before they are thinned to a forest.
PAIRS_AT_ONCE, RUN_PAIRS, LINKS_AT_ONCE = 100_000, 1_000_000, 1_000_000
#: Members with no more links than this hand on all of them.
FEW_LINKS = 3

#: Bytes of a ROW that are handed on; the last ones of its parity are zero.
WIDTH = ROW.itemsize - (64 - MORE) // 8


def to_planes(rows: np.ndarray) -> bytes:
    """ROWs by bytes: all first bytes, all second ones, and so on, as high bytes and those of parities of few words are
    mostly zero and compress. Pairs are told by their gaps, which are small where rows are sorted by them."""
    gaps = rows.copy()
    gaps["pair"][1:] -= rows["pair"][:-1]
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, ROW.itemsize)[:, :WIDTH].T).tobytes()


def of_planes(raw: bytes) -> np.ndarray:
    planes = np.zeros((ROW.itemsize, len(raw) // WIDTH), np.uint8)
    planes[:WIDTH] = np.frombuffer(raw, np.uint8).reshape(WIDTH, -1)
    rows = np.ascontiguousarray(planes.T).view(ROW).ravel()
    rows["pair"] = np.cumsum(rows["pair"], dtype=np.uint32)
    return rows


def may_be_alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on edits of members of one bucket, a no longer than b: by length, by what lies before and behind the pair, by
    parity; and how many bits of it differ. Words put in or taken out are as many as the lengths and places differ, at
    least, and flip one bit each; other edits flip two."""
    n, m = a["n"].astype(np.int32), b["n"].astype(np.int32)
    most, short = edits_allowed(m), m - n
    low, high = ([x["lo"].astype(np.int32) for x in (a, b)], [np.where(x["span"] == SPAN, np.int32(CAP), x["lo"].astype(np.int32) + x["span"]) for x in (a, b)])
    after = low[0] - high[1]
    ahead = low[1] - high[0] - short
    moved = short + 2 * np.maximum(0, np.maximum(after, ahead))
    flips = np.bitwise_count(a["few"] ^ b["few"]).astype(np.int32) + np.bitwise_count(a["more"] ^ b["more"])
    return (short <= most) & ((m == CAP) | ((moved <= most) & (flips <= 2 * most - moved))), flips


def index(parts: int, shared):
    """(part, rows): members of buckets as ROW."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in blocks(batches, BLOCK_BYTES):
            _, _, first, n, words = entry_lines(lowered(rows))
            key = line_keys(words, first, n)
            line, pair, lo, hi = prefixes(words, first, n, shared.value)
            bit = words % np.uint64(FEW + MORE)
            one = np.uint64(1) << (bit & np.uint64(FEW - 1))
            few, more = (np.bitwise_xor.reduceat(np.where((bit < FEW) == x, one, np.uint64(0)), first) if len(words) else one for x in (True, False))
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True
            if not once.all():
                line, pair, lo, hi = (x[once[line]] for x in (line, pair, lo, hi))
            to = (pair >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | pair & np.uint64(0xFFFFFFFF)
            order = np.argsort(to)
            to, at, own = to[order], line[order], np.empty(len(order), ROW)
            own["pair"], own["n"], own["key"] = to & np.uint64(0xFFFFFFFF), np.minimum(n, CAP)[at], key[at]
            own["lo"], own["span"] = np.minimum(lo, CAP)[order], np.minimum(hi - lo, SPAN)[order]
            own["few"], own["more"] = few[at], more[at]
            edge = np.searchsorted(to, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            yield pd.DataFrame([(p, to_planes(own[a:b])) for p, (a, b) in enumerate(zip(edge, edge[1:])) if b > a], columns=["part", "rows"])

    return run


def alike_lengths(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """With how many of those behind it each member of buckets, sorted by bucket and length, may be alike by length."""
    n, of = rows["n"].astype(np.int64), np.repeat(np.arange(len(size)), size)
    last = np.searchsorted(of << 17 | (n - edits_allowed(n)), of << 17 | n, side="right")
    return last - np.arange(len(n)) - 1


def near_in_buckets(rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Links (i, j, flips) between each of rows and the count behind it that may be alike, and whether these are all; if
    there are many, they are so many that each reaches the same."""
    begin = np.cumsum(count) - count
    held, total, whole = [np.zeros((3, 0), np.int32)], 0, True  # links are held by the million: half as many bytes
    for a in range(0, int(count.sum()), PAIRS_AT_ONCE):
        b = min(a + PAIRS_AT_ONCE, int(count.sum()))
        x, y = np.searchsorted(begin, [a, b - 1], side="right") - 1
        take = np.minimum(begin[x : y + 1] + count[x : y + 1], b) - np.maximum(begin[x : y + 1], a)
        i = np.repeat(np.arange(x, y + 1, dtype=np.int32), np.maximum(take, 0))
        j = (np.arange(a, b) - begin[i] + i + 1).astype(np.int32)
        good, flips = may_be_alike(rows[i], rows[j])
        held.append(np.stack([i[good], j[good], flips[good]]))
        total += held[-1].shape[1]
        if total > LINKS_AT_ONCE:
            links, held, whole = np.concatenate(held, 1), [], False
            held.append(links[:, forest(*links, len(rows))])
            del links
            total = held[0].shape[1]
    return *np.concatenate(held, 1), whole


def of_few(i: np.ndarray, j: np.ndarray, nodes: int) -> np.ndarray:
    """Which of the links (i, j) one has that is left with FEW_LINKS at most, once those found before are taken away."""
    few, live = np.zeros(len(i), bool), np.arange(len(i))
    while len(live):
        degree = np.bincount(i[live], minlength=nodes) + np.bincount(j[live], minlength=nodes)
        low = np.minimum(degree[i[live]], degree[j[live]]) <= FEW_LINKS
        if not low.any():
            break
        few[live[low]] = True
        live = live[~low]
    return few


def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """pair: (u, v) that may be alike, with the bits in which they differ as bucket; member: (bucket, u), whose pairs may
    be alike too, and the least of them.

    In a bucket links of members with few are given as pairs, all of them, and the members taken away, and so on. Those
    that stay are in groups; each reaches all of its group by pairs that are given: if these are alike, nothing is left to
    ask. Otherwise the members are there. Buckets larger than ALL_PAIRS are given whole, with each member beside one.
    """
    by_part: dict[int, list] = {}
    for b in batches:
        for p, rows in zip(b["part"], b["rows"]):
            by_part.setdefault(p, []).append(of_planes(rows))
    b = rows = None  # packed rows are tens of MB
    for p in sorted(by_part):
        rows = np.concatenate(by_part.pop(p))
        if not len(rows):
            continue
        order = rows["pair"].astype(np.uint64) << np.uint64(32) | rows["n"].astype(np.uint64) << np.uint64(16) | (rows["key"] & 0xFFFF).astype(np.uint64)
        at = np.argsort(order)
        pair = rows["pair"][at]
        again = np.r_[pair[1:] == pair[:-1], False]
        at = at[again | np.r_[False, again[:-1]]]  # buckets of one are left out
        if not len(at):
            continue
        pair, key = rows["pair"][at], rows["key"][at]
        rows = rows[at[np.r_[True, (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])]]]
        del order, at, again, pair, key
        first = np.flatnonzero(np.r_[True, rows["pair"][1:] != rows["pair"][:-1]])
        size = np.diff(np.r_[first, len(rows)])
        us, vs, bits, names, least_of, members, seen = [], [], [], [], [], [], set()
        for a, k in zip(first[size > ALL_PAIRS], size[size > ALL_PAIRS]):
            own, length = rows["key"][a : a + k], rows["n"][a : a + k].astype(np.int64)
            least = np.searchsorted(length, length - edits_allowed(length))
            far = np.flatnonzero(least < np.arange(k))
            good, flips = may_be_alike(rows[a + least[far]], rows[a + far])
            far = far[good]
            bits.append(flips[good])
            us.append(own[far])
            vs.append(own[least[far]])
            who = np.sort(own)
            if (same := who.tobytes()) not in seen:
                seen.add(same)
                names.append(np.full(k, mix64(who.view(np.uint64)).sum().view(np.int64)))
                least_of.append(np.full(k, who[0]))
                members.append(who)
        held = (size > 1) & (size <= ALL_PAIRS)
        rows, size = rows[np.repeat(held, size)], size[held]
        own, node = np.unique(rows["key"], return_inverse=True)
        count, stop = alike_lengths(rows, size), np.cumsum(size)
        of_run = np.cumsum(np.add.reduceat(count, stop - size)) // RUN_PAIRS if len(size) else size
        edge = np.r_[0, stop[np.flatnonzero(np.r_[of_run[1:] != of_run[:-1], True])]] if len(size) else [0]
        links = [np.zeros((3, 0), np.int64)]
        for a, b in zip(edge, edge[1:]):
            i, j, flips, whole = near_in_buckets(rows[a:b], count[a:b])
            few = of_few(i, j, b - a) & whole
            us.append(own[node[a + i[few]]])
            vs.append(own[node[a + j[few]]])
            bits.append(flips[few])
            i, j, flips = i[~few], j[~few], flips[~few]
            if not len(i):
                continue
            group = smallest(i, j, np.arange(b - a))
            at = np.flatnonzero(np.bincount(group, minlength=b - a)[group] > 1)
            at = at[np.argsort(group[at], kind="stable")]
            begin = np.flatnonzero(np.r_[True, group[at][1:] != group[at][:-1]])
            k = np.diff(np.r_[begin, len(at)])
            name = np.add.reduceat(mix64(rows["key"][a + at].view(np.uint64)), begin)
            once = np.zeros(len(begin), bool)
            once[np.unique(name, return_index=True)[1]] = True
            once &= k > 2
            names.append(np.repeat(name[once], k[once]).view(np.int64))
            least_of.append(np.repeat(np.minimum.reduceat(rows["key"][a + at], begin)[once], k[once]))
            members.append(rows["key"][a + at[np.repeat(once, k)]])
            kept = forest(i, j, flips, b - a)
            links.append(np.stack([node[a + i[kept]], node[a + j[kept]], flips[kept]]))
        x, y, cost = np.concatenate(links, 1)
        kept = forest(x, y, cost, len(own))
        us.append(own[x[kept]])
        vs.append(own[y[kept]])
        bits.append(cost[kept])
        u, v, flips = np.concatenate(us), np.concatenate(vs), np.concatenate(bits)
        u, v, flips = u[u != v], v[u != v], flips[u != v]  # a line may be twice in a bucket, if its key's lower bits are another's too
        if len(u):
            u, v = np.maximum(u, v), np.minimum(u, v)
            order = np.lexsort((v, u))
            u, v, flips = u[order], v[order], flips[order]
            once = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
            yield pd.DataFrame({"kind": "pair", "bucket": flips[once].astype(np.int64), "u": u[once], "v": v[once]})
        if any(map(len, members)):
            yield pd.DataFrame({"kind": "member", "bucket": np.concatenate(names), "u": np.concatenate(members), "v": np.concatenate(least_of)})


def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the texts' lines that are asked for (places), key, words, how many and their parity."""
    for rows in blocks(batches, BLOCK_BYTES):
        asked = [b"\n".join([lines[x] for x in places]) for lines, places in zip((t.split(b"\n") for t in rows["text"]), rows["places"])]
        _, _, first, n, words = entry_lines(lowered(pd.DataFrame({"text": asked})))
        sketch = [*parities(words, first, n).view(np.int64)]
        yield pd.DataFrame({"key": line_keys(words, first, n), "words": [words[a : a + k].tobytes() for a, k in zip(first, n)], "n": n, "sketch": sketch})


def edits(a: list[int], b: list[int]) -> int:
    """Levenshtein distance, a whole row of it in one integer's bits at a time (Myers; Hyyro)."""
    if not a:
        return len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diag | up)), up & diag
        score += bool(right & top) - bool(left & top)
        right = right << 1 | 1
        up = full & ((left << 1) | ~(diag | right))
        down = full & right & diag
    return score


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the edit similarity is PERCENT or more: bounds first, then the distance of what lies between equal ends."""
    most = (100 - PERCENT) * max(len(a), len(b)) // 100
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) == len(b) and np.count_nonzero(a != b) <= most:
        return True
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    head = int(unlike[0]) if len(unlike) else n
    unlike = np.flatnonzero(a[len(a) - (n - head) :][::-1] != b[len(b) - (n - head) :][::-1])
    tail = int(unlike[0]) if len(unlike) else n - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if max(len(a), len(b)) <= most:
        return True
    if len(a) > 64 and max(len(a), len(b)) - shared(a, b) > most:
        return False
    return edits(a.tolist(), b.tolist()) <= most


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many words of a have one of their own in b."""
    words, of = np.unique(np.r_[a, b], return_inverse=True)
    return int(np.minimum(np.bincount(of[: len(a)], minlength=len(words)), np.bincount(of[len(a) :], minlength=len(words))).sum())


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b["x"], b["y"])]
        yield b.loc[np.array(good, bool), ["u", "v"]]


def asked_words(needed: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """key, words, n, sketch of the entries in needed, a written table of keys."""
    near = small(needed)
    rep = F.col("first.doc_id").cast("string").alias("__d"), F.col("first.text_hash").alias("__h")
    reps = small(settle(known.join(near, "key", "left_semi").groupBy(*rep).agg(F.collect_set("first.line").alias("places")), "reps"))
    texts = docs.join(reps, docs["doc_id"].eqNullSafe(reps["__d"]) & (docs["text_hash"] == reps["__h"]))
    return settle(texts.select("text", "places").mapInPandas(giving_back(words_of), "key long, words binary, n int, sketch array<long>").dropDuplicates(["key"]), "words")


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Of distinct pairs (u, v) of entries, a written table, those that are alike."""
    if pairs.isEmpty():
        return no_links(pairs.sparkSession)
    side = lambda k, w: words.select(F.col("key").alias(k), F.col("words").alias(w))
    if pairs.count() > BROADCAST_ROWS:
        both = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v")
    else:  # only words that are needed are shuffled
        both = F.broadcast(pairs).join(side("u", "x"), "u").join(F.broadcast(pairs).join(side("v", "y"), "v"), ["u", "v"])
    return settle(both.mapInPandas(verify, "u long, v long"), "linked")


def merged(members: DataFrame) -> DataFrame:
    """bucket, u, upper: of members (bucket, u, and v, the least of the bucket), a written table, those of buckets that reach
    each other in one bucket, each once, where that makes fewer pairs than the buckets have together."""
    reached = components(members.select("u", "v"))
    own = members.groupBy("bucket", "v").agg(F.count(F.lit(1)).alias("c"))
    own = own.join(reached, F.col("v") == F.col("node"), "left").select("bucket", F.coalesce("root", "v").alias("name"), "c")
    apart = own.groupBy("name").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    whole = reached.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("c"))
    fewer = settle(apart.join(whole, F.col("name") == F.col("root")).where("c * c <= pairs").select("name"), "fewer")
    once = reached.join(small(fewer), F.col("root") == F.col("name"), "left_semi")
    once = once.select(F.col("root").alias("bucket"), F.col("node").alias("u")).union(fewer.select("name", "name"))
    rest = members.join(own.join(small(fewer), "name", "left_anti"), "bucket", "left_semi").select("bucket", "u")
    return settle(once.union(rest).select("bucket", "u", F.lit(False).alias("upper")), "merged")


def may_be_near(n: np.ndarray, m: np.ndarray, flips: np.ndarray) -> np.ndarray:
    most = edits_allowed(np.maximum(n, m))
    return (np.abs(n - m) <= most) & (flips + np.abs(n - m) <= 2 * most)


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, lines (places from 0 of the lines to drop): documents that have any."""
    spark = docs.sparkSession
    kind, parts = docs.schema[doc_id].dataType.simpleString(), partitions(spark)
    # ids go through Python as strings, which are exact beside nulls
    rows = docs.select(docs[doc_id].cast("string").alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("text"))
    listed = settle(rows.mapInPandas(giving_back(list_lines), "doc_id string, text_hash long, line int, key long, n int, bits array<long>"), "lines")
    place = F.struct(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash", "line")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), place.alias("place")))["place"]
    known = settle(listed.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "bits")), first.alias("first")), "entries")
    shared = spark.sparkContext.broadcast(common_ones(sample_of(rows, "text_hash").mapInPandas(count_things, "thing long, c long")))
    dealt = rows.mapInPandas(giving_back(index(parts, shared)), "part int, rows binary").repartitionById(parts, F.col("part"))
    found = settle(dealt.mapInPandas(giving_back(buckets), "kind string, bucket long, u long, v long"), "buckets", packed=True)
    shared.destroy()
    side = lambda u, x: known.select(F.col("key").alias(u), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "bits")))
    most = (F.lit(100 - PERCENT) * F.greatest("x_n", "y_n") / 100).cast("int")
    flips = sum((F.bit_count(F.col("x_bits")[i].bitwiseXOR(F.col("y_bits")[i])) for i in range(PARITY)), F.lit(0))
    short = F.abs(F.col("x_n") - F.col("y_n"))
    tried = found.where("kind = 'pair'").select("u", "v", F.col("bucket").alias("flips")).distinct().join(side("u", "x"), "u").join(side("v", "y"), "v")
    # shorter lines are without bits: what their bucket knew of them has told them apart
    tried = settle(tried.where((short <= most) & (F.coalesce(flips, F.lit(0)) + short <= 2 * most)).select("u", "v", "flips"), "tried")
    members = merged(settle(found.where("kind = 'member'").select("bucket", "u", "v").distinct(), "members"))
    needed = tried.select(F.explode(F.array("u", "v")).alias("key")).union(members.select(F.col("u").alias("key"))).distinct()
    words = asked_words(settle(needed, "needed"), known, rows)
    final = connected(tried, members, words.select("key", "n", "sketch"), may_be_near, lambda pairs: verified(pairs, words))
    # entries that are alone keep their first occurrence; of a group the first of all does
    grouped = settle(final.unionByName(final.select(F.col("root").alias("node"), "root").distinct()), "grouped")
    rooted = settle(known.join(small(grouped), known["key"] == grouped["node"]).select("key", "root", "first"), "rooted")
    order = lambda c: F.struct(F.col(f"{c}.doc_id").isNull().alias("none"), F.col(c).alias("place"))
    least = settle(rooted.groupBy(F.col("root").alias("r")).agg(F.min(order("first"))["place"].alias("keep")), "least")
    keep = settle(rooted.join(small(least), F.col("root") == F.col("r")).select(F.col("key").alias("k"), "keep"), "keep")
    # only lines of entries in a group, or that occur again, can go
    kept = known.select("key", "first").join(small(keep), F.col("key") == F.col("k"), "left").select("key", F.coalesce("keep", "first").alias("keep"))
    drop = listed.join(kept, "key").where(~place.eqNullSafe(F.col("keep")))
    return drop.groupBy(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def without_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each group of alike lines left only where it first stands (least doc_id, null last, then text hash, then place).

    Lines are what line feeds part; only those without a word always stay. Words are letters, digits and all beyond
    ASCII but its spaces and punctuation, A-Z lower-cased; in scripts without spaces each letter is one. Null and empty
    texts stay as they are; long texts and lines are read whole. Rows that repeat a whole document are one document and
    lose the same lines. An empty table gives an empty one; all columns are kept. Two more count the lines that were and
    that went: __lines and __dropped, or with underscores before (common.free) where docs has columns of these names.
    """
    lines, dropped = free(docs, "__lines"), free(docs, "__dropped")
    d, h, gone = free(docs, "__d"), free(docs, "__h"), free(docs, "__l")
    found = settle(repeated(docs, doc_id=doc_id, text=text).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("lines").alias(gone)), "dropped")
    out = docs.join(small(found), docs[doc_id].eqNullSafe(F.col(d)) & (F.xxhash64(docs[text]) == F.col(h)), "left")
    rest = F.array_join(F.filter(F.split(docs[text], "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    count = F.when(docs[text].isNull(), 0).otherwise(F.octet_length(docs[text]) - F.octet_length(F.replace(docs[text], F.lit("\n"), F.lit(""))) + 1)
    went = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    return out.withColumns({lines: count.cast("long"), dropped: went.cast("long"), text: F.when(F.col(gone).isNull(), docs[text]).otherwise(rest)}).drop(d, h, gone)
