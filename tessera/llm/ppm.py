"""LM scoring by prediction by partial matching over bytes.

A document is coded as its class (its language), then byte by byte its words, each with a space after it, and an end. The
trie holds the contexts of up to ORDER bytes before each symbol, across words, back to the document's begin; the class is
its root symbol. Escapes are estimated by method D (half a count is taken from each symbol seen); symbols of the longer
contexts are excluded from the shorter ones; below order 0 all symbols left are alike.

Texts are cut into blocks. Each block counts its nodes (class, ORDER bytes of context, symbol), deals them to shards by
class and last two context bytes, gets back what each costs, and adds up its documents. All orders of two and more of a
context chain lie in one shard; orders 1 and 0 have at most CLASSES x SYMBOLS x SYMBOLS nodes and go to every task.
Words are counted for the base score in the same way, as 64-bit hashes. A shard holds its blocks' nodes compressed and
the distinct ones as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTES_DOWN, hashed_runs, mix64, partitions, settle

ORDER, CLASSES = 6, 63
#: No word holds these bytes: what follows a word, the end of a text, and the place before its begin.
SPACE, END, PAD = 0x20, 0x09, 0x0A
#: What stands before a text.
BEGIN = bytes([PAD] * (ORDER - 1) + [SPACE])
#: 256 bytes without the six of white space, with SPACE and END.
SYMBOLS = 252
#: Bytes of a block, and of a stretch of it, which is worked on at a time; a longer text is cut between two words, so
#: that only a longer word makes a longer stretch.
BLOCK, STRETCH = 12 << 20, 2 << 20
#: Keys of a shard that are gathered before they are summed up.
GATHER = 1 << 21
CLASS_BITS = np.uint64(0xFF << 56)


def mask(order: int) -> np.uint64:
    """The bits of a node of this order: its class, its context and its symbol."""
    return np.uint64((1 << (8 * (order + 1))) - 1) | CLASS_BITS


def nodes_of(stream: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The node of the highest order at each byte of the pieces but their first ORDER, which are context only."""
    node = stream.astype(np.uint64)
    for j in (1, 2, 4):  # each step doubles the bytes held; byte 7 is cut off below
        node[j:] |= node[:-j] << np.uint64(8 * j)
    node &= ~CLASS_BITS
    node |= np.repeat(classes.astype(np.uint64) << np.uint64(56), sizes)
    return node[coded(sizes)]


def stretches(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of about STRETCH bytes together: first piece, past the last, first byte, past the last."""
    ends = np.cumsum(sizes)
    piece = at = 0
    while piece < len(sizes):
        past = max(piece + 1, int(np.searchsorted(ends, at + STRETCH, side="right")))
        yield piece, past, at, int(ends[past - 1])
        piece, at = past, int(ends[past - 1])


def coded(sizes: np.ndarray) -> np.ndarray:
    out = np.ones(int(sizes.sum()), bool)
    starts = np.cumsum(sizes) - sizes
    for j in range(ORDER):
        out[starts + j] = False
    return out


def summed(nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(nodes, kind="stable")
    nodes, counts = nodes[order], counts[order]
    first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else np.zeros(0, np.int64)
    return nodes[first], (np.add.reduceat(counts, first) if len(nodes) else counts)


def look(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return i, table[i] == wanted


class Level:
    """The contexts of one order: count and number of symbols, and the nodes below them."""

    def __init__(self, nodes: np.ndarray, counts: np.ndarray):
        self.nodes, self.counts = nodes, counts
        of = nodes >> np.uint64(8)
        self.first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(nodes) else np.zeros(0, np.int64)
        self.contexts = of[self.first]
        self.n = (np.add.reduceat(counts, self.first) if len(nodes) else counts).astype(np.float64)
        self.kinds = np.diff(np.r_[self.first, len(nodes)]).astype(np.float64)


def levels(nodes: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None) -> list[Level]:
    """From ORDER down to 0. low: the nodes of order 1 of the whole corpus and their counts; None: these are all."""
    out = [Level(*summed(nodes[counts > 0], counts[counts > 0]))]
    for j in range(ORDER - 1, -1, -1):
        source = low if low is not None and j == 1 else (out[-1].nodes & mask(j), out[-1].counts)
        out.append(Level(*summed(*source)))
    return out


def costs(nodes: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each node's symbol in its context, as trained by the counts (0: not in training)."""
    logp, going = np.zeros(len(nodes)), np.arange(len(nodes))
    above: Level | None = None
    for j, level in zip(range(ORDER, -1, -1), levels(nodes, counts, low)):
        want = nodes[going] & mask(j)
        c, in_context = look(level.contexts, want >> np.uint64(8))
        s, seen = look(level.nodes, want)
        if len(level.contexts):
            n, kinds = level.n[c], level.kinds[c]
            if above is not None and len(above.contexts):  # without the symbols of the longer context
                own, _ = look(level.nodes, above.nodes & mask(j))
                gone = np.add.reduceat(level.counts[own], above.first)
                a, had = look(above.contexts, (nodes[going] & mask(j + 1)) >> np.uint64(8))
                n = n - np.where(had, gone[a], 0)
                kinds = kinds - np.where(had, above.kinds[a], 0)
            hit, escape = in_context & seen, in_context & ~seen & (n > 0)
            logp[going[hit]] += np.log10((2 * level.counts[s[hit]] - 1) / (2 * n[hit]))
            logp[going[escape]] += np.log10(kinds[escape] / (2 * n[escape]))
            going = going[~hit]
        above = level
    c, known = look(above.contexts, (nodes[going] & mask(0)) >> np.uint64(8))
    logp[going] -= np.log10(SYMBOLS - (np.where(known, above.kinds[c], 0) if len(above.contexts) else 0))
    return logp


def shard_of(nodes: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(((nodes >> np.uint64(8)) & np.uint64(0xFFFF)) | (nodes >> np.uint64(56) << np.uint64(16))) % np.uint64(shards)).astype(np.int64)


PIECE = np.dtype([("row", "i8"), ("size", "i8"), ("cls", "u1"), ("train", "u1"), ("last", "u1")])
ROWS = "block long, shard int, kind int, body binary, rows binary, ids array<string>"
COLUMNS = ["block", "shard", "kind", "body", "rows", "ids"]
#: kind of a row: nodes or words of a shard. shard of a row: texts of a block; nodes of order 1; number of words known.
NODES, WORDS = 0, 1
TEXTS, LOW, KNOWN = -1, -2, -3


def shut(values: np.ndarray) -> bytes:
    """Compressed, with the n-th bytes of all values together."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True) if raw else b"")


def opened(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def shut_costs(values: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct values, and which of these each is: most costs come many times."""
    distinct, at = np.unique(values, return_inverse=True)
    return shut(at.astype(np.int32)), shut(distinct)


def opened_costs(at: bytes, distinct: bytes) -> np.ndarray:
    return opened(distinct, np.float64)[opened(at, np.int32)]


def shut_keys(keys: np.ndarray) -> bytes:
    return shut(np.diff(keys, prepend=np.uint64(0)))


def opened_keys(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data, np.uint64), dtype=np.uint64)


def cut_text(text: bytes | None) -> list[bytes]:
    """The coded form of a text in pieces of about STRETCH bytes, each after the ORDER bytes before it."""
    body = b"".join([w for word in (text or b"").translate(BYTES_DOWN).split() for w in (word, b" ")]) + bytes([END])
    out, at, before = [], 0, BEGIN
    while at < len(body):
        past = len(body)
        if past - at > STRETCH:
            past = body.rfind(b" ", at, at + STRETCH) + 1 or (body.find(b" ", at) + 1 or len(body))
            past = len(body) if past == len(body) - 1 else past  # an end has company
        out.append(before + body[at:past])
        before, at = (BEGIN + body[max(0, past - ORDER) : past])[-ORDER:], past
    return out


def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents (doc_id, held_out, cls, t) to blocks of texts, and last a row with the nodes of order 1 in training."""
    part = TaskContext.get().partitionId()
    held, size, row, number = [], 0, 0, 0
    low = np.zeros((CLASSES + 1) << 16, np.int64)

    def block() -> pd.DataFrame:
        pieces = np.array([h[:5] for h in held], PIECE)
        data = b"".join(h[6] for h in held)
        stream = np.frombuffer(data, np.uint8)
        for a, z, i, j in stretches(pieces["size"]):
            sizes = pieces["size"][a:z]
            at = np.flatnonzero(coded(sizes) & np.repeat(pieces["train"][a:z] > 0, sizes))
            cls = np.repeat(pieces["cls"][a:z], sizes)[at].astype(np.int64)
            np.add.at(low, *np.unique((cls << 16) | (stream[i:j][at - 1].astype(np.int64) << 8) | stream[i:j][at], return_counts=True))
        return pd.DataFrame([((part << 32) + number, TEXTS, NODES, shut(stream), pieces.tobytes(), [h[5] for h in held])], columns=COLUMNS)

    for b in batches:
        for doc_id, out, cls, text in zip(b["doc_id"], b["held_out"], b["cls"], b["t"]):
            pieces = cut_text(text)
            for i, piece in enumerate(pieces):
                if held and size + len(piece) > BLOCK:
                    yield block()
                    held, size, number = [], 0, number + 1
                held.append(((part << 40) + row, len(piece), cls, not out, i == len(pieces) - 1, doc_id, piece))
                size += len(piece)
            row += 1
    if held:
        yield block()
        seen = np.flatnonzero(low)
        nodes = ((seen >> 16).astype(np.uint64) << np.uint64(56)) | (seen & 0xFFFF).astype(np.uint64)
        yield pd.DataFrame([((part << 32) + number, LOW, NODES, shut_keys(nodes), shut(low[seen]), None)], columns=COLUMNS)


class Counted:
    """The distinct keys of a block, in the order of shards, where each shard's begin, and for each place of its stretches the key."""

    def __init__(self, keys: Iterator[np.ndarray], shards: int, shard):
        self.at, found = [], []
        for k in keys:
            at, distinct = pd.factorize(k)
            self.at.append(at.astype(np.int32))
            found.append(distinct)
        distinct = np.concatenate([np.zeros(0, np.uint64), *found])
        distinct.sort()
        distinct = distinct[np.r_[True, distinct[1:] != distinct[:-1]]] if len(distinct) else distinct
        of = shard(distinct, shards)
        order = np.argsort(of, kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.keys = distinct[order]
        for i, at in enumerate(self.at):  # one by one, so that what was before can go
            by = np.argsort(found[i])
            own = np.empty(len(by), np.int32)
            own[by] = back[np.searchsorted(distinct, found[i][by])]
            self.at[i], found[i] = own[at], None
        self.begin = np.r_[0, np.cumsum(np.bincount(of, minlength=shards))]


def word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (words % np.uint64(shards)).astype(np.int64)


class Block:
    """The texts of a block: nodes and words, and for each of these, by stretches, its piece."""

    def __init__(self, body: bytes, rows: bytes, shards: int):
        self.pieces = np.frombuffer(rows, PIECE)
        self.stream, self.sizes = opened(body, np.uint8), self.pieces["size"]
        self.word_piece: list[np.ndarray] = []
        self.nodes = Counted((nodes_of(self.stream[i:j], self.sizes[a:z], self.pieces["cls"][a:z]) for a, z, i, j in stretches(self.sizes)), shards, shard_of)
        self.words = Counted(self.word_keys(), shards, word_shard)

    def word_keys(self) -> Iterator[np.ndarray]:
        for a, z, i, j in stretches(self.sizes):
            stream, sizes = self.stream[i:j], self.sizes[a:z]
            gap = (stream == SPACE) | (stream == END) | ~coded(sizes)
            words, first = hashed_runs(stream, gap) if not gap.all() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            self.word_piece.append((a + np.searchsorted(np.cumsum(sizes), first, side="right")).astype(np.int32))
            yield words

    def node_piece(self) -> Iterator[np.ndarray]:
        for a, z, *_ in stretches(self.sizes):
            yield np.repeat(np.arange(a, z, dtype=np.int32), self.sizes[a:z] - ORDER)

    def trained(self, some: Counted, pieces) -> np.ndarray:
        """How often each key is in training documents."""
        n, train = np.zeros(len(some.keys), np.int64), self.pieces["train"] > 0
        for at, piece in zip(some.at, pieces):
            n += np.bincount(at[train[piece]], minlength=len(n))
        return n.astype(np.int32)

    def summed(self, some: Counted, pieces, values: np.ndarray) -> np.ndarray:
        """The sum over each piece of its keys' values."""
        out = np.zeros(len(self.sizes))
        for at, piece in zip(some.at, pieces):
            if len(at):
                first = int(piece[0])
                got = np.bincount(piece - first, weights=values[at])
                out[first : first + len(got)] += got
        return out


def cut_blocks(shards: int):
    """Blocks of texts to one row of nodes and one of words for each shard: keys, and how often in training."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, body, rows in zip(b["block"], b["body"], b["rows"]):
                block, out = Block(body, rows, shards), []
                for kind, some, pieces in ((NODES, block.nodes, block.node_piece()), (WORDS, block.words, block.word_piece)):
                    n = block.trained(some, pieces)
                    out += [(name, s, kind, shut_keys(some.keys[i:j]), shut(n[i:j]), None) for s, (i, j) in enumerate(zip(some.begin, some.begin[1:])) if j > i]
                yield pd.DataFrame(out, columns=COLUMNS)

    return cut


def total(rows: Iterator[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the rows and their counts; no more than GATHER keys besides the distinct ones are open at a time."""
    keys, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for k, c in rows:
        keys.append(opened_keys(k))
        counts.append(opened(c, np.int32).astype(np.int64))
        size += len(keys[-1])
        if size > max(GATHER, len(keys[0])):
            one = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, size = [one[0]], [one[1]], 0
    return summed(np.concatenate(keys), np.concatenate(counts))


def score_shards(low):
    """Rows of shards to what each key costs (nodes), or how often it is in training (words)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for block, shard, kind, k, c in zip(b["block"], b["shard"], b["kind"], b["body"], b["rows"]):
                held.setdefault((shard, kind), []).append((block, k, c))
        for (shard, kind), rows in held.items():
            keys, counts = total((k, c) for _, k, c in rows)
            if kind == NODES:
                values = costs(keys, counts, low.value)
            else:
                values = counts.astype(np.float64)
                yield pd.DataFrame([(-1, KNOWN, WORDS, shut(np.array([np.count_nonzero(counts)])), None, None)], columns=COLUMNS)
            for i in range(0, len(rows), 64):
                some = [(block, shard, kind, *shut_costs(values[np.searchsorted(keys, opened_keys(k))]), None) for block, k, _ in rows[i : i + 64]]
                yield pd.DataFrame(some, columns=COLUMNS)

    return score


SUMS = "row long, doc_id string, held_out boolean, cls int, last boolean, words long, known long, base double, score double"


def merge_blocks(shards: int):
    """A block's texts and what its keys cost to sums of its pieces; the rows that tell of known words to one, of null row."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in SUMS.split(", ")]
        if rows["shard"].iloc[0] == KNOWN:
            return pd.DataFrame([(None, None, None, None, None, None, sum(int(opened(b, np.int64)[0]) for b in rows["body"]), None, None)], columns=names)
        head = rows[rows["shard"] == TEXTS].iloc[0]
        block = Block(head["body"], head["rows"], shards)
        cost, seen = np.zeros(len(block.nodes.keys)), np.zeros(len(block.words.keys))
        for s, kind, at, distinct in zip(rows["shard"], rows["kind"], rows["body"], rows["rows"]):
            if s >= 0:
                some, into = (block.nodes, cost) if kind == NODES else (block.words, seen)
                into[some.begin[s] : some.begin[s + 1]] = opened_costs(at, distinct)
        p, add = block.pieces, lambda values: block.summed(block.words, block.word_piece, values)
        return pd.DataFrame({
            "row": p["row"], "doc_id": list(head["ids"]), "held_out": p["train"] == 0, "cls": p["cls"].astype(np.int32), "last": p["last"] > 0,
            "words": add(np.ones(len(seen))).astype(np.int64), "known": add(seen > 0).astype(np.int64),
            "base": add(np.log10(seen + 1)), "score": block.summed(block.nodes, block.node_piece(), cost),
        })

    return merge


def low_orders(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of order 1 and their counts, of all blocks: at most CLASSES x SYMBOLS x SYMBOLS."""

    def opened_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, c in zip(b["body"], b["rows"]):
                yield pd.DataFrame({"node": opened_keys(k).view(np.int64), "n": opened(c, np.int64)})

    got = blocks.where(F.col("shard") == LOW).select("body", "rows").mapInPandas(opened_rows, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toPandas()
    return summed(got["node"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64))


def score_documents(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", label: str | None = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    held_out: a boolean over docs; documents where it is true are scored but not learnt from. score is the log10
    probability of class, words and end; base_score that of words and end by smoothed counts. A null text is empty and costs its class and end; a null class is one of its own; a null held_out
    is false. Ids are of a type that text can be cast to. Rows that repeat count each time and are returned each time.
    Texts of any length are read whole; runs of white space count as one space. Without training documents all symbols
    are alike. An empty table gives an empty one. Other columns are not read.
    """
    spark, shards = docs.sparkSession, partitions(docs.sparkSession)
    cls = F.lit(0)
    if label:  # the commonest labels are classes of their own, the others share the last one
        names = [r["c"] for r in docs.groupBy(docs[label].cast("string").alias("c")).count().orderBy(F.desc("count"), "c").limit(CLASSES - 1).collect()]
        for i, name in enumerate(names):
            cls = F.when(docs[label].cast("string").eqNullSafe(F.lit(name)), i + 1).otherwise(cls)
    base = docs.select(docs[doc_id].cast("string").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), cls.cast("int").alias("cls"), docs[text].cast("binary").alias("t"))
    blocks = settle(base.mapInPandas(to_blocks, ROWS), "ppm-blocks")
    low = spark.sparkContext.broadcast(low_orders(blocks))
    texts = blocks.where(F.col("shard") == TEXTS)
    answers = texts.mapInPandas(cut_blocks(shards), ROWS).repartition(shards, "shard").mapInPandas(score_shards(low), ROWS)
    sums = settle(texts.unionByName(answers).groupBy("block").applyInPandas(merge_blocks(shards), SUMS), "ppm-sums")
    trained = {r["cls"]: r["n"] for r in sums.where("last").groupBy("cls").agg(F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("n")).collect()}
    ends = sum(trained.values())
    counted = sums.agg(F.sum(F.when(~F.col("held_out"), F.col("words"))).alias("words"), F.sum(F.when(F.col("row").isNull(), F.col("known"))).alias("kinds")).first()
    n_all, kinds = (counted["words"] or 0) + ends, (counted["kinds"] or 0) + (ends > 0)
    prior = F.coalesce(*[F.when(F.col("cls") == k, F.lit(float(np.log10((n + 1) / (ends + CLASSES))))) for k, n in trained.items()], F.lit(0.0))
    whole = sums.where("row is not null").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.first("cls").alias("cls"),
        *[F.sum(c).alias(c) for c in ("words", "known", "base", "score")],
    )
    return whole.select(
        F.col("doc_id").cast(docs.select(docs[doc_id]).schema[0].dataType).alias("doc_id"),
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 1)) - (F.col("words") + 1) * float(np.log10(n_all + kinds + 1))).alias("base_score"),
        (F.col("score") + prior).alias("score"),
    )
