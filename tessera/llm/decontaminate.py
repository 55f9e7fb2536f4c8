"""Benchmark decontamination: a broadcast hash set of test n-grams, a scan of training windows, exact verification.

Built-in functions only. The scan hashes every window of every document and keeps, per document, whether any is in
the set; only documents with such a window are then read again and compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle

#: Between words, after A-Z are lower-cased, and before.
BETWEEN, BETWEEN_RAW = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The set is broadcast up to so many windows (16 bytes each), else joined by shuffle.
BROADCAST_WINDOWS = 2_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def windows(w: Column, n: int) -> Column:
    """array<struct<at,window>>: each run of n words as one string, at its first word from 1. Needs n words."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i, n), " ").alias("window")))


def window_hashes(h: Column, n: int) -> Column:
    """For each run of n word hashes the hash of its first 2^k words, the most that fit: runs of 1, 2, 4, ... doubled."""
    run, length = h, 1
    while length * 2 <= n:
        run = F.zip_with(run, F.slice(run, F.lit(length + 1), F.greatest(F.size(run) - length, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        length *= 2
    return F.slice(run, F.lit(1), F.size(h) - (n - 1))


def benchmark_windows(bench: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """item_id, len, window, hash: every n words of an item, or all of an item of fewer."""
    w = bench.select(bench[item_id].alias("item_id"), words(bench[text]).alias("w")).where(F.size("w") > 0)
    full = w.where(F.size("w") >= n).select("item_id", F.lit(n).alias("len"), F.explode(windows(F.col("w"), n)).alias("x"), "w")
    short = w.where(F.size("w") < n)
    rows = full.select("item_id", "len", F.col("x.window").alias("window")).unionByName(short.select("item_id", F.size("w").alias("len"), F.array_join("w", " ").alias("window")))
    return rows.distinct()


def scan(docs: DataFrame, bench: DataFrame, n: int = 10, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all, hits). all: one row per row of docs, with n_words and whether a window's hash is in the set. hits: verified, per distinct text."""
    test = settle(benchmark_windows(bench, n, item_id, item_text), "windows")
    lengths = sorted(r["len"] for r in test.select("len").distinct().collect())  # at most n
    few = test.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if few else (lambda d: d)
    hashed = test.select("len", F.transform(F.split("window", " "), lambda w: F.xxhash64(w)).alias("h"))
    chosen = F.coalesce(*[F.when(F.col("len") == k, F.element_at(window_hashes(F.col("h"), k), 1)) for k in lengths], F.lit(None).cast("long")) if lengths else F.lit(None).cast("long")
    wanted = hashed.select(chosen.alias("hash")).distinct().withColumn("hit", F.lit(1))

    parts = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), words(docs[text]).alias("w"))
    parts = parts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    empty = F.expr("cast(array() as array<bigint>)")
    runs = [F.when(F.col("n_words") >= k, window_hashes(F.col("h"), k)).otherwise(empty) for k in lengths]
    each = empty if not runs else runs[0] if len(runs) == 1 else F.concat(*runs)
    seen = parts.select("row", "doc_id", "text_hash", "n_words", F.explode_outer(each).alias("hash")).join(hint(wanted), "hash", "left")
    scanned = settle(seen.groupBy("row", "doc_id", "text_hash", "n_words").agg(F.max("hit").alias("hit")), "scanned")

    suspects = scanned.where("hit = 1").select("doc_id", "text_hash").distinct()
    again = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))
    again = again.join(suspects.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    w = again.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    every = F.concat(*[F.when(F.size("w") >= k, F.transform(windows(F.col("w"), k), lambda x: F.struct(x["at"].alias("at"), F.lit(k).alias("len"), x["window"].alias("window")))).otherwise(F.expr("cast(array() as array<struct<at:int,len:int,window:string>>)")) for k in lengths]) if lengths else F.expr("cast(array() as array<struct<at:int,len:int,window:string>>)")
    cut = w.select("doc_id", "text_hash", F.explode(every).alias("x")).select("doc_id", "text_hash", "x.*")
    hits = cut.join(hint(test.select("item_id", "len", "window")), ["len", "window"]).select("doc_id", "text_hash", "at", "len", "item_id")
    return scanned, hits


def contamination(docs: DataFrame, bench: DataFrame, n: int = 10, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, hit_words (places from 1): one row per row of docs.

    Null and empty texts have no words and no hit; so have empty tables on either side (items_sha256 is then that of
    the empty string). Rows that repeat are judged each, alike; ids that repeat with other texts are judged by text.
    """
    scanned, hits = scan(docs, bench, n, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text)
    spans = F.collect_set(F.struct("at", "len"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))))
    per = hits.groupBy("doc_id", "text_hash").agg(places.alias("hit_words"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per = per.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "hit_words", "items")
    out = scanned.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    n_hit = F.coalesce(F.size("hit_words"), F.lit(0)).cast("long")
    return out.select("doc_id", "text_hash", "n_words", F.when(F.col("hit_words").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.col("hit_words").isNotNull().alias("contaminated"), F.coalesce("hit_words", F.expr("cast(array() as array<int>)")).alias("hit_words"))


def cut_words(text: Column, places: Column) -> Column:
    """text without the words at these places (from 1) and without what follows each up to the next word."""
    raw = F.filter(F.split(text, BETWEEN_RAW), lambda w: w != "")
    gaps = F.split(text, "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    # a gap stands before each word and after the last; the first may be empty
    kept = F.transform(raw, lambda w, i: F.when(F.array_contains(places, i + 1), F.lit("")).otherwise(F.concat(w, F.element_at(gaps, (i + 2).cast("int")))))
    return F.concat(F.element_at(gaps, 1), F.array_join(kept, ""))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, drop: str = "documents", *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without contaminated documents (drop="documents"), or with the hit words cut from their texts (drop="spans")."""
    if drop not in ("documents", "spans"):
        raise ValueError(drop)
    found = contamination(docs, bench, n, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text)
    bad = settle(found.where("contaminated").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("hit_words").alias("__w")).dropDuplicates(["__d", "__h"]), "contaminated")
    same = docs[doc_id].eqNullSafe(bad["__d"]) & (F.xxhash64(docs[text]) == bad["__h"])
    if drop == "documents":
        return docs.join(bad.select("__d", "__h"), same, "left_anti")
    return docs.join(bad, same, "left").withColumn(text, F.when(F.col("__w").isNotNull(), cut_words(docs[text], F.col("__w"))).otherwise(docs[text])).drop("__d", "__h", "__w")
