"""Token sequences: rows (seq_id, pos, token). What needs order is one window per sequence; all else is aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import id_hash


def along() -> WindowSpec:
    return Window.partitionBy("seq_id").orderBy("pos")



def from_rows(rows: DataFrame, seq: str, order: list[str], token: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows to sequences: pos counts from 0 within seq in the given order."""
    at = Window.partitionBy(seq).orderBy(*order)
    return rows.select(F.col(seq).alias("seq_id"), (F.row_number().over(at) - 1).alias("pos"), F.col(token).alias("token"), *keep)


def mode(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group, of ties the least."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def first_mode(rows: DataFrame, by: list[str], value: str, order: str, name: str) -> DataFrame:
    """The most frequent value of each group, of ties the one that comes first."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__at"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("__n"), F.col("__at"))).alias(name))


def assembled(seqs: DataFrame, min_len: int = 2) -> DataFrame:
    """seq_id, seq (array in order), seq_len, of sequences of min_len tokens or more."""
    lists = seqs.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("__s"))
    return lists.select("seq_id", F.transform("__s", lambda x: x["token"]).alias("seq"), F.size("__s").alias("seq_len")).where(F.col("seq_len") >= min_len)


def exploded(lists: DataFrame, seq: str = "seq") -> DataFrame:
    return lists.select("seq_id", F.posexplode(seq).alias("pos", "token"))


def in_frequent_groups(rows: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups of "least" rows or more."""
    return rows.join(rows.groupBy(group).count().where(F.col("count") >= least).select(group), group, "left_semi")


def in_largest_groups(rows: DataFrame, group: str, k: int) -> DataFrame:
    """Rows of the k largest groups, of ties the least names."""
    return rows.join(F.broadcast(rows.groupBy(group).count().orderBy(F.desc("count"), group).limit(k).select(group)), group, "left_semi")


def ngrams(seqs: DataFrame, n: int) -> DataFrame:
    """seq_id, pos, t1 ... tn: each run of n tokens."""
    out = seqs.select("seq_id", "pos", F.col("token").alias("t1"), *[F.lead("token", k).over(along()).alias(f"t{k + 1}") for k in range(1, n)])
    return out.where(F.col(f"t{n}").isNotNull()) if n > 1 else out


def ngram_counts(seqs: DataFrame, n: int) -> DataFrame:
    return ngrams(seqs, n).groupBy(*[f"t{k + 1}" for k in range(n)]).agg(F.count(F.lit(1)).alias("n"))


def shuffled(seqs: DataFrame, seed: int = 0) -> DataFrame:
    """The tokens of each sequence in the order of a seeded hash: same multiset, no order."""
    at = Window.partitionBy("seq_id").orderBy(id_hash(F.col("seq_id"), F.col("pos"), seed), "pos")
    return seqs.withColumn("pos", F.row_number().over(at) - 1)


def truncated(seqs: DataFrame, first: int) -> DataFrame:
    return seqs.where(F.col("pos") < first)


def dropped(seqs: DataFrame, percent: int, seed: int = 0) -> DataFrame:
    """Without about so many percent of the tokens, by a seeded hash; pos is counted anew."""
    left = seqs.where(id_hash(F.col("seq_id"), F.col("pos"), seed) % 100 >= percent)
    return left.withColumn("pos", F.row_number().over(along()) - 1)


def noisy(rows: DataFrame, value: str, deviation: float, seed: int = 0) -> DataFrame:
    return rows.withColumn(value, F.col(value) + deviation * F.randn(seed))


def length_band(length: Column, edges: tuple[int, ...]) -> Column:
    """"lo-hi" of the band that holds the length, null outside: bands run from each edge to one below the next."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:]):
        out = F.when((length >= a) & (length < b), f"{a}-{b - 1}").otherwise(out)
    return out
