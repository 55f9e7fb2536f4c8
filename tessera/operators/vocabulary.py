"""Adaptive vocabularies over token sequences: pair merging by count (BPE) or by mutual information, replay, expansion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .language import pmi
from .sequences import along, ngrams

JOINT = "+"


def rewritten(seqs: DataFrame, a: str, b: str, new: str) -> DataFrame:
    """Each a followed by b becomes new: greedy, from the left, without overlap; pos is counted anew."""
    after = F.lead("token").over(along())
    x = seqs.withColumn("__mark", F.coalesce((F.col("token") == a) & (after == b), F.lit(False)))
    if a == b:  # of a run of marks every other one starts a pair
        x = x.withColumn("__run", F.col("pos") - F.sum(F.col("__mark").cast("int")).over(along()))
        nth = F.row_number().over(Window.partitionBy("seq_id", "__run", "__mark").orderBy("pos"))
        x = x.withColumn("__start", F.col("__mark") & (nth % 2 == 1)).drop("__run")
    else:
        x = x.withColumn("__start", F.col("__mark"))
    x = x.withColumn("__gone", F.coalesce(F.lag("__start").over(along()), F.lit(False)))
    kept = x.where(~F.col("__gone")).withColumn("token", F.when(F.col("__start"), new).otherwise(F.col("token")))
    return kept.withColumn("pos", F.row_number().over(along()) - 1).drop("__mark", "__start", "__gone")


@dataclass
class Merger:
    """Learns merges (a, b, count): the first pair in "order" of those that occur often enough in enough sequences."""

    least_count: int = 10
    least_support: int = 3
    max_merges: int = 30
    max_vocabulary: int = 10_000
    merges: list[tuple[str, str, int]] = field(default_factory=list)

    def candidates(self, seqs: DataFrame) -> DataFrame:
        """t1, t2, n, score: highest score first, then t1, t2."""
        return ngrams(seqs, 2).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq_id").alias("support")).where((F.col("n") >= self.least_count) & (F.col("support") >= self.least_support)).withColumn("score", F.col("n").cast("double"))

    def step(self, seqs: DataFrame) -> DataFrame | None:
        top = self.candidates(seqs).orderBy(F.desc("score"), "t1", "t2").first()
        if top is None or len(self.merges) >= self.max_merges:
            return None
        self.merges.append((top["t1"], top["t2"], top["n"]))
        return rewritten(seqs, top["t1"], top["t2"], top["t1"] + JOINT + top["t2"])

    def fit(self, seqs: DataFrame, steps: int | None = None) -> DataFrame:
        """The rewritten sequences. A plan grows by a window or two with each merge, so they are written out every few merges."""
        from .models import written

        for i in range(self.max_merges if steps is None else steps):
            out = self.step(seqs)
            if out is None:
                break
            seqs = written(out) if i % 3 == 2 else out
        return seqs

    def encode(self, seqs: DataFrame) -> DataFrame:
        """The learnt merges, in order, on other sequences."""
        for a, b, _ in self.merges:
            seqs = rewritten(seqs, a, b, a + JOINT + b)
        return seqs

    def history(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, a, b, a + JOINT + b, n) for i, (a, b, n) in enumerate(self.merges, 1)], "step int, a string, b string, token string, count long")


@dataclass
class MutualMerger(Merger):
    """The pair of highest pointwise mutual information of those of enough count, support and information."""

    least_pmi: float = 0.5

    def candidates(self, seqs: DataFrame) -> DataFrame:
        support = ngrams(seqs, 2).groupBy("t1", "t2").agg(F.countDistinct("seq_id").alias("support"))
        return pmi(seqs, self.least_count).where(F.col("pmi") >= self.least_pmi).join(support.where(F.col("support") >= self.least_support), ["t1", "t2"]).withColumn("score", F.col("pmi"))


def expanded(seqs: DataFrame) -> DataFrame:
    """Composite tokens back to their parts."""
    parts = seqs.select("seq_id", "pos", F.posexplode(F.split("token", F.lit("\\" + JOINT))).alias("__i", "token"))
    at = Window.partitionBy("seq_id").orderBy("pos", "__i")
    return parts.withColumn("p", F.row_number().over(at) - 1).select("seq_id", F.col("p").alias("pos"), "token")


def locked(token: Column, merges: list[tuple[str, str, int]]) -> Column:
    """Whether a token is part of a composite, and so may not be split, merged or pruned."""
    parts = sorted({p for a, b, _ in merges for p in (a + JOINT + b).split(JOINT)})
    return token.isin(parts) if parts else F.lit(False)


def vocabulary(seqs: DataFrame) -> DataFrame:
    """token, size, children (atomic parts), is_composite."""
    c = seqs.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    parts = F.split("token", F.lit("\\" + JOINT))
    return c.select("token", "size", parts.alias("children"), (F.size(parts) > 1).alias("is_composite"))


def invalid(seqs: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens of sequences that the vocabulary does not have; none in a valid state."""
    return seqs.select("token").distinct().join(known.select("token"), "token", "left_anti")
