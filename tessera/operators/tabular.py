"""Small relational operators: samples, key sets, repairs, pivots, products, moments, verdicts. Built-in functions but for moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import id_hash


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def random_rows(rows: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows without replacement, the same in any run: those of the least seeded hash of the key."""
    return rows.orderBy(id_hash(F.col(key), F.lit(0), seed), key).limit(n)


def best_rows(rows: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """Each group's row of greatest value, of ties that of the least tie; the aggregate keeps one row a group and task."""
    return rows.groupBy(by).agg(F.min_by(F.struct(*rows.columns), F.struct(-F.col(value), F.col(tie))).alias("b")).select("b.*")


def repaired(c: Column, fill: float = 0.0) -> Column:
    """NaN, infinite and null become fill."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(fill)).otherwise(c)


def pivot_statistics(rows: DataFrame, by: str, column: str, names: list[str], value: str) -> DataFrame:
    """by, a column with the mean value of each name (0 where there is none), and the mean and population deviation over these."""
    wide = rows.groupBy(by).pivot(column, names).agg(F.avg(value)).fillna(0.0)
    cells = F.array(*[F.col(f"`{n}`") for n in names])
    mean = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / len(names)
    var = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x * x) / len(names) - mean * mean
    return wide.select(by, *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in names], F.round(mean, 6).alias("row_mean"), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 6).alias("row_std"))


def signed_product(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, sign, log10_magnitude, zeros: the product of a group's values, which neither overflows nor fails at zeros and signs."""
    x = F.col(value)
    out = rows.groupBy(by).agg(F.sum(F.when(x < 0, 1).otherwise(0)).alias("m"), F.sum(F.when(x == 0, 1).otherwise(0)).alias("zeros"), F.sum(F.when(x != 0, F.log10(F.abs(x)))).alias("s"))
    sign = F.when(F.col("zeros") > 0, 0).when(F.col("m") % 2 == 1, -1).otherwise(1)
    return out.select(by, sign.alias("sign"), F.when(F.col("zeros") == 0, F.round(F.coalesce("s", F.lit(0.0)), 6)).alias("log10_magnitude"), "zeros")


def weighted_centroids(rows: DataFrame, by: str, weight: str, v: str = "v") -> DataFrame:
    """by, dim, mean: sum of w x over sum of w, dimension by dimension."""
    parts = rows.select(by, F.col(weight).alias("w"), F.posexplode(v).alias("dim", "x"))
    return parts.groupBy(by, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


def co_moments(rows: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """by, i, j, n, mean_i, mean_j, cov (sample) of all two dimensions i <= j. Batches are summed before the shuffle."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            groups = b.groupby(by, sort=False).indices.items() if by else [((), np.arange(len(b)))]
            for key, at in groups:
                if len(at):
                    x = np.stack(b[v].to_numpy()[at]).astype(float)
                    i, j = np.triu_indices(x.shape[1])
                    s = x.sum(0)
                    key = key if isinstance(key, tuple) else (key,)
                    yield pd.DataFrame(dict(zip(by, key)) | {"i": i, "j": j, "n": len(x), "si": s[i], "sj": s[j], "sij": (x.T @ x)[i, j]})

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    parts = rows.select(*by, v).mapInPandas(sums, f"{kinds}i int, j int, n long, si double, sj double, sij double")
    total = parts.groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])
    cov = F.when(F.col("n") > 1, (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).otherwise(0.0)
    return total.select(*by, "i", "j", "n", (F.col("si") / F.col("n")).alias("mean_i"), (F.col("sj") / F.col("n")).alias("mean_j"), cov.alias("cov"))


def coded_vocabulary(rows: DataFrame, emitter: str, token: str, context: str, contexts: list, order: list[str]) -> DataFrame:
    """seq_id, pos, token, context, emitter of usable rows: token not negative, emitter known (not 0, its sign dropped), context named."""
    from . import sequences

    good = rows.where((F.col(token) >= 0) & (F.col(emitter) != 0) & F.col(context).isin(contexts)).withColumn("__e", F.abs(emitter))
    return sequences.from_rows(good.withColumn("__c", F.col(context)), "__e", order, token, ("__c",)).withColumnRenamed("__c", "context")


def two_sided(rows: DataFrame, value: str, by: list[str], k: float = 2.0) -> DataFrame:
    """by, n, mean, low, high: mean less and plus k sample deviations."""
    m, s = F.avg(value), F.stddev_samp(value)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(m, 6).alias("mean"), F.round(m - k * s, 6).alias("low"), F.round(m + k * s, 6).alias("high"))


def verdicts(scores: DataFrame, name: str, mean: str, std: str, good: float, fair: float) -> DataFrame:
    """name, cell ("mean ± std" to three places), verdict, best: a results table as it is printed."""
    top = scores.agg(F.max(mean).alias("__top"))
    out = scores.join(F.broadcast(top), how="cross")  # one row
    verdict = F.when(F.col(mean) >= good, "pass").when(F.col(mean) >= fair, "partial").otherwise("fail")
    return out.select(name, F.format_string("%.3f ± %.3f", F.col(mean), F.col(std)).alias("cell"), verdict.alias("verdict"), (F.col(mean) == F.col("__top")).alias("best"))


def hash_noise(key: Column, place: Column, deviation: float, seed: int = 0) -> Column:
    """Normal noise by a seeded hash (Box-Muller): the same in every run, and when a lost task is run again."""
    u = (id_hash(key, place, seed) + 1) / F.lit(1000004.0)
    w = id_hash(key, place, seed + 1) / F.lit(1000003.0)
    return deviation * F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * w)


def range_leak(rows: DataFrame, token: str, label: str) -> DataFrame:
    """n, tokens, shared, accuracy: how well token ids alone tell the label (each token its commonest label)."""
    counts = rows.groupBy(token, label).agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(token).agg(F.max("c").alias("best"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("labels"))
    return per.agg(F.sum("all").alias("n"), F.count(F.lit(1)).alias("tokens"), F.sum(F.when(F.col("labels") > 1, 1).otherwise(0)).alias("shared"), F.round(F.sum("best") / F.sum("all"), 6).alias("accuracy"))


def within_each(rows: DataFrame, who: str, key: str, label: str, held: Column) -> DataFrame:
    """who, n_train, n_test, accuracy of guessing each one's own commonest label: every individual is judged by itself."""
    from . import sequences

    guess = sequences.mode(rows.where(~held), [who], label, "__guess")
    test = rows.where(held).groupBy(who, label).agg(F.count(F.lit(1)).alias("c"))
    hit = test.join(guess, who).groupBy(who).agg(F.sum("c").alias("n_test"), F.round(F.sum(F.when(F.col(label) == F.col("__guess"), F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("accuracy"))
    return hit.join(rows.where(~held).groupBy(who).agg(F.count(F.lit(1)).alias("n_train")), who).select(who, "n_train", "n_test", "accuracy")
