"""Column expressions: entropies, arrays, vectors. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plogp(p: Column) -> Column:
    """-p log2 p, 0 where p is 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a by its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_of(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def pad_mean(a: Column, length: int) -> Column:
    """The first "length" values; a shorter array is filled up with its mean."""
    return F.when(F.size(a) >= length, F.slice(a, 1, length)).otherwise(F.concat(a, F.array_repeat(F.coalesce(mean_of(a), F.lit(0.0)), F.greatest(F.lit(length) - F.size(a), F.lit(0)))))


def centre_fit(a: Column, length: int) -> Column:
    """The middle "length" values; a shorter array is filled up with its mean on both sides, the left side the shorter."""
    gap = F.lit(length) - F.size(a)
    fill = F.coalesce(mean_of(a), F.lit(0.0))
    left = F.floor(F.greatest(gap, F.lit(0)) / 2).cast("int")
    start = F.floor(F.greatest(-gap, F.lit(0)) / 2).cast("int") + 1
    return F.when(gap <= 0, F.slice(a, start, F.lit(length))).otherwise(F.concat(F.array_repeat(fill, left), a, F.array_repeat(fill, F.greatest(gap, F.lit(0)) - left)))


def pre_emphasis(a: Column, factor: float = 0.97) -> Column:
    """Each value less factor times the one before it; the first stays."""
    return F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(x - factor * F.element_at(a, i.cast("int"))))


def affine(a: Column, shift: float, scale: float) -> Column:
    return F.transform(a, lambda x: (x - shift) / scale)


def log_sum_exp(values: Column) -> Column:
    """Of an array; null if it is empty."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def normal_tail(z: Column) -> Column:
    """P(Z > z), error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def id_hash(key: Column, place: Column, seed: int) -> Column:
    """A seeded number below 1,000,003 for (key, place); plain integer arithmetic, the same in any engine."""
    return ((key.cast("long") * 7919 + place.cast("long") * 104729 + F.lit(seed * 15485863).cast("long")) * 48271) % 1000003
