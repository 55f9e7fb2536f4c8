"""Connected components of a table of links, by alternating stars: O(log n) rounds, nothing on the driver but counts.

Up to AT_ONCE links one task joins in memory; what is found is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Links (16 bytes each) that one task joins.
AT_ONCE = 500_000


def to_smallest(links: DataFrame, larger_only: bool) -> DataFrame:
    """Each u with its neighbours v to their smallest m: (v, m) for the larger ones, or for all that are smaller and u."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger_only else links
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").withColumn("m", F.least("u", "m"))
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def told(links: DataFrame) -> tuple:
    """What tells whether links have changed; counts alone can stay alike while links move."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def smallest(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches by links (a, b), beside those by which it reached least already."""
    while (unlike := least[a] != least[b]).any():
        one, two = least[a][unlike], least[b][unlike]
        np.minimum.at(least, np.maximum(one, two), np.minimum(one, two))
        while (least[least] != least).any():
            least = least[least]
    return least


def forest(a: np.ndarray, b: np.ndarray, cost: np.ndarray, nodes: int) -> np.ndarray:
    """Which of the links (a, b) are kept so that nodes reach what they reached: a forest of least cost, ties to smaller nodes."""
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), cost))
    a, b = a[order], b[order]
    least, live, kept = np.arange(nodes), np.arange(len(a)), []
    while len(live := live[least[a[live]] != least[b[live]]]):
        first = np.full(nodes, len(a))
        for side in (a, b):  # of each tree its first link: what is written last stays
            near = np.full(nodes, len(a))
            near[least[side[live]][::-1]] = live[::-1]
            first = np.minimum(first, near)
        chosen = np.unique(first[first < len(a)])
        kept.append(chosen)
        least = smallest(a[chosen], b[chosen], least)
    return order[np.concatenate(kept)] if kept else order[:0]


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All links at hand to (u, v) with v the smallest node that u reaches."""
    links = np.concatenate([np.zeros((0, 2), np.int64), *(b[["u", "v"]].to_numpy() for b in batches)])
    nodes, at = np.unique(links, return_inverse=True)
    least = smallest(*at.reshape(-1, 2).T, np.arange(len(nodes)))
    rest = np.flatnonzero(least != np.arange(len(nodes)))
    yield pd.DataFrame({"u": nodes[rest], "v": nodes[least[rest]]})


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """links (u, v), any order and repetition -> (node, root): the smallest node of its component, for all but the roots."""
    now = settle(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = told(now)
    if 0 < mark[0] <= at_once:
        now, mark = settle(now.coalesce(1).mapInPandas(joined, "u long, v long"), "links"), (0,)
    while mark[0]:
        now = settle(to_smallest(to_smallest(now, True), False), "links")
        before, mark = mark, told(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
