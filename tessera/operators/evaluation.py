"""Agreement of two labellings, classification reports, rank tests, intervals. All from small tables of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_tail


def contingency(rows: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    return rows.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """ARI, NMI (arithmetic), homogeneity, completeness, V, mutual information in bits of a contingency table (a, b, n)."""
    choose = lambda c: c * (c - 1) / 2
    na, nb = table.groupBy(*by, "a").agg(F.sum("n").alias("na")), table.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    total = table.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(choose(F.col("n"))).alias("sij"))
    join = lambda x, y: x.join(y, by) if by else x.join(F.broadcast(y), how="cross")
    ha = join(na, total).groupBy(*by).agg(F.sum(choose(F.col("na"))).alias("si"), (-F.sum(F.col("na") / F.col("t") * F.ln(F.col("na") / F.col("t")))).alias("ha"))
    hb = join(nb, total).groupBy(*by).agg(F.sum(choose(F.col("nb"))).alias("sj"), (-F.sum(F.col("nb") / F.col("t") * F.ln(F.col("nb") / F.col("t")))).alias("hb"))
    mi = join(table.join(na, [*by, "a"]).join(nb, [*by, "b"]), total).groupBy(*by).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    x = join(join(join(total, ha), hb), mi)
    expect, most = F.col("si") * F.col("sj") / choose(F.col("t")), (F.col("si") + F.col("sj")) / 2
    ratio = lambda p, q: F.when(q > 1e-12, p / q).otherwise(1.0)
    h, c = ratio(F.col("mi"), F.col("ha")), ratio(F.col("mi"), F.col("hb"))
    out = {
        "ari": F.when(F.abs(most - expect) < 1e-12, 1.0).otherwise((F.col("sij") - expect) / (most - expect)),
        "nmi": ratio(F.col("mi"), (F.col("ha") + F.col("hb")) / 2),
        "homogeneity": h,
        "completeness": c,
        "v_measure": F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0),
        "mi_bits": F.col("mi") / F.ln(F.lit(2.0)),
    }
    return x.select(*by, F.col("t").alias("n"), *[F.round(v, 6).alias(k) for k, v in out.items()])


def purity(table: DataFrame, least: int = 1) -> DataFrame:
    """Of clusters b over classes a: mean top share, and the share of rows in clusters whose top share is a half or more."""
    c = table.groupBy("b").agg(F.sum("n").alias("t"), (F.max("n") / F.sum("n")).alias("top")).where(F.col("t") >= least)
    return c.agg(F.round(F.avg("top"), 6).alias("mean_purity"), F.round(F.sum(F.when(F.col("top") >= 0.5, F.col("t")).otherwise(0)) / F.sum("t"), 6).alias("pure_share"), F.count(F.lit(1)).alias("clusters"))


def class_entropy(table: DataFrame) -> DataFrame:
    """b, n, entropy in bits of the classes a within each b."""
    t = table.groupBy("b").agg(F.sum("n").alias("t"))
    return table.join(t, "b").groupBy("b").agg(F.first("t").alias("n"), F.round(F.abs(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t")))), 6).alias("entropy"))


def per_class(confusion: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of a confusion table (a true, b predicted, n); 0 where nothing is divided by."""
    labels = confusion.select(F.col("a").alias("label")).union(confusion.select("b")).distinct()
    t = confusion.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("support"))
    p = confusion.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("predicted"))
    hit = confusion.where("a = b").select(F.col("a").alias("label"), F.col("n").alias("tp"))
    x = labels.join(t, "label", "left").join(p, "label", "left").join(hit, "label", "left").fillna(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    prec, rec = share(F.col("tp"), F.col("predicted")), share(F.col("tp"), F.col("support"))
    return x.select("label", "support", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0), 6).alias("f1"), "predicted", "tp")


def report(confusion: DataFrame) -> DataFrame:
    """accuracy, macro and weighted F1, UAR, MCC."""
    x = per_class(confusion)
    s = x.agg(F.sum("tp").alias("c"), F.sum("support").alias("s"), F.avg("f1").alias("macro"), F.sum(F.col("f1") * F.col("support")).alias("wf"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("uar"), F.sum(F.col("predicted").cast("double") * F.col("support")).alias("pt"), F.sum(F.pow(F.col("predicted").cast("double"), 2)).alias("pp"), F.sum(F.pow(F.col("support").cast("double"), 2)).alias("tt"))
    d = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return s.select(F.round(F.col("c") / F.col("s"), 6).alias("accuracy"), F.round("macro", 6).alias("macro_f1"), F.round(F.col("wf") / F.col("s"), 6).alias("weighted_f1"), F.round("uar", 6).alias("uar"), F.round(F.when(d > 0, (F.col("c") * F.col("s") - F.col("pt")) / d).otherwise(0.0), 6).alias("mcc"))


def normalised(confusion: DataFrame) -> DataFrame:
    rows = confusion.groupBy("a").agg(F.sum("n").alias("r"))
    return confusion.join(rows, "a").select("a", "b", "n", F.round(F.col("n") / F.col("r"), 6).alias("share"))


def running_total(rows: DataFrame, n: str, order: str, by: list[str] = [], pieces: int = 64) -> DataFrame:  # noqa: B006
    """rows with upto: the sum of n over rows of up to this value of order, within by.

    The range of values is cut at approximate quantiles; a window holds one piece, and the pieces' sums are added.
    """
    edges = rows.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.002)
    piece = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col(order))) if edges else F.lit(0)
    x = rows.withColumn("__piece", piece)
    sums = x.groupBy(*by, "__piece").agg(F.sum(n).alias("__s"))
    before = sums.select(*by, "__piece", (F.sum("__s").over(Window.partitionBy(*by).orderBy("__piece")) - F.col("__s")).alias("__before"))  # at most "pieces" rows of each
    inner = F.sum(n).over(Window.partitionBy(*by, "__piece").orderBy(order))
    return x.withColumn("__inner", inner).join(F.broadcast(before), [*by, "__piece"]).withColumn("upto", F.col("__before") + F.col("__inner")).drop("__piece", "__inner", "__before")


def rank_sums(rows: DataFrame, group: str, value: str) -> DataFrame:
    """a, b, n_a, n_b, w (rank sum of a, mean ranks for ties), z, p (two-sided) of every two groups.

    Ranks come from counts of distinct values, added up in pieces of their range.
    """
    c = rows.groupBy(F.col(group).alias("g"), F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    names = c.select("g").distinct()
    pairs = F.broadcast(names.select(F.col("g").alias("a")).join(names.select(F.col("g").alias("b")), F.col("a") < F.col("b")))
    both = c.join(pairs, (F.col("g") == F.col("a")) | (F.col("g") == F.col("b"))).groupBy("a", "b", "x").agg(F.sum(F.when(F.col("g") == F.col("a"), F.col("n")).otherwise(0)).alias("na"), F.sum("n").alias("n"))
    ranked = running_total(both, "n", "x", ["a", "b"]).withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    s = ranked.groupBy("a", "b").agg(F.sum("na").alias("n_a"), (F.sum("n") - F.sum("na")).alias("n_b"), F.sum(F.col("rank") * F.col("na")).alias("w"))
    z = (F.col("w") - F.col("n_a") * (F.col("n_a") + F.col("n_b") + 1) / 2) / F.sqrt(F.col("n_a") * F.col("n_b") * (F.col("n_a") + F.col("n_b") + 1) / 12)
    return s.select("a", "b", "n_a", "n_b", "w", F.round(z, 6).alias("z"), (2 * normal_tail(F.abs(z))).alias("p"))


def signed_rank(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """n, w_plus, w_minus, z of the Wilcoxon signed-rank test of pairs that differ."""
    d = pairs.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").withColumn("m", F.round(F.abs("d"), 9))
    c = d.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"))
    ranked = running_total(c, "n", "m").withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"))
    n = F.col("n")
    return s.select("n", "w_plus", "w_minus", F.round((F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 6).alias("z"))


#: Two-sided 95 % points of Student's t by degrees of freedom, from 1. Fixed values.
T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228]


def interval(rows: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """n, mean, low, high: the 95 % interval of the mean by Student's t (1.96 beyond eleven values)."""
    n = F.count(value)
    t = F.coalesce(F.get(F.array(*map(F.lit, T95)), (n - 2).cast("int")), F.lit(1.96))
    half = t * F.stddev_samp(value) / F.sqrt(n)
    return rows.groupBy(*by).agg(n.alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.avg(value) - half, 6).alias("low"), F.round(F.avg(value) + half, 6).alias("high"))


def expected_mi(table: DataFrame) -> float:
    """Expected mutual information (nats) of a contingency table under fixed margins; the margins are what is collected."""
    import numpy as np
    from math import lgamma

    a = np.array([r[0] for r in table.groupBy("a").agg(F.sum("n")).select("sum(n)").collect()], float)
    b = np.array([r[0] for r in table.groupBy("b").agg(F.sum("n")).select("sum(n)").collect()], float)
    n, out, lg = a.sum(), 0.0, lambda x: np.array([lgamma(v + 1) for v in np.atleast_1d(x)])
    for x in a:
        for y in b:
            k = np.arange(max(1, x + y - n), min(x, y) + 1)
            if len(k):
                logp = lg(x) + lg(y) + lg(n - x) + lg(n - y) - lg(n) - lg(k) - lg(x - k) - lg(y - k) - lg(n - x - y + k)
                out += float(np.sum(k / n * np.log(n * k / (x * y)) * np.exp(logp)))
    return out


def ami(table: DataFrame) -> float:
    """Adjusted mutual information (arithmetic)."""
    import numpy as np

    rows = table.collect()
    a, b, n = {}, {}, sum(r["n"] for r in rows)
    for r in rows:
        a[r["a"]], b[r["b"]] = a.get(r["a"], 0) + r["n"], b.get(r["b"], 0) + r["n"]
    h = lambda m: -sum(v / n * np.log(v / n) for v in m.values())
    mi, e = sum(r["n"] / n * np.log(r["n"] * n / (a[r["a"]] * b[r["b"]])) for r in rows), expected_mi(table)
    most = (h(a) + h(b)) / 2
    return 1.0 if abs(most - e) < 1e-12 else float((mi - e) / (most - e))
