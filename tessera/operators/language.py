"""Information and n-gram language models over token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import plogp
from .sequences import along, ngrams


def pmi(seqs: DataFrame, least: int = 1) -> DataFrame:
    """t1, t2, n, pmi: log2 of how much likelier the pair is than by chance, of pairs seen "least" times or more."""
    pairs = ngrams(seqs, 2).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    single = seqs.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    share = single.join(single.agg(F.sum("c").alias("all")), how="cross").select("token", (F.col("c") / F.col("all")).alias("p"))  # one row beside another table
    total = pairs.agg(F.sum("n").alias("pairs"))
    out = pairs.join(F.broadcast(total), how="cross").join(share.select(F.col("token").alias("t1"), F.col("p").alias("p1")), "t1").join(share.select(F.col("token").alias("t2"), F.col("p").alias("p2")), "t2")
    return out.where(F.col("n") >= least).select("t1", "t2", "n", F.round(F.log2(F.col("n") / F.col("pairs") / (F.col("p1") * F.col("p2"))), 6).alias("pmi"))


def dependency(seqs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Unigram entropy H1 of what follows, conditional entropy H2, and (H1 - H2) / H1."""
    pairs = ngrams(seqs, 2) if not by else ngrams(seqs.select("seq_id", "pos", "token"), 2).join(seqs.select("seq_id", *by).distinct(), "seq_id")
    c = pairs.groupBy(*by, "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    row = c.groupBy(*by, "t1").agg(F.sum("n").alias("r"))
    col = c.groupBy(*by, "t2").agg(F.sum("n").alias("k"))
    total = c.groupBy(*by).agg(F.sum("n").alias("all"))
    beside = lambda x: x.join(total, by) if by else x.join(F.broadcast(total), how="cross")  # noqa: E731  one row without groups
    h1 = beside(col).withColumn("p", F.col("k") / F.col("all")).groupBy(*by).agg(F.sum(plogp(F.col("p"))).alias("h1"))
    h2 = beside(c.join(row, [*by, "t1"])).groupBy(*by).agg((-F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") / F.col("r")))).alias("h2"))
    both = h1.join(h2, by) if by else h1.join(F.broadcast(h2), how="cross")
    return both.select(*by, F.round("h1", 6).alias("h1"), F.round("h2", 6).alias("h2"), F.round(F.when(F.col("h1") > 0, (F.col("h1") - F.col("h2")) / F.col("h1")).otherwise(0.0), 6).alias("dependency"))


def compressibility(seqs: DataFrame, order: int = 3) -> DataFrame:
    """Bits a token at each order up to "order": maximum likelihood, contexts cut at the start of a sequence."""
    lags = seqs.select("seq_id", "pos", "token", *[F.lag("token", k).over(along()).alias(f"l{k}") for k in range(1, order)]).select("token", *[f"l{k}" for k in range(1, order)])
    out = None
    for n in range(1, order + 1):
        context = [f"l{k}" for k in range(1, n)]
        grams = lags.groupBy(*context, "token").agg(F.count(F.lit(1)).alias("n"))
        if context:
            shares = grams.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*context)))
        else:
            shares = grams.join(F.broadcast(grams.agg(F.sum("n").alias("all"))), how="cross").withColumn("p", F.col("n") / F.col("all"))  # one row
        bits = shares.agg(F.round(-F.sum(F.col("n") * F.log2(F.col("p") + 1e-12)) / F.sum("n"), 6).alias("bits")).select(F.lit(n).alias("order"), "bits")
        out = bits if out is None else out.unionByName(bits)
    return out


def bigram_model(train: DataFrame, alpha: float = 1.0) -> DataFrame:
    """t1, t2, p, back: Laplace probabilities of t2 after t1 and of t1 before t2, over all pairs of the vocabulary."""
    vocab = F.broadcast(train.select("token").distinct())
    grid = vocab.withColumnRenamed("token", "t1").join(vocab.withColumnRenamed("token", "t2"), how="cross")  # vocabulary squared
    seen = ngrams(train, 2).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    g = grid.join(seen, ["t1", "t2"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.count(F.lit(1)).over(Window.partitionBy("t1"))
    ahead = (F.col("n") + alpha) / (F.sum("n").over(Window.partitionBy("t1")) + alpha * size)
    behind = (F.col("n") + alpha) / (F.sum("n").over(Window.partitionBy("t2")) + alpha * F.count(F.lit(1)).over(Window.partitionBy("t2")))
    return g.select("t1", "t2", ahead.alias("p"), behind.alias("back"))


def next_token(test: DataFrame, model: DataFrame) -> DataFrame:
    """bits, accuracy and n of next-token prediction; a pair outside the model costs log2 of its vocabulary."""
    best = model.groupBy("t1").agg(F.min_by("t2", F.struct(-F.round("p", 12), F.col("t2"))).alias("guess"))
    size = model.agg(F.countDistinct("t1").alias("v"))
    pairs = ngrams(test, 2).join(F.broadcast(model), ["t1", "t2"], "left").join(F.broadcast(best), "t1", "left").join(F.broadcast(size), how="cross")
    return pairs.agg(F.round(F.avg(F.coalesce(-F.log2("p"), F.log2("v"))), 6).alias("bits"), F.round(F.avg(F.when(F.col("guess") == F.col("t2"), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def cloze(test: DataFrame, model: DataFrame) -> DataFrame:
    """bits, accuracy and n of a token between its neighbours: P(left to t) P(t to right), over all t, made to sum to 1."""
    hole = ngrams(test, 3).groupBy("t1", "t2", "t3").agg(F.count(F.lit(1)).alias("n"))  # distinct contexts only
    left = model.select(F.col("t1"), F.col("t2").alias("t"), F.col("p").alias("pl"))
    right = model.select(F.col("t1").alias("t"), F.col("t2").alias("t3"), F.col("p").alias("pr"))
    score = left.join(right, "t").select("t1", "t3", "t", (F.col("pl") * F.col("pr")).alias("s"))
    norm = score.groupBy("t1", "t3").agg(F.sum("s").alias("z"), F.min_by("t", F.struct(-F.round("s", 12), F.col("t"))).alias("guess"))
    got = hole.join(norm, ["t1", "t3"]).join(score.withColumnRenamed("t", "t2"), ["t1", "t2", "t3"])
    return got.agg(F.round(-F.sum(F.col("n") * F.log2(F.col("s") / F.col("z"))) / F.sum("n"), 6).alias("bits"), F.round(F.sum(F.when(F.col("guess") == F.col("t2"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"), F.sum("n").alias("n"))


def perplexity(train: DataFrame, test: DataFrame, by: str) -> DataFrame:
    """Add-one unigram perplexity of test under the model of its own group and of all train."""
    v = train.agg(F.countDistinct("token").alias("v"))
    own = train.groupBy(by, "token").agg(F.count(F.lit(1)).alias("c"))
    own_n = own.groupBy(by).agg(F.sum("c").alias("cn"))
    every = train.groupBy("token").agg(F.count(F.lit(1)).alias("g"))
    every_n = train.agg(F.count(F.lit(1)).alias("gn"))
    t = test.groupBy(by, "token").agg(F.count(F.lit(1)).alias("n")).join(own, [by, "token"], "left").join(own_n, by, "left").join(every, "token", "left").join(F.broadcast(every_n), how="cross").join(F.broadcast(v), how="cross")
    bits = lambda c, n: F.pow(F.lit(2.0), -F.sum(F.col("n") * F.log2((F.coalesce(c, F.lit(0)) + 1) / (F.coalesce(n, F.lit(0)) + F.col("v")))) / F.sum("n"))
    return t.groupBy(by).agg(F.round(bits(F.col("c"), F.col("cn")), 6).alias("own_ppl"), F.round(bits(F.col("g"), F.col("gn")), 6).alias("global_ppl"))


def completed(prefixes: DataFrame, model: DataFrame, steps: int) -> DataFrame:
    """prefixes (seq_id, token: the last one) with guess, the likeliest next tokens one after the other, as one array."""
    best = model.groupBy("t1").agg(F.min_by("t2", F.struct(-F.round("p", 12), F.col("t2"))).alias("t2"))
    ways = best.agg(F.map_from_entries(F.collect_list(F.struct("t1", "t2"))).alias("__ways"))  # one entry per vocabulary token
    step = lambda acc, _: F.concat(acc, F.array(F.element_at("__ways", F.element_at(acc, -1))))
    return prefixes.join(F.broadcast(ways), how="cross").select("*", F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array("token"), step), 2, steps).alias("guess")).drop("__ways")


def js_divergence(profiles: DataFrame, group: str = "context") -> DataFrame:
    """a, b, js: Jensen-Shannon divergence in bits of the token shares p_token of each two groups."""
    p = profiles.select(group, "token", F.col("p_token").alias("p"))
    names = p.select(group).distinct()
    pairs = names.select(F.col(group).alias("a")).join(names.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    tokens = p.select("token").distinct()
    grid = F.broadcast(pairs).join(tokens, how="cross")
    both = grid.join(p.select(F.col(group).alias("a"), "token", F.col("p").alias("pa")), ["a", "token"], "left").join(p.select(F.col(group).alias("b"), "token", F.col("p").alias("pb")), ["b", "token"], "left").fillna(0.0, ["pa", "pb"])
    mid = (F.col("pa") + F.col("pb")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mid)).otherwise(0.0)
    return both.groupBy("a", "b").agg(F.round(F.sum(part("pa") + part("pb")) / 2, 6).alias("js"))


def distinctiveness(profiles: DataFrame, group: str = "context") -> DataFrame:
    """token, kl of its groups' mix from the even mix in bits, owner (group of its largest share)."""
    k = profiles.agg(F.countDistinct(group).alias("k"))
    return profiles.join(F.broadcast(k), how="cross").groupBy("token").agg(F.round(F.sum(F.col("p_context") * F.log2(F.col("p_context") * F.col("k"))), 6).alias("kl"), F.min_by(group, F.struct(-F.round("p_context", 9), F.col(group))).alias("owner"))


def repeats(seqs: DataFrame, longest: int, least: int) -> DataFrame:
    """n, gram (joined by spaces), count: runs of 2 to "longest" tokens seen "least" times or more that no run one token longer,
    on either side, matches in count."""
    def counted(n: int) -> DataFrame:
        g = ngrams(seqs, n)
        return g.groupBy(F.concat_ws(" ", *[f"t{k + 1}" for k in range(n)]).alias("gram"), F.concat_ws(" ", *[f"t{k + 1}" for k in range(n - 1)]).alias("head"), F.concat_ws(" ", *[f"t{k + 2}" for k in range(n - 1)]).alias("tail")).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)

    out = None
    for n in range(2, longest + 1):
        own, above = counted(n).select(F.lit(n).alias("n"), "gram", "count"), counted(n + 1)
        wider = above.select(F.col("head").alias("gram"), "count").unionByName(above.select(F.col("tail").alias("gram"), "count")).distinct() if n < longest else None
        kept = own if wider is None else own.join(wider, ["gram", "count"], "left_anti").select("n", "gram", "count")
        out = kept if out is None else out.unionByName(kept)
    return out


def graph(seqs: DataFrame, least: int = 2) -> DataFrame:
    """nodes, edges, density, mean clustering of the transition graph: edges of "least" transitions or more, seen without direction for clustering."""
    e = ngrams(seqs, 2).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("t1", "t2")
    nodes = e.select(F.col("t1").alias("v")).union(e.select("t2")).distinct()
    u = e.where("t1 <> t2").select(F.least("t1", "t2").alias("a"), F.greatest("t1", "t2").alias("b")).distinct()
    both = u.unionByName(u.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    tri = both.alias("x").join(both.alias("y"), F.col("x.b") == F.col("y.a")).join(both.alias("z"), (F.col("y.b") == F.col("z.a")) & (F.col("z.b") == F.col("x.a"))).groupBy(F.col("x.a").alias("a")).agg(F.count(F.lit(1)).alias("t"))
    c = nodes.join(degree, nodes["v"] == degree["a"], "left").drop("a").join(tri, F.col("v") == F.col("a"), "left").select(F.when(F.col("d") > 1, F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("c"))
    clustering = c.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("c"), 6).alias("clustering"))
    edges = e.agg(F.count(F.lit(1)).alias("edges"))
    return clustering.join(F.broadcast(edges), how="cross").select("nodes", "edges", F.round(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))), 6).alias("density"), "clustering")
