"""Features of token sequences: one row per sequence, or per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import plogp
from .sequences import ngrams


def transitions(seqs: DataFrame) -> DataFrame:
    """t1, t2, n, p (of t2 after t1)."""
    counts = ngrams(seqs, 2).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("t1").agg(F.sum("n").alias("total"))
    return counts.join(out, "t1").withColumn("p", F.col("n") / F.col("total")).drop("total")


def eighteen(seqs: DataFrame, vocabulary: int) -> DataFrame:
    """The features a to r of each sequence: length, kinds, share of the vocabulary, entropy, transitions and frequencies."""
    types = seqs.groupBy("seq_id", "token").agg(F.count(F.lit(1)).alias("c"))
    length = types.groupBy("seq_id").agg(F.sum("c").alias("n"))
    types = types.join(length, "seq_id").withColumn("p", F.col("c") / F.col("n"))
    uni = types.groupBy("seq_id").agg(
        F.first("n").alias("a_length"), F.count(F.lit(1)).alias("b_richness"), F.round(F.sum(plogp(F.col("p"))), 6).alias("d_entropy"),
        F.round(F.max("p"), 6).alias("m_max_freq"), F.round(F.min("p"), 6).alias("n_min_freq"), F.round(F.stddev_pop("p"), 6).alias("o_std_freq"), F.round(F.avg("p"), 6).alias("p_mean_freq"),
    )
    pairs = ngrams(seqs, 2).groupBy("seq_id", "t1", "t2").agg(F.count(F.lit(1)).alias("c"))
    from_ = pairs.groupBy("seq_id", "t1").agg(F.sum("c").alias("out"))
    pairs = pairs.join(from_, ["seq_id", "t1"]).withColumn("p", F.col("c") / F.col("out"))
    bi = pairs.groupBy("seq_id").agg(
        F.sum("c").alias("__all"), F.count(F.lit(1)).alias("f_unique_transitions"), F.round(F.avg("p"), 6).alias("g_mean_out"), F.round(F.stddev_pop("p"), 6).alias("h_std_out"),
        F.round(F.max("p"), 6).alias("i_max_out"), F.round(F.min("p"), 6).alias("j_min_out"), F.sum(F.when(F.col("t1") == F.col("t2"), F.col("c")).otherwise(0)).alias("__self"),
    )
    tri = ngrams(seqs, 3).groupBy("seq_id").agg(F.countDistinct("t1", "t2", "t3").alias("l_unique_trigrams"))
    out = uni.join(bi, "seq_id", "left").join(tri, "seq_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "seq_id", "a_length", "b_richness", F.round(F.col("b_richness") / vocabulary, 6).alias("c_versatility"), "d_entropy",
        F.round(zero(F.col("f_unique_transitions") / F.col("__all")), 6).alias("e_transition_rate"), zero(F.col("f_unique_transitions")).alias("f_unique_transitions"),
        *[zero(F.col(c)).alias(c) for c in ("g_mean_out", "h_std_out", "i_max_out", "j_min_out")], F.round(zero(F.col("__self") / F.col("__all")), 6).alias("k_self_loop"),
        zero(F.col("l_unique_trigrams")).alias("l_unique_trigrams"), "m_max_freq", "n_min_freq", "o_std_freq", "p_mean_freq",
        F.round(zero(F.col("f_unique_transitions")) / (vocabulary * (vocabulary - 1)), 6).alias("q_density"), F.lit(vocabulary).cast("long").alias("r_n_types_total"),
    )


def bag(seqs: DataFrame, vocabulary: list[str], share: bool = False) -> DataFrame:
    """A column for each token: its count in the sequence, or its share."""
    n = F.count(F.lit(1))
    ones = [F.sum(F.when(F.col("token") == v, 1).otherwise(0)) for v in vocabulary]
    return seqs.groupBy("seq_id").agg(*[(F.round(c / n, 6) if share else c).alias(f"n_{v}") for v, c in zip(vocabulary, ones)])


def diversity(seqs: DataFrame) -> DataFrame:
    """Length, distinct tokens, natural entropy and its share of the most, repetition, top share, per sequence."""
    types = seqs.groupBy("seq_id", "token").agg(F.count(F.lit(1)).alias("c"))
    n = types.groupBy("seq_id").agg(F.sum("c").alias("n"))
    p = types.join(n, "seq_id").withColumn("p", F.col("c") / F.col("n"))
    h = -F.sum(F.col("p") * F.ln("p"))
    u = F.count(F.lit(1))
    return p.groupBy("seq_id").agg(
        F.first("n").alias("n"), u.alias("n_unique"), F.round(F.abs(h), 6).alias("entropy_nats"), F.round(F.when(u > 1, h / F.ln(u)).otherwise(0.0), 6).alias("evenness"),
        F.round(1 - u / F.first("n"), 6).alias("repetition"), F.round(F.max("p"), 6).alias("max_share"), F.round(u / F.first("n"), 6).alias("richness_rate"),
    )


def context_profile(seqs: DataFrame) -> DataFrame:
    """context, token, p_token (of the token in the context) and p_context (of the context for the token)."""
    c = seqs.groupBy("context", "token").agg(F.count(F.lit(1)).alias("n"))
    by_ctx, by_tok = c.groupBy("context").agg(F.sum("n").alias("nc")), c.groupBy("token").agg(F.sum("n").alias("nt"))
    return c.join(by_ctx, "context").join(by_tok, "token").select("context", "token", "n", (F.col("n") / F.col("nc")).alias("p_token"), (F.col("n") / F.col("nt")).alias("p_context"))


def conditioned(seqs: DataFrame, default: float = 1e-4) -> DataFrame:
    """Per sequence, given its context: mean log2 P(token | context), mean log2 P(context | token), uncertainty, and the
    log2 transition product, all in log space. Uses the true context, so it leaks the label by design."""
    prof = context_profile(seqs)
    tok = seqs.join(prof, ["context", "token"], "left")
    floor = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(default)), F.lit(default))
    uni = tok.groupBy("seq_id", "context").agg(F.round(F.avg(F.log2(floor("p_token"))), 6).alias("log_p_token"), F.round(F.avg(F.log2(floor("p_context"))), 6).alias("log_p_context"), F.round(F.sum(plogp(floor("p_token"))), 6).alias("uncertainty"))
    pairs = ngrams(seqs, 2).join(transitions(seqs), ["t1", "t2"])
    bi = pairs.groupBy("seq_id").agg(F.round(F.avg(F.log2(F.col("p"))), 6).alias("log_p_transition"), F.round(F.pow(F.lit(2.0), -F.avg(F.log2("p"))), 6).alias("inverse_geometric_mean"), F.round(F.count(F.lit(1)) / F.countDistinct("t1", "t2"), 6).alias("linearity"))
    return uni.join(bi, "seq_id", "left")
