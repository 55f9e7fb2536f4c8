"""Online forms: token counts in windows and sessions, nearest codebook entries, counts that stay by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vectors


def token_counts(events: DataFrame, window: str = "1 day", late: str = "2 hours", ts: str = "ts", token: str = "event_type") -> DataFrame:
    """start, end, token, n per tumbling window; later rows than the watermark go."""
    w = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "token", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day", ts: str = "ts", seq: str = "user_id", token: str = "event_type") -> DataFrame:
    """seq, start, end, n, tokens in order, of stretches without a gap: token sequences as they arrive."""
    s = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(seq).alias("seq_id")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(token).alias("token")))).alias("x"))
    return s.select("seq_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.transform("x", lambda e: e["token"]).alias("seq"))


def tokenised(stream: DataFrame, codebook: DataFrame, by: str = "label", v: str = "v") -> DataFrame:
    """Each arriving vector with its nearest codebook entry; stateless."""
    return vectors.nearest(stream, codebook, by, v)
