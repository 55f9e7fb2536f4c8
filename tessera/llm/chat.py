"""Chat formatting: every participant's view of a dialogue, with its own turns as the assistant's. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers in so many belong to one part of a rendered dialogue.
PART = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def perspectives(talk: DataFrame, part: int = PART, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """conv_id, perspective, part, n_turns, n_own, rendered, mask, n_chars: one row per dialogue, participant and part.

    Participants are the distinct roles but the system's. In a participant's view its turns are "assistant", those of
    others "user" with the speaker's name before the text, the system's stay. mask holds start:end of what is trained
    on, in code points of rendered: the view's own texts with their end marks. Parts are of "part" turn numbers, so
    that no dialogue has to fit one row; a dialogue's whole view is its parts in order.
    Order within a part: turn, role, text. A null text is empty, a null role is named "unknown", a null turn comes
    first (part 0 at least); rows without conv_id form one dialogue; repeated rows are repeated turns; a dialogue of
    system turns alone has no view; an empty table has none. Other columns are not read.
    """
    rows = talk.select(talk[conv_id].alias("conv_id"), F.coalesce(talk[turn].cast("long"), F.lit(-1)).alias("turn"), F.coalesce(talk[role], F.lit("unknown")).alias("role"), F.coalesce(talk[text], F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.greatest(F.floor(F.col("turn") / part), F.lit(0)).cast("long"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    who = rows.where(F.col("role") != system).groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("who"))
    views = parts.join(who.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "part", "turns", F.explode("who").alias("perspective"))
    own = lambda t: t["role"] == F.col("perspective")

    def said(t):
        head = F.when(own(t), "assistant").when(t["role"] == system, system).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.struct(F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), own(t).alias("own"))

    pieces = F.transform("turns", said)
    # the start of piece i is the length of all before it; within a part of bounded turns
    views = views.withColumn("pieces", pieces)
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    mask = F.aggregate(
        "pieces",
        zero,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.concat(acc["out"], F.array(F.concat_ws(":", (acc["at"] + F.length(p["head"])).cast("string"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.array_join(acc["out"], ","),
    )
    out = views.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"), mask.alias("mask"))
    return out.withColumn("n_chars", F.length("rendered").cast("long"))

