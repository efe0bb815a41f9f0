"""Chat sessions stored as a table of turns ``conv_id, turn, role, text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.numbering import place_rows

# Turns up to this many are paired by a plain window.
ROWS_PER_RANGE = 1_000_000


def session_history(turns: DataFrame, last_n: int = 5) -> DataFrame:
    """``(conv_id, n_turns, history)``: the last turns of each conversation, oldest first, as
    ``role: text`` lines.

    Tasks drop all but the last ``last_n`` turns before anything is shuffled, so a very long
    conversation costs no more than a short one.
    """
    if last_n < 1:
        raise ValueError("last_n must be at least 1")
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    line = F.concat("role", F.lit(": "), "text")
    return (
        turns.select("conv_id", "turn", line.alias("line"), F.row_number().over(newest).alias("_nth"))
        .where(F.col("_nth") <= last_n)
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_turns"),
            F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("_lines"),
        )
        .select("conv_id", "n_turns", F.array_join(F.transform("_lines", lambda t: t["line"]), "\n").alias("history"))
    )


def turn_pairs(
    turns: DataFrame,
    asking: str = "user",
    replying: str = "assistant",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``(conv_id, turn, question, reply)``: each question with the reply that comes next among the
    turns of the two roles, null if another question or nothing comes next.

    Turns may have gaps and other roles between; at equal turns questions come first, then texts in
    order. Up to ``rows_per_range`` turns are paired in one pass over the ordered conversations.
    Beyond that, long conversations are numbered in ranges and a reply is filed under the number
    before its own, so that no conversation is gathered in one place. Both give the same rows.
    """
    spoken = turns.where(F.col("role").isin(asking, replying)).select(
        "conv_id", "turn", (F.col("role") == replying).alias("_replies"), "text"
    )
    asks = ~F.col("_replies")
    order = ["turn", "_replies", "text"]
    if spoken.count() <= rows_per_range:
        following = Window.partitionBy("conv_id").orderBy(*order)
        reply = F.when(F.lead("_replies").over(following), F.lead("text").over(following))
        return (
            spoken.withColumn("reply", reply)
            .where(asks & F.col("text").isNotNull())
            .select("conv_id", "turn", F.col("text").alias("question"), "reply")
        )
    # All columns are keys, so the numbered keys are the turns.
    return (
        place_rows(spoken, "conv_id", order, "_place")
        .toDF("conv_id", *order, "_place")
        .select(
            "conv_id",
            F.when(asks, F.col("_place")).otherwise(F.col("_place") - 1).alias("_place"),
            F.when(asks, F.col("turn")).alias("turn"),
            F.when(asks, F.col("text")).alias("question"),
            F.when(~asks, F.col("text")).alias("reply"),
        )
        .repartition("conv_id", "_place")
        .groupBy("conv_id", "_place")
        .agg(F.max("turn").alias("turn"), F.max("question").alias("question"), F.max("reply").alias("reply"))
        .where(F.col("question").isNotNull())
        .drop("_place")
    )
