"""The text block handed on for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the reply for a query without hits.
NO_CONTEXT = "No relevant context found in the knowledge base."


def format_context(queries: DataFrame, hits: DataFrame, none_found: str = NO_CONTEXT) -> DataFrame:
    """``(query_id, context)``, one row per query, also for those without hits.

    A block is ``[Chunk i] (Page p, Score: s)`` and the text below, blocks are parted by a
    blank line and ordered by rank. A query has no more than k hits, so the lists are short.
    """
    head = F.format_string(
        "[Chunk %d] (Page %d, Score: %.4f)\n", F.col("rank"), F.col("page_num"), F.col("score")
    )
    blocks = hits.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", F.concat(head, F.col("content")).alias("block")))
        ).alias("_blocks")
    )
    joined = F.array_join(F.transform("_blocks", lambda b: b["block"]), "\n\n")
    return (
        queries.select("query_id")
        .join(blocks, "query_id", "left")
        .select("query_id", F.coalesce(joined, F.lit(none_found)).alias("context"))
    )
