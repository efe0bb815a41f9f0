"""Stored answers by keyword, a generated reply where there is none, and preferring one source
of replies over another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.matching import BROADCAST_KEYS, INLINE_KEYS, occurrences, occurs
from lectern.operators.sizing import broadcast_if_small, rows_within

RESULTS = "array<struct<title:string,url:string,content:string>>"
LOOKUP_SCHEMA = f"priority int, key string, answer string, results {RESULTS}"

MAX_RESULTS = 3

# Fixed value: address of the generated result, up to the query.
SEARCH_URL = "https://www.google.com/search?q="


def keyword_lookup(
    queries: DataFrame,
    table: DataFrame,
    max_results: int = MAX_RESULTS,
    word: bool = False,
    inline_keys: int = INLINE_KEYS,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``(query_id, query, key, answer, results)``: the first entry of ``table`` by
    ``priority`` whose key is part of the query in lower case; nulls where there is none.

    By default a key also matches inside a longer word; ``word=True`` asks for whole words.
    ``query_id`` must be unique, and so must ``priority`` and ``key`` together; of keys with the same
    priority the least counts.
    """
    if max_results < 0:
        raise ValueError("max_results must not be negative")
    capped = table.withColumn("results", F.slice("results", 1, max_results))
    same = F.col("key") == F.col("_key")
    entries = rows_within(table.select("priority", "key"), inline_keys)
    if entries is None:
        number = table.schema["priority"].dataType
        none = F.lit(None).cast(T.StructType([T.StructField("priority", number), T.StructField("key", T.StringType())]))
        texts = queries.select(F.col("query_id").alias("text_id"), F.lower("query").alias("text"))
        hits = occurrences(texts, table.select("priority", "key"), word, broadcast_keys)
        hits = hits.select(F.col("text_id").alias("query_id"), F.lit(None).cast("string").alias("query"), F.struct("priority", "key").alias("first"))
        # Each query meets its entries in one aggregation; entries are narrow, and the least goes on.
        every = queries.select("query_id", "query", none.alias("first")).unionByName(hits)
        first = every.groupBy("query_id").agg(F.max("query").alias("query"), F.min("first").alias("first"))
        # Queries without an entry get keys of their own, spread evenly, where a null would
        # bring them all to one task.
        unlike = F.lit(-(2**40)) - F.pmod(F.xxhash64("query_id"), F.lit(2**20))
        entry = F.coalesce(F.col("first.priority").cast("long"), unlike)
        table_side = capped.withColumn("entry", F.col("priority").cast("long")).drop("priority")
        return (
            first.select("query_id", "query", entry.alias("_entry"), F.col("first.key").alias("_key"))
            .join(broadcast_if_small(table_side, broadcast_keys), same & (F.col("entry") == F.col("_entry")), "left")
            .select("query_id", "query", "key", "answer", "results")
        )
    lowered = F.lower("query")
    ordered = sorted(entries, key=lambda e: (e["priority"], e["key"] or ""))
    number = table.schema["priority"].dataType
    place = [F.struct(F.lit(e["priority"]).cast(number).alias("_priority"), F.lit(e["key"]).alias("_key")) for e in ordered]
    tests = [F.when(occurs(lowered, e["key"], word), at) for e, at in zip(ordered, place, strict=True)]
    none = F.struct(F.lit(None).cast(number).alias("_priority"), F.lit(None).cast("string").alias("_key"))
    first = F.coalesce(*tests) if tests else none
    return (
        queries.select("query_id", "query", first.alias("first"))
        .select("query_id", "query", "first.*")
        # No more than inline_keys rows.
        .join(F.broadcast(capped), same & (F.col("priority") == F.col("_priority")), "left")
        .select("query_id", "query", "key", "answer", "results")
    )


def with_fallback(
    looked_up: DataFrame,
    answer: str = "No stored answer for: '{}'.",
    title: str = "What a search finds on '{}'",
    content: str = "No stored result about '{}'.",
    url: str = SEARCH_URL,
    max_results: int = MAX_RESULTS,
) -> DataFrame:
    """Fill queries without an entry with a generated answer and one generated result.

    ``{}`` stands for the query; in the address its spaces become ``+``. Adds ``source``
    (``stored`` or ``generated``) and ``status``.
    """
    if max_results < 0:
        raise ValueError("max_results must not be negative")

    def filled(template: str):
        return F.replace(F.lit(template), F.lit("{}"), F.col("query"))

    address = F.concat(F.lit(url), F.replace(F.col("query"), F.lit(" "), F.lit("+")))
    generated = F.struct(
        filled(title).alias("title"), address.alias("url"), filled(content).alias("content")
    )
    missing = F.col("key").isNull()
    return looked_up.select(
        "query_id",
        "query",
        F.when(missing, filled(answer)).otherwise(F.col("answer")).alias("answer"),
        F.when(missing, F.slice(F.array(generated), 1, max_results))
        .otherwise(F.col("results"))
        .alias("results"),
        F.when(missing, "generated").otherwise("stored").alias("source"),
        F.lit("success").alias("status"),
    )


def prefer(
    primary: DataFrame, fallback: DataFrame, key: str = "query_id", valid: str = "valid"
) -> DataFrame:
    """For every row of ``fallback``: the columns of ``primary`` where it has the key and is
    ``valid``, otherwise its own.

    ``source`` tells which: ``primary``, ``fallback`` (no reply stored), or
    ``fallback_after_error`` (a reply that is not well-formed). Keys are unique on each side.
    """
    columns = [c for c in fallback.columns if c != key]
    offered = primary.select(
        key, F.struct(*columns).alias("_primary"), F.coalesce(F.col(valid), F.lit(False)).alias("_valid")
    )
    source = F.when(F.col("_valid"), "primary").when(
        F.col("_valid").isNull(), "fallback"
    ).otherwise("fallback_after_error")
    return fallback.join(offered, key, "left").select(
        key,
        *[
            F.when(F.col("_valid"), F.col("_primary")[c]).otherwise(F.col(c)).alias(c)
            for c in columns
        ],
        source.alias("source"),
    )
