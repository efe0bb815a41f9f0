"""Stored JSON replies: bringing them to one shape, and writing replies as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.lookup import MAX_RESULTS, RESULTS

RESPONSE_SCHEMA = f"answer string, results {RESULTS}, _bad string"

# Fixed value: characters kept of a result's text.
CONTENT_WIDTH = 500


def normalise_responses(
    df: DataFrame,
    raw: str = "raw",
    max_results: int = MAX_RESULTS,
    width: int = CONTENT_WIDTH,
) -> DataFrame:
    """Replace the JSON text in ``raw`` by ``answer, results, valid``.

    Missing fields become empty, the list is cut to ``max_results`` and each text to
    ``width`` characters. Text that is not a JSON object of this shape gives ``valid`` false
    and nulls, for ``lookup.prefer`` to fill.
    """
    if max_results < 0:
        raise ValueError("max_results must not be negative")
    parsed = F.from_json(
        raw, RESPONSE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    body = F.col("_body")
    valid = F.coalesce(body.isNotNull() & body["_bad"].isNull(), F.lit(False))

    def tidy(result: Column) -> Column:
        def text(name: str) -> Column:
            return F.coalesce(result[name], F.lit(""))

        return F.struct(
            text("title").alias("title"),
            text("url").alias("url"),
            F.substring(text("content"), 1, width).alias("content"),
        )

    listed = F.coalesce(body["results"], F.array().cast(RESULTS))
    kept = [c for c in df.columns if c != raw]
    return df.select(*kept, parsed.alias("_body")).select(
        *kept,
        F.when(valid, F.coalesce(body["answer"], F.lit(""))).alias("answer"),
        F.when(valid, F.transform(F.slice(listed, 1, max_results), tidy)).alias("results"),
        valid.alias("valid"),
    )


def envelope(df: DataFrame, key: str = "query_id", output: str = "reply") -> DataFrame:
    """``(key, reply)``: all other columns of a row as one JSON object, nulls left out."""
    fields = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*fields)).alias(output))
