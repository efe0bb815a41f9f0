"""Which operator should answer a query, and sending it there."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.matching import BROADCAST_KEYS, INLINE_KEYS, occurrences, occurs
from lectern.operators.sizing import rows_within
from lectern.session import scratch_path

RAG = "RAG"
GENERAL = "GENERAL"

TERM_SCHEMA = "term string, label string"

# Fixed value: the form in which a verdict is written down.
_VERDICT = r"Classification: \[?(RAG|GENERAL)\]? -- Reason: ([^\n]*)"


def route_queries(
    queries: DataFrame,
    terms: DataFrame,
    word: bool = False,
    inline_terms: int = INLINE_KEYS,
    broadcast_terms: int = BROADCAST_KEYS,
) -> DataFrame:
    """Add ``rag_hits, general_hits, label, confidence, reason`` to ``query_id, query``.

    Counts the terms of each label that are part of the query in lower case. More hits for
    retrieval give RAG, everything else is GENERAL. Confidence is HIGH if only one label has
    hits, MEDIUM if both have, LOW if none has. ``query_id`` must be unique.
    """
    terms = terms.select("term", "label").distinct()
    entries = rows_within(terms, inline_terms)
    if entries is None:
        texts = queries.select(F.col("query_id").alias("text_id"), F.lower("query").alias("text"))
        hits = occurrences(texts, terms.select(F.col("term").alias("key"), "label"), word, broadcast_terms)
        hits = hits.select(F.col("text_id").alias("query_id"), F.lit(None).cast("string").alias("query"), "key", "label")
        none = F.lit(None).cast("string")
        every = queries.select("query_id", "query", none.alias("key"), none.alias("label")).unionByName(hits)
        counted = every.groupBy("query_id").agg(
            F.max("query").alias("query"),
            F.count_distinct(F.when(F.col("label") == RAG, F.col("key"))).alias("rag_hits"),
            F.count_distinct(F.when(F.col("label") == GENERAL, F.col("key"))).alias("general_hits"),
        )
    else:
        lowered = F.lower("query")

        def hits_for(label: str) -> Column:
            tests = [occurs(lowered, e["term"], word) for e in entries if e["label"] == label]
            ones = [F.when(test, 1).otherwise(0) for test in tests]
            return reduce(lambda a, b: a + b, ones, F.lit(0)).cast("long")

        counted = queries.select(
            "query_id", "query", hits_for(RAG).alias("rag_hits"), hits_for(GENERAL).alias("general_hits")
        )
    rag, general = F.col("rag_hits"), F.col("general_hits")
    return counted.withColumns(
        {
            "label": F.when(rag > general, RAG).otherwise(GENERAL),
            "confidence": F.when((rag > 0) & (general > 0), "MEDIUM")
            .when((rag > 0) | (general > 0), "HIGH")
            .otherwise("LOW"),
            "reason": F.format_string("%d retrieval terms, %d general terms", rag, general),
        }
    )


# Texts with a word are counted in this many buckets of its hash, so a model has a fixed size.
TOKEN_BUCKETS = 1 << 16
# Weights are whole millionths, so that their sums do not depend on the order of adding.
_UNIT = 1_000_000


def _buckets(text: Column) -> Column:
    """Hash buckets of the distinct words of a text; none for null."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0))
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))
    return F.coalesce(buckets, F.array().cast("array<int>"))


def _in_units(odds: Column) -> Column:
    return F.floor(F.ln(odds) * _UNIT + 0.5)


def train_router(labelled: DataFrame) -> DataFrame:
    """A naive Bayes model from ``query, label`` (label 1 for RAG, 0 for GENERAL; null teaches nothing).

    One row: ``prior`` and ``weights``, log odds for RAG in millionths, of all texts and of each word
    bucket, with one added to every count. Counts are combined before the shuffle and number
    TOKEN_BUCKETS rows at most, whatever the size of ``labelled``.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("label").isNotNull()).select("query", (F.col("label") == 1).alias("rag"))
    counts = [F.count_if(F.col("rag")).alias("rag"), F.count_if(~F.col("rag")).alias("general")]
    seen = rows.select("rag", F.explode(_buckets(F.col("query"))).alias("bucket")).groupBy("bucket").agg(*counts)
    every = spark.range(TOKEN_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(seen, "bucket", "left").fillna(0, ["rag", "general"])
    total = lambda c: F.sum(c).cast("double") + TOKEN_BUCKETS
    table = filled.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "rag", "general"))).alias("t"),
        (total("general") / total("rag")).alias("scale"),
    )
    weight = lambda t: _in_units((t["rag"] + 1) / (t["general"] + 1) * F.col("scale"))
    prior = rows.agg(*counts).select(_in_units((F.col("rag") + 1) / (F.col("general") + 1)).alias("prior"))
    return table.select(F.transform("t", weight).alias("weights"), prior.scalar().alias("prior"))


def route_learned(queries: DataFrame, model: DataFrame, sure: float = 0.8, fair: float = 0.6) -> DataFrame:
    """Add ``label, confidence`` by the trained model: HIGH from ``sure``, MEDIUM from ``fair``.

    Row by row in the scan stage: the model is a scalar subquery of fixed size. Even odds are GENERAL.
    """
    odds = F.aggregate(
        _buckets(F.col("query")),
        F.col("_prior"),
        lambda total, bucket: total + F.get(F.col("_weights"), bucket),
    )
    least = lambda p: math.ceil(math.log(p / (1 - p)) * _UNIT)
    size = F.abs(F.col("_odds"))
    return (
        queries.withColumns({"_weights": model.select("weights").scalar(), "_prior": model.select("prior").scalar()})
        .withColumn("_odds", odds)
        .select(
            *queries.columns,
            F.when(F.col("_odds") > 0, RAG).otherwise(GENERAL).alias("label"),
            F.when(size >= least(sure), "HIGH").when(size >= least(fair), "MEDIUM").otherwise("LOW").alias("confidence"),
        )
    )


def parse_verdicts(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add ``label, reason, confidence`` found in a stored reply; null where it has none."""

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))

    return messages.withColumns(
        {
            "label": part(_VERDICT, 1),
            "reason": part(_VERDICT, 2),
            "confidence": part(r"\b(HIGH|MEDIUM|LOW)\b", 1),
        }
    )


def dispatch(routed: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Send the rows of each label to its operator and gather the answers in one table.

    Columns that only some answers have are null in the others; ``label`` tells which branch
    answered. Rows of a label without a branch are an error in the call, not dropped. The routed plan runs
    once, whatever the number of branches.
    """
    known = F.coalesce(F.col("label").isin(*branches), F.lit(False))
    checked = routed.withColumn(
        "label",
        F.when(known, F.col("label")).otherwise(
            F.raise_error(F.concat(F.lit("no branch for label "), F.coalesce("label", F.lit("null"))))
        ),
    )
    # Stored by branch, so that the routed plan runs once and each branch reads its own files.
    path = scratch_path(routed.sparkSession, "routed")
    number = F.coalesce(*[F.when(F.col("label") == label, i) for i, label in enumerate(branches)])
    checked.withColumn("_branch", number).write.partitionBy("_branch").parquet(path)
    stored = routed.sparkSession.read.schema(T.StructType([*checked.schema.fields, T.StructField("_branch", T.IntegerType())])).parquet(path)
    answers = [
        answer(stored.where(F.col("_branch") == i).drop("_branch")).withColumn("label", F.lit(label))
        for i, (label, answer) in enumerate(branches.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), answers)
