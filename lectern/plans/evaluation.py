"""The whole way from stored responses to outcomes and summaries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from lectern.operators.evaluation import (
    category_summary,
    distinct_categories,
    eval_outcomes,
    failed_cases,
    overall_summary,
    retrieved_context,
)
from lectern.session import scratch_path


class Evaluation(NamedTuple):
    """What ``evaluate`` gives; all but ``outcomes`` are read from its stored rows."""

    outcomes: DataFrame
    categories: DataFrame
    category_names: DataFrame
    overall: DataFrame
    failures: DataFrame


def evaluate(cases: DataFrame, responses: DataFrame, nodes: DataFrame) -> Evaluation:
    """Judge ``cases(id, category)`` by ``responses(id, response, error)`` and their run trees.

    ``nodes`` are those of ``retrieved_context``, with the id of the case as ``response_id``. ``outcomes``
    has ``id, category, status, response_preview, error, context``; the context is null for cases whose run
    retrieved nothing or is not stored. Outcomes are stored once in the scratch folder.
    """
    spark = cases.sparkSession
    contexts = retrieved_context(nodes).withColumnRenamed("response_id", "id")
    judged = eval_outcomes(cases, responses).join(contexts, "id", "left")
    path = scratch_path(spark, "outcomes")
    judged.write.parquet(path)
    outcomes = spark.read.schema(judged.schema).parquet(path)
    return Evaluation(
        outcomes,
        category_summary(outcomes),
        distinct_categories(outcomes),
        overall_summary(cases, outcomes),
        failed_cases(outcomes),
    )
