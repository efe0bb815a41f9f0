"""Consecutive numbers within a group, also where one group holds most of the rows.

A plain ``row_number`` sends each group to one task. Here the keys alone are dealt out by ranges of
(group, order) and sorted; a row's place in its range is its number but for the rows of its group in earlier
ranges, which one small sum per range and group supplies. The numbers then meet the rows by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import scratch_path, stored_table

# Bits of ``monotonically_increasing_id`` that count within a partition.
_PLACE_BITS = 33


def place_rows(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``group`` and ``order`` of every row, with ``name``: 1, 2, 3 … within the group by ``order``.

    Rows that tie come in any order. The sorted keys are stored, since ranges drawn anew would cut
    elsewhere.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "places")
    keys = [F.col(group).alias("_group"), *[F.col(c).alias(f"_key{i}") for i, c in enumerate(order)]]
    narrow = df.select(*keys)
    ordered = narrow.repartitionByRange(*narrow.columns).sortWithinPartitions(*narrow.columns)
    ordered.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(narrow.withColumn("_at", F.lit(0).cast("long")).schema).parquet(path)
    placed = placed.withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    # One row for each range and group that meet: fewer than ranges and groups together.
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    first = first.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    first = first.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), "_first", "_before")
    met = placed.join(first, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.select(*narrow.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


def number_rows(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3 … within ``group`` by ``order``, which must be unique there.

    The numbers are stored, so that Spark knows their size: few of them go to the rows by a broadcast.
    """
    places = stored_table(place_rows(df, group, order, name), "numbers")
    same = F.col(group).eqNullSafe(F.col("_group"))
    for i, column in enumerate(order):
        same &= F.col(column).eqNullSafe(F.col(f"_key{i}"))
    return df.join(places, same).select(*df.columns, name)
