"""Unit conversion by a table of affine formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.numbers import round_score
from lectern.operators.sizing import broadcast_if_small

CONVERSION_SCHEMA = "from_unit string, to_unit string, pre double, mul double, div double, post double"

# result = (value + pre) * mul / div + post.
CONVERSIONS = [
    ("km", "miles", 0.0, 0.621371, 1.0, 0.0),
    ("miles", "km", 0.0, 1.60934, 1.0, 0.0),
    ("celsius", "fahrenheit", 0.0, 9.0, 5.0, 32.0),
    ("fahrenheit", "celsius", -32.0, 5.0, 9.0, 0.0),
    ("kg", "lbs", 0.0, 2.20462, 1.0, 0.0),
    ("lbs", "kg", 0.0, 1.0, 2.20462, 0.0),
    ("meters", "feet", 0.0, 3.28084, 1.0, 0.0),
    ("feet", "meters", 0.0, 1.0, 3.28084, 0.0),
]

# A conversion table of up to this many rows is broadcast.
_SMALL_TABLE = 10_000


def conversion_table(spark: SparkSession) -> DataFrame:
    """The built-in conversions."""
    return spark.createDataFrame(CONVERSIONS, CONVERSION_SCHEMA)


def supported_units(table: DataFrame) -> DataFrame:
    """One row: the sorted distinct units of both sides of a conversion table."""
    both = table.select(F.col("from_unit").alias("unit")).union(table.select("to_unit"))
    return both.agg(F.array_sort(F.collect_set("unit")).alias("supported_units"))


def convert_units(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Add ``result, status, error, supported_units`` to rows of ``value, from_unit, to_unit``.

    Unit names are compared in lower case; the pair must be in the table as it stands (no
    inverse, no same-unit pair). An unknown pair gives an ``error`` row that names the
    supported units, a result that is NaN or infinite is an ``error`` without them. Results are
    rounded to four places.
    """
    table = conversion_table(df.sparkSession) if table is None else table
    known = table.select(
        F.col("from_unit").alias("_from"),
        F.col("to_unit").alias("_to"),
        "pre",
        "mul",
        "div",
        "post",
    )
    pair = (F.lower("from_unit") == F.col("_from")) & (F.lower("to_unit") == F.col("_to"))
    found = F.col("_from").isNotNull()
    value = (F.col("value") + F.col("pre")) * F.col("mul") / F.col("div") + F.col("post")
    # Null stays a conversion without a result; NaN and infinity are none.
    finite = F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(True))
    # Fixed value: the wording for a pair that is not in the table.
    error = F.concat(F.lit("Unsupported conversion: "), "from_unit", F.lit(" -> "), "to_unit")
    return (
        df.join(broadcast_if_small(known, _SMALL_TABLE), pair, "left")
        .withColumns(
            {
                "result": F.when(finite, round_score(value)),
                "status": F.when(found & finite, "success").otherwise("error"),
                "error": F.when(~found, error).when(~finite, F.lit("The result is not a finite number")),
                "supported_units": F.when(~found, supported_units(table).scalar()),
            }
        )
        .drop("_from", "_to", "pre", "mul", "div", "post")
    )


def requested_units(requests: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Per unit that requests name or the table knows: how often it is asked for, and whether
    the table supports it.
    """
    table = conversion_table(requests.sparkSession) if table is None else table

    def both(df: DataFrame, asked: int, known: bool) -> DataFrame:
        units = F.explode(F.array(F.lower("from_unit"), F.lower("to_unit")))
        return df.select(units.alias("unit"), F.lit(asked).alias("asked"), F.lit(known).alias("known"))

    return (
        both(requests, 1, False)
        .unionByName(both(table, 0, True))
        .groupBy("unit")
        .agg(F.sum("asked").alias("n_requests"), F.bool_or("known").alias("supported"))
    )
