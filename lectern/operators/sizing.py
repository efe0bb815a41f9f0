"""Size checks that stand before every broadcast, and the use of all cores for small inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# What a broadcast may weigh, measured as text.
BROADCAST_BYTES = 64 * 2**20


def rows_within(df: DataFrame, limit: int) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``limit``, otherwise None.

    Collecting a limit reads one part of the input after the other and stops when it has
    enough, so a large input costs no more than a small one. Never brings more than
    ``limit + 1`` rows to the driver.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def has_at_most(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` holds at most ``limit`` rows; stops reading after that."""
    return rows_within(df.select(F.lit(True).alias("row")), limit) is not None


def weigh(df: DataFrame) -> list[Column]:
    """Aggregates ``n_rows`` and ``n_bytes`` (as text) of the rows of ``df``."""
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(text), F.lit(0)).alias("n_bytes"),
    ]


def broadcast_if_small(df: DataFrame, rows: int, weight: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast after counting and weighing it; a larger one is left to the
    planner, which joins by sort and splits skewed keys.
    """
    size = df.agg(*weigh(df)).first()
    return F.broadcast(df) if size["n_rows"] <= rows and size["n_bytes"] <= weight else df


def splits(scan: DataFrame) -> int:
    """About how many pieces a table scan is read in, from the planner's estimate of its size; nothing runs."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bytes_each = scan.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")
    each = int(scan.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(bytes_each))
    return max(1, -(-size // max(1, each)))


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a table scan out by ``keys`` if it has fewer pieces than there are cores.

    For steps that compute much per row, over an input of few files that cannot be split. An
    input with a piece for every core is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if splits(scan) >= cores else scan.repartition(cores, *keys)
