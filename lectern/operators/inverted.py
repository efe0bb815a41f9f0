"""Approximate search on a stored inverted file: chunks are filed under the nearest of a few of their own
vectors, and a query reads only the cells nearest to it.

The cells' centres are rows of the table, those of least hash among different vectors, so storing needs no
training and the file can be made again from the same rows. Files are clustered by cell, so a search prunes
them where they are read; the table is shuffled once, when it is stored. Scores are exact; what is
missed are chunks in cells that were not probed. ``choose_probes`` measures how many cells it takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.search import (
    BROADCAST_QUERY_BYTES,
    TOP_K,
    _Best,
    _fitting,
    _matrix,
    _width,
    best_of_slabs,
    completed,
    query_slabs,
    search_batch,
)

CELLS = 64
PROBES = 16
_CENTRES, _SCHEMA = "_centres", "_schema"


def _units(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows without a direction are zero."""
    matrix = np.asarray(matrix, np.float64)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    usable = np.isfinite(length) & (length > 0)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=usable)


def _chosen(chunks: DataFrame, cells: int, dim: int) -> np.ndarray:
    """Up to ``cells`` different vectors with a direction, by least hash of their ids.

    A vector that many rows share counts once; the rows looked at are doubled until there are enough.
    """
    ordered = chunks.where(F.size("embedding") == dim).select("id", "embedding").orderBy(F.md5(F.col("id").cast("string")), "id")
    looked = 4 * cells
    while True:
        table = ordered.limit(looked).toArrow()
        _, vectors = _fitting(table["id"], table["embedding"], dim)
        matrix = np.asarray(_matrix(vectors, dim), np.float64) if len(vectors) else np.zeros((0, dim))
        matrix = matrix[_units(matrix).any(axis=1)]
        _, first = np.unique(matrix, axis=0, return_index=True)
        found = matrix[np.sort(first)][:cells]
        if len(found) == cells or table.num_rows < looked or looked >= 1024 * cells:
            return _units(found)
        looked *= 4


def store_cells(chunks: DataFrame, path: str, cells: int = CELLS, dim: int | None = None) -> None:
    """Write ``chunks`` (``id, embedding`` and any further columns) to ``path``, clustered by cell.

    Vectors of another width than ``dim`` (by default the one that all share) and those without a direction are
    filed in cell 0. A cell of most rows is written by several tasks.
    """
    spark = chunks.sparkSession
    dim = _width(chunks) if dim is None else dim
    centres = _chosen(chunks, cells, dim)
    held = spark.sparkContext.broadcast(centres)

    def cell(vectors: pa.Array) -> pa.Array:
        at, fitting = _fitting(pa.array(np.arange(len(vectors))), vectors, dim)
        out = np.zeros(len(vectors), np.int32)
        if len(held.value) and len(at):
            out[at.to_numpy()] = (_units(_matrix(fitting, dim)) @ held.value.T).argmax(axis=1)
        return pa.array(out)

    filed = chunks.withColumn("cell", F.arrow_udf(cell, T.IntegerType())(F.col("embedding")))
    filed.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(path)
    filed.limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{_SCHEMA}")  # a file even if there is no row
    rows = [(i, [float(x) for x in centre]) for i, centre in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{_CENTRES}")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("cell int, centre array<double>").parquet(f"{path.rstrip('/')}/{_CENTRES}").collect()
    return np.array([r["centre"] for r in sorted(rows)], np.float64)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path.rstrip('/')}/{_SCHEMA}").schema).parquet(path)


def _nearest(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each query, the nearest first."""
    return np.argsort(-(_units(queries) @ centres.T), axis=1, kind="stable")


def search_approx(
    queries: DataFrame,
    path: str,
    k: int = TOP_K,
    probes: int = PROBES,
    dim: int | None = None,
    query_bytes: int = BROADCAST_QUERY_BYTES,
) -> DataFrame:
    """Like ``search_batch`` on the file at ``path``, but each query only meets the chunks of the
    ``probes`` cells nearest to it.

    Cells that no query probes are not read, and nothing but hits is shuffled.
    """
    spark = queries.sparkSession
    if probes < 1:
        raise ValueError("probes must be at least 1")
    dim = _width(queries) if dim is None else dim
    table, centres = _table(spark, path), _centres(spark, path)
    rows = table.select("id", "embedding", "cell")

    def search_slab(held, schema: T.StructType) -> DataFrame:
        vectors = held.value[1]
        fits = len(centres) and len(vectors) and centres.shape[1] == vectors.shape[1]
        probed = _nearest(vectors, centres)[:, :probes] if fits else np.zeros((len(vectors), 1), np.int64)
        askers = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, asked = held.value
            best: dict[int, _Best] = {}
            for batch in batches:
                cells = batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cells).tolist():
                    if c in askers:
                        if c not in best:
                            best[c] = _Best(asked[askers[c]], k)
                        best[c].add(batch.filter(pa.array(cells == c)))
            for c, found in best.items():
                hits = found.hits(query_ids.take(pa.array(askers[c])))
                if hits is not None:
                    yield from hits.to_batches()

        return rows.where(F.col("cell").isin(list(askers))).mapInArrow(run, schema)

    # A query is held once for each cell it probes.
    hits, n_queries = best_of_slabs(queries, rows, k, dim, max(1, query_bytes // probes), search_slab)
    return completed(hits, table.drop("cell"), n_queries * k)


def choose_probes(queries: DataFrame, path: str, recall: float = 0.9, k: int = TOP_K, query_bytes: int = BROADCAST_QUERY_BYTES) -> tuple[int, float]:
    """The least number of cells to probe that finds a ``recall`` share of the exact hits of ``queries``, and
    the share it finds.

    Meant for a bounded sample of queries: they are searched exactly once, and each hit's cell is looked up
    in its query's order of cells.
    """
    spark = queries.sparkSession
    dim = _width(queries)
    table, centres = _table(spark, path), _centres(spark, path)
    ranks = []
    for query_ids, vectors, _ in query_slabs(queries, dim, query_bytes):
        if not len(query_ids) or not len(centres):
            continue
        order = np.argsort(_nearest(vectors, centres), axis=1)  # place of each cell in a query's order
        number = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
        asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], number)
        hits = search_batch(asked, table.select("id", "embedding", "cell"), k, dim).select("query_id", "cell").toArrow()
        ranks.append(order[hits["query_id"].to_numpy(), hits["cell"].to_numpy()])
    if not ranks or not sum(map(len, ranks)):
        return 1, 1.0
    needed = np.sort(np.concatenate(ranks)) + 1
    probes = int(needed[int(np.ceil(recall * len(needed))) - 1])
    return probes, float((needed <= probes).mean())
