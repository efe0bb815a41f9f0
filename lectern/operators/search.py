"""Exact cosine search for one query vector or a table of them.

Many queries against many chunks is a matrix product. It is worked off in blocks inside the
tasks, and a block only ever hands on its ``k`` best chunks per query; pairs are never rows of
a DataFrame. Blocks are screened in single precision, and everything within the error bound of
the k-th best is scored again in double, adding up in the order ``functions.vectors`` uses. The
result is exact and does not depend on how the rows are split.

Queries go to the chunks, which are read in place, as a broadcast. A query table too large for that is dealt into
groups and the chunks into pieces, and every group meets every piece in a task of its own. Over an index of
many splits or pieces, some are searched first: the k-th best score of a query there bounds what the others
need to hand on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.numbers import round_score
from lectern.operators.filters import may_be_in
from lectern.operators.sizing import has_at_most, splits
from lectern.session import scratch_path, stored_table

TOP_K = 5

# A query table is broadcast up to this many bytes of double precision vectors.
BROADCAST_QUERY_BYTES = 64 * 2**20
# Hits are broadcast to fetch their chunks up to this many rows (an id and three numbers each).
BROADCAST_HITS = 500_000
# Splits of an index from which a few of them are searched first.
SAMPLED_SPLITS = 16
# Cells of one product of a block of queries and a batch of chunks.
_PRODUCT_CELLS = 4_000_000
# Double precision vectors of a group of queries, or of a piece of the chunks, where both are dealt out.
_GROUP_BYTES = 32 * 2**20
# Pieces and groups are met in at least so many tasks a core, and chunks of a piece are multiplied so many at a time.
_TASKS_PER_CORE, _PIECE_BATCH = 3, 8192
# Pairs scored again at a time.
_PAIR_SLAB = 200_000

# Stands for an undefined score: below every cosine.
_UNDEFINED = -2.0


# --- the block product -------------------------------------------------------------------


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class _Vectors(NamedTuple):
    """Vectors with what the product needs: component-major doubles, squared lengths, units."""

    columns: np.ndarray  # (dim, n), double
    squares: np.ndarray  # (n,)
    units: np.ndarray  # (n, dim), single

    @staticmethod
    def of(matrix: np.ndarray) -> _Vectors:
        columns = np.ascontiguousarray(matrix.T, dtype=np.float64)
        squares = np.zeros(columns.shape[1])
        for component in columns:
            squares += component * component
        length = np.sqrt(squares)
        scale = np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)
        return _Vectors(columns, squares, (columns * scale).T.astype(np.float32))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """One row per vector; all of them must be ``dim`` wide."""
    flat = vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(flat) // dim, dim)


def _fitting(keys, vectors, dim: int) -> tuple[pa.Array, pa.Array]:
    """Keys and vectors of the rows that are ``dim`` wide.

    Checked here and not by a filter in the plan, which would evaluate an embedding model
    above the scan a second time.
    """
    keys, vectors = _plain(keys), _plain(vectors)
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    return keys.filter(fits), vectors.filter(fits)


def _scores(queries: _Vectors, chunks: _Vectors, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of the pairs ``(q[i], c[i])`` in double."""
    result = np.empty(len(q))
    for at in range(0, len(q), _PAIR_SLAB):
        qs, cs = q[at : at + _PAIR_SLAB], c[at : at + _PAIR_SLAB]
        total = np.zeros(len(qs))
        for left, right in zip(queries.columns, chunks.columns):
            total += left[qs] * right[cs]
        squares = queries.squares[qs] * chunks.squares[cs]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.clip(total / np.sqrt(squares), -1.0, 1.0)
        result[at : at + _PAIR_SLAB] = np.where(np.isnan(score), _UNDEFINED, score)
    return result


def _similarity(vector: list[float]):
    query = _Vectors.of(np.array([vector], dtype=np.float64))

    def scores(vectors: pa.Array) -> pa.Array:
        at, fitting = _fitting(pa.array(np.arange(len(vectors))), vectors, len(vector))
        chunks = _Vectors.of(_matrix(fitting, len(vector)))
        rows = np.arange(len(at))
        score = np.full(len(vectors), _UNDEFINED)
        score[at.to_numpy()] = _scores(query, chunks, np.zeros_like(rows), rows)
        return pa.array(score, mask=score == _UNDEFINED)

    return scores


def search(
    chunks: DataFrame,
    vector: list[float],
    k: int = TOP_K,
    key: str = "id",
) -> DataFrame:
    """The ``k`` chunks most similar to ``vector``: all columns but the embedding, ``score``.

    Rows with an undefined score come last, equal scores are ordered by ``key``, which must be unique.
    Only keys and embeddings are read for the scores, and each task keeps only its ``k`` best; the
    other columns are fetched for these.
    """
    similarity = F.arrow_udf(_similarity([float(x) for x in vector]), T.DoubleType())
    kept = [c for c in chunks.columns if c != "embedding"]
    order = [F.desc_nulls_last("score"), key]
    best = chunks.select(key, similarity(F.col("embedding")).alias("score")).orderBy(*order).limit(k)
    if kept != [key]:
        # No more than k rows.
        best = chunks.select(*kept).join(F.broadcast(best), key).select(*kept, "score").orderBy(*order).limit(k)
    return best.withColumn("score", round_score(F.col("score")))


class _Best:
    """The k best chunks of every query among the batches seen so far, of those that reach ``least``."""

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        self.queries = _Vectors.of(queries)
        self.k = k
        self.dim = queries.shape[1]
        self.kept: pa.Table | None = None
        self.least = np.full(len(queries), -np.inf) if least is None else least
        self.worst = self.least.copy()
        # Bound on the error of a single precision cosine.
        self.slack = np.float32(2 * (self.dim + 4) * 2.0**-23)

    def add(self, batch: pa.RecordBatch) -> None:
        ids, vectors = _fitting(batch.column("id"), batch.column("embedding"), self.dim)
        if not len(ids):
            return
        matrix = _matrix(vectors, self.dim)
        order = pc.sort_indices(ids)
        ids, matrix = ids.take(order), matrix[order.to_numpy()]
        ids, matrix = self._without_surplus_copies(ids, matrix)
        chunks = _Vectors.of(matrix)
        block = max(1, _PRODUCT_CELLS // max(1, len(matrix)))
        found = [
            self._candidates(chunks, at, min(at + block, len(self.worst)))
            for at in range(0, len(self.worst), block)
        ]
        q = np.concatenate([f[0] for f in found])
        c = np.concatenate([f[1] for f in found])
        if len(q):
            score = _scores(self.queries, chunks, q, c)
            reached = score >= self.least[q]
            self._keep(q[reached], ids.take(pa.array(c[reached])), score[reached])

    def _without_surplus_copies(self, ids: pa.Array, matrix: np.ndarray):
        """Leave out rows that cannot be hits: beyond the k lowest ids of equal vectors.

        Equal vectors have equal scores, and equal scores are ordered by id. Undefined
        vectors all rank alike, so they count as equal.
        """
        rows = np.ascontiguousarray(matrix)
        sums = rows.sum(axis=1, dtype=np.float64)
        undefined = ~np.isfinite(sums) | ~rows.any(axis=1)
        _, group, size = np.unique(
            np.where(undefined, np.inf, sums), return_inverse=True, return_counts=True
        )
        if size.max(initial=0) <= self.k:
            return ids, matrix
        # Only rows that share their sum with more than k others are compared in full.
        suspects = np.flatnonzero(size[group] > self.k)
        blank = undefined[suspects]
        content = rows[suspects].copy()
        content[blank] = np.inf
        as_bytes = content.view(np.dtype((np.void, content.dtype.itemsize * self.dim))).ravel()
        _, same = np.unique(as_bytes, return_inverse=True)
        by_group = np.argsort(same, kind="stable")
        sorted_groups = same[by_group]
        first = np.searchsorted(sorted_groups, sorted_groups, side="left")
        surplus = by_group[np.arange(len(by_group)) - first >= self.k]
        keep = np.ones(len(rows), dtype=bool)
        keep[suspects[surplus]] = False
        return ids.filter(pa.array(keep)), matrix[keep]

    def _candidates(self, chunks: _Vectors, begin: int, end: int):
        """Pairs (query, row) that may belong to the k best; rows are ordered by id."""
        n = chunks.units.shape[0]
        lit = (self.queries.squares[begin:end] > 0) & np.isfinite(self.queries.squares[begin:end])
        near = self.queries.units[begin:end] @ chunks.units.T
        # `not > 0` also catches NaN.
        near[:, ~(chunks.squares > 0) | ~np.isfinite(chunks.squares)] = _UNDEFINED
        floor = self.worst[begin:end].astype(np.float32) - self.slack
        if n > self.k and np.count_nonzero(near >= floor[:, None]) > 8 * self.k * len(floor):
            # The batches so far do not narrow this one down enough.
            best = np.partition(near, n - self.k, axis=1)[:, n - self.k]
            floor = np.maximum(floor, best - self.slack)
        # A query without direction scores undefined everywhere: its hits are the lowest ids.
        near[~lit] = np.where(np.arange(n) < self.k, 0.0, -np.inf)
        floor[~lit] = -1.0
        q, c = np.nonzero(near >= floor[:, None])
        return q + begin, c

    def _keep(self, q: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        fresh = pa.table({"q": pa.array(q, pa.int64()), "id": ids, "score": pa.array(score)})
        merged = fresh if self.kept is None else pa.concat_tables([self.kept, fresh])
        merged = merged.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        order = merged["q"].to_numpy()
        position = np.arange(len(order)) - np.searchsorted(order, order, side="left")
        keep = position < self.k
        self.kept = merged.filter(pa.array(keep)).combine_chunks()
        last = position == self.k - 1
        self.worst[order[last]] = merged["score"].to_numpy()[last]

    def hits(self, query_ids: pa.Array) -> pa.Table | None:
        if self.kept is None:
            return None
        score = self.kept["score"].to_numpy()
        return pa.table(
            {
                "query_id": query_ids.take(self.kept["q"].combine_chunks()),
                "id": self.kept["id"].combine_chunks(),
                "raw": pa.array(score, mask=score == _UNDEFINED),
            }
        )


def _hit_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", chunks.schema["id"].dataType),
            T.StructField("raw", T.DoubleType()),
        ]
    )


def _searched(rows: DataFrame, held, schema: T.StructType, k: int, every: int = 1, least: np.ndarray | None = None) -> DataFrame:
    """The k best rows of every query in each split, or in one of ``every`` splits; rows are read in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        query_ids, queries = held.value
        if not len(queries) or TaskContext.get().partitionId() % every:
            return
        best = _Best(queries, k, least)
        for batch in batches:
            best.add(batch)
        hits = best.hits(query_ids)
        if hits is not None:
            yield from hits.to_batches()

    return rows.mapInArrow(run, schema)


def _kth_best(hits: DataFrame, n_queries: int, k: int) -> np.ndarray:
    """The k-th best score of each query (by its number) among ``hits``, minus infinity where there are fewer."""
    order = Window.partitionBy("query_id").orderBy(F.desc("raw"))
    kth = hits.withColumn("raw", F.coalesce("raw", F.lit(_UNDEFINED))).withColumn("n", F.row_number().over(order))
    found = kth.where(F.col("n") == k).select("query_id", "raw").toArrow()  # a row for each query of a slab at most
    least = np.full(n_queries, -np.inf)
    least[found["query_id"].to_numpy()] = found["raw"].to_numpy()
    return least


def _width(queries: DataFrame) -> int:
    """The width all query vectors share; 1, which then fits none, where there is no vector at all."""
    width = F.when(F.size("embedding") > 0, F.size("embedding"))
    least, most = queries.agg(F.min(width), F.max(width)).first()
    if least != most:
        raise ValueError(f"query vectors are {least} to {most} wide; with dim, those of another width are left out")
    return 1 if least is None else least


def _held(part: DataFrame, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of queries on the driver."""
    few = part.toArrow()
    query_ids, vectors = _fitting(few["query_id"], few["query"], dim)
    return query_ids, np.array(_matrix(vectors, dim), dtype=np.float64)


def _asked(queries: DataFrame, dim: int) -> DataFrame:
    return queries.where(F.size("embedding") == dim).select("query_id", F.col("embedding").alias("query"))


def query_slabs(queries: DataFrame, dim: int, query_bytes: int) -> Iterator[tuple[pa.Array, np.ndarray, bool]]:
    """Ids and vectors of the queries of width ``dim``, at most about ``query_bytes`` on the driver at a time,
    and whether that is all of them.

    A larger table is written in slabs first, each of which is then read for itself.
    """
    spark = queries.sparkSession
    query = _asked(queries, dim)
    per_slab = max(1, query_bytes // (8 * dim))
    if has_at_most(query, per_slab):
        yield *_held(query, dim), True
        return
    path, slabs = scratch_path(spark, "queries"), math.ceil(2 * query.count() / per_slab)
    # Dealt by place and not by id, so that repeated ids spread as well.
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slabs))
    query.withColumn("slab", place).write.partitionBy("slab").parquet(path)
    for slab in range(slabs):
        part = spark.read.parquet(path).where(F.col("slab") == slab).select("query_id", "query")
        yield *_held(part.select(F.col("query_id").cast(query.schema["query_id"].dataType), "query"), dim), False


def best_of_slabs(queries: DataFrame, rows: DataFrame, k: int, dim: int, query_bytes: int, search_slab) -> tuple[DataFrame, int]:
    """Ranked hits (query_id, id, raw, rank) of all queries, and how many queries there are.

    ``search_slab(held, schema)`` gives the hits of a slab that was broadcast. A single slab stays a lazy
    plan; of several, each is searched and stored before the next one is fetched.
    """
    spark, schema = queries.sparkSession, _hit_schema(queries, rows)
    parts, asked = [], 0
    for query_ids, vectors, whole in query_slabs(queries, dim, query_bytes):
        asked += len(query_ids)
        held = spark.sparkContext.broadcast((query_ids, vectors))
        hits = _ranked(search_slab(held, schema), k)
        if whole:
            return hits, asked
        parts.append(stored_table(hits, "hits"))
        held.destroy()
    return reduce(DataFrame.unionByName, parts), asked


def _met(asked: DataFrame, rows: DataFrame, keys: list[str], k: int, dim: int, schema: T.StructType) -> DataFrame:
    """The k best ``rows`` of every query (n, query_id, query, least) among those that share its ``keys``."""

    def run(asked: pa.Table, chunks: pa.Table) -> pa.Table:
        vectors = np.array(_matrix(_plain(asked["query"]), dim), dtype=np.float64)
        best = _Best(vectors, k, asked["least"].to_numpy())
        for batch in chunks.to_batches(max_chunksize=_PIECE_BATCH) if len(vectors) else []:
            best.add(batch)
        hits = best.hits(pa.array(np.arange(len(vectors))))
        if hits is None:
            return pa.table([asked["query_id"][:0], chunks["id"][:0], asked["least"][:0], asked["n"][:0]], names=schema.names)
        of = hits["query_id"]
        return pa.table([asked["query_id"].take(of), hits["id"], hits["raw"], asked["n"].take(of)], names=schema.names)

    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, schema)


def dealt_hits(queries: DataFrame, rows: DataFrame, k: int, dim: int, sampled_splits: int) -> tuple[DataFrame, int]:
    """Ranked hits (query_id, id, raw, rank) of all queries, and how many queries there are, where the queries are
    too many to be sent to all tasks.

    A task holds one group of queries and one piece of the chunks, and all of them run in one job. From
    ``sampled_splits`` pieces on, the square root of their number is searched in a job before the others.
    """
    spark, keys = queries.sparkSession, ["_group", "_piece"]
    # Numbered by place and not by id, so that repeated ids spread as well.
    asked = stored_table(_asked(queries, dim).withColumn("n", F.monotonically_increasing_id()), "queries")
    n_queries, per_group = asked.count(), max(1, _GROUP_BYTES // (8 * dim))
    pieces = max(1, math.ceil(rows.count() / per_group))
    every = math.isqrt(pieces) if pieces >= sampled_splits else 1
    tasks = _TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    groups = min(n_queries, max(math.ceil(n_queries / per_group), math.ceil(tasks / math.ceil(pieces / every))))
    schema = _hit_schema(queries, rows).add("n", T.LongType())
    every_piece, every_group = (F.explode(F.sequence(F.lit(0), F.lit(most - 1))) for most in (pieces, groups))
    asked = asked.withColumn("_group", F.pmod(F.xxhash64("n"), F.lit(groups)).cast("int"))
    # By content, so that a second look at the chunks deals them alike.
    dealt = rows.withColumn("_piece", F.pmod(F.xxhash64("id", "embedding"), F.lit(pieces)).cast("int"))
    first = F.col("_piece") % every == 0

    def hits_of(least: DataFrame, some) -> DataFrame:
        return _met(least.withColumn("_piece", every_piece).where(some), dealt.where(some).withColumn("_group", every_group), keys, k, dim, schema)

    found = hits_of(asked.withColumn("least", F.lit(float("-inf"))), first)
    if every > 1:
        found = stored_table(_ranked(found, k, "n"), "sample")
        reached = found.where(F.col("rank") == k).select("n", F.coalesce("raw", F.lit(_UNDEFINED)).alias("least"))
        bounded = asked.join(reached, "n", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        found = found.drop("rank").unionByName(hits_of(bounded, ~first))
    return stored_table(_ranked(found.drop("n"), k), "hits"), n_queries


def _ranked(hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last("raw"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def completed(hits: DataFrame, chunks: DataFrame, most: int, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """Hits, at most ``most``, with the other chunk columns fetched for the hits alone.

    A moderate number is broadcast, so that the chunks are filtered where they are read. Of more, a Bloom
    filter of their ids goes to the scan, and only chunks that pass it are shuffled to meet them.
    """
    scored = hits.select("query_id", "rank", "id", round_score(F.col("raw")).alias("score"))
    extra = [c for c in chunks.columns if c not in ("id", "embedding")]
    if not extra:
        return scored
    wanted, told = scored, chunks.select("id", *extra)
    if most <= broadcast_hits:
        wanted = F.broadcast(scored)
    else:
        wanted = stored_table(scored, "hits")
        told = told.where(may_be_in(wanted, "id", most)(F.col("id")))
    return told.join(wanted, "id").select("query_id", "rank", "id", *extra, "score")


def search_batch(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = TOP_K,
    dim: int | None = None,
    query_bytes: int = BROADCAST_QUERY_BYTES,
    sampled_splits: int = SAMPLED_SPLITS,
    broadcast_hits: int = BROADCAST_HITS,
) -> DataFrame:
    """The ``k`` most similar chunks of every query.

    ``queries`` has ``query_id, embedding``; ``chunks`` has ``id, embedding`` and any further
    columns. Gives ``query_id, rank, id``, the further columns and ``score``. Vectors that are
    not ``dim`` wide are left out; ``sources.index.check_dimension`` names them. Without ``dim``, all
    query vectors must have one width.

    Up to ``query_bytes`` of query vectors are broadcast and the chunks are read in place; of more, groups of
    queries meet pieces of the chunks in tasks. From ``sampled_splits`` splits (or pieces) on, the square root of
    their number is searched first, and the others only hand on chunks that reach the k-th best score found there.
    Embeddings are dropped before the ranking, and only the hits are then completed with the chunks' texts.
    """
    width = _width(queries) if dim is None else dim
    rows = chunks.select("id", "embedding")
    asked = _asked(queries, width)
    if not has_at_most(asked, max(1, query_bytes // (8 * width))):
        hits, n_queries = dealt_hits(queries, rows, k, width, sampled_splits)
        return completed(hits, chunks, n_queries * k, broadcast_hits)
    context, schema, pieces = rows.sparkSession.sparkContext, _hit_schema(queries, rows), splits(rows)
    query_ids, vectors = _held(asked, width)
    least = None
    if pieces >= sampled_splits:
        numbered = context.broadcast((pa.array(np.arange(len(query_ids))), vectors))
        by_number = T.StructType([T.StructField("query_id", T.LongType()), *schema.fields[1:]])
        sample = _searched(rows, numbered, by_number, k, math.isqrt(pieces))
        least = _kth_best(sample, len(query_ids), k)
        numbered.destroy()
    hits = _ranked(_searched(rows, context.broadcast((query_ids, vectors)), schema, k, least=least), k)
    return completed(hits, chunks, len(query_ids) * k, broadcast_hits)


def search_stats(hits: DataFrame) -> DataFrame:
    """Per query: number of hits, best and lowest score."""
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.max("score").alias("top_score"),
        F.min("score").alias("lowest_score"),
    )
