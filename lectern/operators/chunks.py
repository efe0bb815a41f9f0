"""Overlapping text windows and the identities of the resulting chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.operators.sizing import has_at_most

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200

# Windows cut from one slice of a page. A substring has to walk to its start, so windows cut
# straight from a long page cost the square of its length.
_WINDOWS_PER_SLICE = 64

# Ids up to this many are broadcast (64 hex characters each, some 40 MB with overhead).
_BROADCAST_IDS = 200_000


def _starts(text: str, last: Column | None, step: int) -> Column:
    end = F.length(text) - 1
    return F.sequence(F.lit(0), end if last is None else F.least(end, last), F.lit(step))


def chunk_pages(
    pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """``(source, page_num, start, content)``: windows of ``size`` characters every
    ``size - overlap``, trimmed after cutting, without the empty ones. A ``page_key`` is carried along.

    ``start`` counts from 0 and is the position of the window before trimming. Everything
    happens row by row: no shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is required")
    step = size - overlap
    slice_step = step * _WINDOWS_PER_SLICE
    last_start = slice_step - step
    page = [c for c in ("source", "page_key", "page_num") if c in pages.columns]

    windows = (
        pages.where(F.length("content") > 0)
        .select(*page, "content", F.explode(_starts("content", None, slice_step)).alias("_at"))
        .select(*page, "_at", F.substring("content", F.col("_at") + 1, F.lit(last_start + size)).alias("_slice"))
        .select(*page, "_at", "_slice", F.explode(_starts("_slice", F.lit(last_start), step)).alias("_in"))
    )
    # Exploding an array of one keeps the optimizer from folding the text's expression into
    # the filter and into whatever comes later, where it would be evaluated again and drag
    # the slice along.
    text = strip(F.substring("_slice", F.col("_in") + 1, F.lit(size)))
    return windows.select(
        *page,
        (F.col("_at") + F.col("_in")).alias("start"),
        F.explode(F.array(text)).alias("content"),
    ).where(F.length("content") > 0)


def chunk_id(
    source: str = "source", page: str = "page_num", start: str = "start", content: str = "content"
) -> Column:
    """The same text at the same place always gets the same id, so runs can be repeated; a revised
    text gets another one. A missing part is marked, so that it is not taken for another part.

    ``page`` should name what a page keeps when others are put before it, which its number is not.
    """
    parts = [F.col(source), F.col(page), F.col(start), F.sha2(F.col(content), 256)]
    marked = [F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit("~")) for part in parts]
    return F.sha2(F.concat_ws("|", *marked), 256)


def with_ids(chunks: DataFrame, deterministic: bool = True) -> DataFrame:
    """Add ``id``: from the chunk's place (by ``page_key`` if there is one) and text, or a random one."""
    page = "page_key" if "page_key" in chunks.columns else "page_num"
    return chunks.withColumn("id", chunk_id(page=page) if deterministic else F.expr("uuid()"))


def new_chunks(chunks: DataFrame, stored: DataFrame, broadcast_ids: int = _BROADCAST_IDS) -> DataFrame:
    """Chunks whose id (see ``chunk_id``) is not stored yet, each id once.

    The index is usually far larger than what is added. If the new chunks are few (counted),
    their ids are broadcast to find those already stored in one pass over the index's ids; the
    index is not shuffled. Otherwise both sides are joined by id, which spreads evenly. Both ways
    compare the same ids.
    """
    once = chunks.dropDuplicates(["id"])
    if not has_at_most(chunks.select("id"), broadcast_ids):
        return once.join(stored.select("id"), "id", "left_anti")
    known = stored.select("id").join(F.broadcast(chunks.select("id").distinct()), "id", "left_semi")
    # Distinct, so again no more rows than ids were broadcast.
    return once.join(F.broadcast(known.distinct()), "id", "left_anti")


def index_stats(chunks: DataFrame) -> DataFrame:
    """Per source: chunks, pages, and shortest, longest and mean chunk length."""
    length = F.length("content")
    return chunks.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_distinct("page_num").alias("n_pages"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.avg(length).alias("avg_length"),
    )
