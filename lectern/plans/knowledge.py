"""The whole way from pages to a context block per query."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.chunks import CHUNK_OVERLAP, CHUNK_SIZE, chunk_pages, new_chunks, with_ids
from lectern.operators.context import format_context
from lectern.operators.embedding import hash_embed
from lectern.operators.filters import may_be_in
from lectern.operators.search import TOP_K, search_batch
from lectern.operators.sizing import broadcast_if_small
from lectern.session import scratch_table, stored_table
from lectern.sources.index import (
    Written,
    append_chunks,
    compact_index,
    create_index,
    ensure_index,
    index_count,
    known_pages,
    log_moves,
    log_pages,
    moved_pages,
    replace_stale,
    scan_index,
    stored_rows,
    with_page_numbers,
    write_index,
)

# Changed pages up to this many are picked out by a broadcast of their keys.
BROADCAST_PAGES = 200_000

Embedder = Callable[[DataFrame], DataFrame]


def index_rows(
    pages: DataFrame,
    embed: Embedder = hash_embed,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Pages as rows of the index. One pass, no shuffle."""
    return embed(with_ids(chunk_pages(pages, size, overlap)))


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with ``page_key``; without one of their own they go by their number."""
    key = F.col("page_key" if "page_key" in pages.columns else "page_num").cast("string")
    return pages.select("source", key.alias("page_key"), "page_num", "content")


def page_digests(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``(source, page_key, page_num, digest, n_rows)``, one row per page: what its chunks depend on.

    A page that is given with several texts has one digest of all of them.
    """
    text = F.sha2(F.coalesce("content", F.lit("")), 256)
    whole = F.concat_ws("|", F.lit(size), F.lit(overlap), F.array_sort(F.collect_set(text)))
    return _keyed(pages).groupBy("source", "page_key").agg(
        F.max("page_num").cast("int").alias("page_num"), F.sha2(whole, 256).alias("digest"), F.count(F.lit(1)).alias("n_rows")
    )


def build_index(
    pages: DataFrame,
    path: str,
    embed: Embedder = hash_embed,
    recreate: bool = True,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> Written:
    """Store the chunks of ``pages``: anew, or bringing the sources among them up to date."""
    if not recreate:
        return update_index(pages, path, embed, size, overlap)
    with scratch_table(page_digests(pages, size, overlap), "pages") as given:
        chunks = with_ids(chunk_pages(_keyed(pages), size, overlap))
        # Ids are made of page, place and text, so only a page given twice can have one twice.
        if not given.where("n_rows > 1").isEmpty():
            chunks = chunks.dropDuplicates(["id"])
        written = write_index(embed(chunks), path, unique=False)
        log_pages(given.withColumn("gone", F.lit(False)), path)
    return written


def _judged(given: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Pages given now against those known of the same sources (or pages), one row each.

    ``changed``: new, or with another text; ``stale``: known chunks must go; ``moved``: has another number.
    """
    asked = given.select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    facts = F.struct("page_num", "digest", F.lit(True).alias("is"))
    none = F.lit(None).cast("struct<page_num:int,digest:string,is:boolean>")
    sides = given.select("source", "page_key", facts.alias("new"), none.alias("old")).unionByName(
        known.join(asked, same, "left_semi").select("source", "page_key", none.alias("new"), facts.alias("old"))
    )
    pages = sides.groupBy("source", "page_key").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    here, before = F.col("new").isNotNull(), F.col("old").isNotNull()
    differs = ~F.col("new.digest").eqNullSafe(F.col("old.digest"))
    return pages.select(
        "source",
        "page_key",
        F.coalesce("new.page_num", "old.page_num").alias("page_num"),
        F.coalesce("new.digest", "old.digest").alias("digest"),
        (~here).alias("gone"),
        (here & differs).alias("changed"),
        (before & differs).alias("stale"),
        (here & before & ~F.col("new.page_num").eqNullSafe(F.col("old.page_num"))).alias("moved"),
    )


def update_index(
    pages: DataFrame,
    path: str,
    embed: Embedder = hash_embed,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    given: tuple[str, ...] = ("source",),
) -> Written:
    """Let the index hold exactly the chunks of ``pages`` for all that ``given`` names among them.

    By default ``pages`` are whole sources: of these, the index then holds what a fresh one would,
    whatever was inserted, revised or taken out. With ``given=("source", "page_num")`` they are single
    pages, and other pages of the same source stay.

    Pages are compared by key and digest first, so only new and revised ones are cut and embedded; a page
    that has only moved gets its new number in a narrow log. Rows are written first, then the log of replaced
    chunks, then the pages: an update that was broken off is put right by running it again, and a
    reader in between may see a revised page's old chunks beside its new ones. Compacts the index when due.
    """
    spark = pages.sparkSession
    create_index(spark, path)
    pages, by = _keyed(pages), ["page_key" if c == "page_num" else c for c in given]
    known = known_pages(spark, path)
    if known is None:  # rows that were written without their pages
        known = scan_index(spark, path).select("source", "page_key", "page_num", F.lit(None).cast("string").alias("digest")).distinct()
    before, back, held = stored_rows(spark, path).count(), 0, None
    with scratch_table(page_digests(pages, size, overlap), "pages") as asked, scratch_table(_judged(asked, known, by), "judged") as judged:
        flags = ["gone", "changed", "stale", "moved"]
        n = judged.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(f).alias(f) for f in flags]).first()
        if n["changed"] or n["stale"]:
            todo = pages
            if n["changed"] < n["all"]:
                places = judged.where("changed").select(F.col("source").alias("_source"), F.col("page_key").alias("_key"))
                here = F.col("source").eqNullSafe(F.col("_source")) & F.col("page_key").eqNullSafe(F.col("_key"))
                todo = pages.join(broadcast_if_small(places, BROADCAST_PAGES), here, "left_semi")
            todo = with_ids(chunk_pages(todo, size, overlap))
            # Ids are made of page, place and text, so only a page given twice can have one twice.
            if not asked.where("n_rows > 1").isEmpty():
                todo = todo.dropDuplicates(["id"])
            with scratch_table(todo, "chunks") as chunks:
                stored = stored_rows(spark, path).select("id")
                passes = may_be_in(stored, "id", before)(F.col("id"))
                # Pages some of whose chunks are stored already, perhaps under another number.
                held = chunks.where(passes).join(stored, "id", "left_semi").select("source", "page_key").distinct()
                held = stored_table(held, "held")
                append_chunks(embed(chunks.where(~passes).unionByName(new_chunks(chunks.where(passes), stored))), path)
                back = replace_stale(spark, path, judged.where("stale") if n["stale"] else None, chunks.select("id"))
        earlier = [pages for pages in (held, moved_pages(spark, path)) if pages is not None and not pages.isEmpty()]
        entries = judged.where("not gone and moved and not changed")
        if earlier:  # of changed pages only these have chunks, or an entry, with another number
            named = reduce(DataFrame.union, earlier).distinct().toDF("_source", "_key")
            same = F.col("source").eqNullSafe(F.col("_source")) & F.col("page_key").eqNullSafe(F.col("_key"))
            entries = entries.unionByName(judged.where("not gone and changed").join(named, same, "left_semi"))
        if n["moved"] or earlier:
            log_moves(entries, path)
        if n["gone"] or n["changed"] or n["moved"]:
            log_pages(judged.where("gone or changed or moved"), path)
    total = index_count(spark, path)
    added = stored_rows(spark, path).count() - before + back
    compact_index(spark, path)
    return Written(added, total)


def search_texts(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    pages: DataFrame | None = None,
    embed: Embedder = hash_embed,
    k: int = TOP_K,
) -> DataFrame:
    """``(query_id, rank, content, page_num, source, score)``: up to ``k`` hits of each of
    ``queries(query_id, content)`` in the index at ``path``, without rows for queries without hits.

    With ``pages``, an empty or missing index is built from them first.
    """
    if pages is None:
        index = scan_index(spark, path, page_numbers=False)
    else:
        index = ensure_index(spark, path, lambda: index_rows(pages, embed))
    asked = embed(queries.select("query_id", "content")).select("query_id", "embedding")
    hits = with_page_numbers(search_batch(asked, index.drop("start"), k), path)
    return hits.select("query_id", "rank", "content", "page_num", "source", "score")


def answer(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    pages: DataFrame | None = None,
    embed: Embedder = hash_embed,
    k: int = TOP_K,
) -> DataFrame:
    """``(query_id, context)`` for ``queries(query_id, content)``: the hits of ``search_texts`` as one block."""
    return format_context(queries, search_texts(spark, path, queries, pages, embed, k))
