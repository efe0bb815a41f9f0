"""The operators as queries over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.numbers import divide, factorial, logarithm, modulo, round_score
from lectern.functions.text import source_name
from lectern.functions.vectors import cosine
from lectern.operators import evaluation, routing
from lectern.operators.chunks import chunk_pages, index_stats, new_chunks, with_ids
from lectern.operators.context import format_context
from lectern.operators.embedding import embed, hash_embed
from lectern.operators.formulas import formula_columns
from lectern.operators.inverted import search_approx, store_cells
from lectern.operators.lookup import LOOKUP_SCHEMA, keyword_lookup, prefer, with_fallback
from lectern.operators.numbering import number_rows
from lectern.operators.responses import envelope, normalise_responses
from lectern.operators.search import search, search_batch, search_stats
from lectern.operators.sessions import session_history, turn_pairs
from lectern.operators.sizing import spread
from lectern.operators.units import convert_units, requested_units
from lectern.plans.evaluation import evaluate
from lectern.plans.knowledge import answer, build_index, index_rows, search_texts
from lectern.session import scratch_path, stored_table
from lectern.sources.index import (
    check_dimension,
    check_unique,
    clear_index,
    compact_index,
    ensure_index,
    scan_index,
    stored_rows,
    write_index,
)
from lectern.sources.pages import numbered_pages, read_pages
from lectern.streaming.index_stream import stream_index

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books: one per source, pages in the order of ``doc_id``, which is their key."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return read_pages(documents, "source", "doc_id", "text", with_key=True)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


# --- pages, chunks, index -----------------------------------------------------------------


@query
def read_pages_(spark, sf_dir):
    return read_pages(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query
def source_name_(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", source_name(F.col("url")).alias("name"))


@query
def chunk_pages_(spark, sf_dir):
    return chunk_pages(book_pages(spark, sf_dir)).select("source", "page_num", "start", "content")


@query
def chunk_ids(spark, sf_dir):
    return with_ids(chunk_pages(book_pages(spark, sf_dir))).select("id", "source", "page_num", "start")


def _stored(index: DataFrame) -> DataFrame:
    return index.groupBy("source").agg(
        F.count_distinct("id").alias("n_ids"),
        F.sum(F.length("content")).alias("n_characters"),
        F.sum(F.size("embedding")).alias("n_components"),
    )


@query
def index_write(spark, sf_dir):
    path = scratch_path(spark, "index")
    build_index(book_pages(spark, sf_dir), path)
    return _stored(scan_index(spark, path))


@query
def index_append(spark, sf_dir):
    """Chunks of all documents are stored and cleared, those of labelled ones stored again; all others are
    appended, then some of them once more, which the key refuses.
    """
    path = scratch_path(spark, "index")
    chunks = with_ids(chunk_pages(book_pages(spark, sf_dir))).withColumn("embedding", F.array().cast("array<float>"))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("page_key"))
    write_index(chunks, path, unique=False)
    clear_index(spark, path)
    write_index(chunks.join(labelled, "page_key", "left_semi"), path)
    write_index(chunks.join(labelled, "page_key", "left_anti"), path, "append")
    try:
        write_index(chunks.where("page_num = 1"), path, "append")
    except ValueError:
        return scan_index(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("id").alias("n_ids"))
    raise AssertionError("ids were stored twice")


@query
def index_count(spark, sf_dir):
    """Adding the same pages once more must not change the count."""
    path = scratch_path(spark, "index")
    pages = book_pages(spark, sf_dir)
    build_index(pages, path)
    build_index(pages, path, recreate=False)
    return scan_index(spark, path).agg(F.count(F.lit(1)).alias("n_chunks"))


@query
def ensure_index_(spark, sf_dir):
    path = scratch_path(spark, "index")
    pages = book_pages(spark, sf_dir)
    ensure_index(spark, path, lambda: index_rows(pages))
    return _stored(ensure_index(spark, path, lambda: index_rows(pages)))


@query
def duplicate_ids(spark, sf_dir):
    """Ids made of the text alone, so copies of a document offend."""
    documents = table(spark, sf_dir, "documents")
    return check_unique(documents.select(F.sha2("text", 256).alias("id")))


@query
def bad_dimension(spark, sf_dir):
    """Vectors of two labels are spoilt: one loses a component, one the whole vector."""
    given = table(spark, sf_dir, "embeddings")
    spoilt = (
        F.when(F.col("label") == 1, F.slice("embedding", 1, 63))
        .when(F.col("label") == 2, F.lit(None))
        .otherwise(F.col("embedding"))
    )
    return check_dimension(given.select(F.col("vec_id").alias("id"), spoilt.alias("embedding")), 64)


@query
def new_chunks_(spark, sf_dir):
    """Labelled documents were indexed earlier; what do all documents add?"""
    documents = number_rows(table(spark, sf_dir, "documents"), "source", ["doc_id"], "page_num")
    earlier = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")

    def chunks(df: DataFrame) -> DataFrame:
        return with_ids(chunk_pages(numbered_pages(df, "source", "page_num", "text", "doc_id")))

    return new_chunks(chunks(documents), chunks(earlier)).select("id", "source", "page_num", "start")


def _reindexed(spark: SparkSession, sf_dir: str) -> str:
    """Labelled documents were indexed earlier, the English ones as drafts; then all documents come
    as they are now. Most pages have other numbers by then.
    """
    path = scratch_path(spark, "index")
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    draft = F.when(F.col("lang") == "en", F.concat(F.lit("Draft. "), "text")).otherwise(F.col("text"))
    earlier = documents.join(labels, "doc_id", "left_semi").withColumn("text", draft)
    # Stored, as an index looks at its pages twice and each look would move the texts to their numbers.
    build_index(stored_table(read_pages(earlier, "source", "doc_id", "text", with_key=True), "earlier"), path)
    build_index(stored_table(book_pages(spark, sf_dir), "pages"), path, recreate=False)
    return path


@query
def reindex(spark, sf_dir):
    return scan_index(spark, _reindexed(spark, sf_dir)).select("id", "source", "page_num", "start", "content")


@query
def index_compacted(spark, sf_dir):
    """The same after its logs were folded into the files: the rows are all that is stored."""
    path = _reindexed(spark, sf_dir)
    compact_index(spark, path, share=0.0, updates=0)
    return stored_rows(spark, path).select("id", "source", "page_num", "start", "content")


@query
def reindex_inserted(spark, sf_dir):
    """Every book gets its first page last: how many rows that writes, how many are dead afterwards, and
    whether all pages have their new numbers.
    """
    path = scratch_path(spark, "index")
    pages = book_pages(spark, sf_dir)
    later = pages.where("page_num > 1").withColumn("page_num", F.col("page_num") - 1)
    build_index(later, path)
    before = stored_rows(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n_before"))
    before = stored_table(before, "before")
    build_index(pages, path, recreate=False)
    stored = stored_rows(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n_stored"))
    counted = scan_index(spark, path).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("page_num").alias("page_numbers"), F.count_distinct("page_num").alias("n_pages")
    )
    whole = counted.join(stored, "source").join(before, "source", "left")
    return whole.select(
        "source",
        "n_chunks",
        "n_pages",
        "page_numbers",
        (F.col("n_stored") - F.coalesce("n_before", F.lit(0))).alias("n_written"),
        (F.col("n_stored") - F.col("n_chunks")).alias("n_dead"),
    )


@query
def index_stats_(spark, sf_dir):
    return index_stats(chunk_pages(book_pages(spark, sf_dir)))


@query
def stream_index_(spark, sf_dir):
    """Pages arrive as files; the stream indexes them in several batches."""
    arriving, index = scratch_path(spark, "pages"), scratch_path(spark, "index")
    book_pages(spark, sf_dir).repartition(4, "source", "page_num").write.parquet(arriving)
    stream = (
        spark.readStream.schema("source string, page_num int, content string")
        .option("maxFilesPerTrigger", 2)
        .parquet(arriving)
    )
    stream_index(stream, index, scratch_path(spark, "progress"), hash_embed).awaitTermination()
    return scan_index(spark, index).select("source", "page_num", "start", "content")


# --- vectors ------------------------------------------------------------------------------

LETTERS = "aeinrst"


def letter_model() -> Callable:
    """A stand-in for a model: counts of a few letters."""

    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([[text.count(c) for c in LETTERS] for text in texts], dtype=np.float32)

    return predict


@query
def embed_batch(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    embedded = embed(documents, letter_model, text="text")
    counts = [F.col("embedding")[i].cast("long").alias(f"n_{c}") for i, c in enumerate(LETTERS)]
    return embedded.select("doc_id", *counts)


@query
def hash_embed_(spark, sf_dir):
    """The components of every document's vector that are not zero."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    embedded = hash_embed(documents, text="text")
    return (
        embedded.select("doc_id", F.posexplode("embedding").alias("bucket", "value"))
        .where("value > 0")
        .select("doc_id", "bucket", round_score(F.col("value").cast("double")).alias("weight"))
    )


@query
def cosine_pairs(spark, sf_dir):
    """Every vector with the one that follows it."""
    here = vectors(spark, sf_dir)
    following = here.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"))
    return here.join(following, "id").select(
        F.col("id").alias("vec_id"), round_score(cosine(F.col("embedding"), F.col("next"))).alias("score")
    )


@query
def search_one(spark, sf_dir):
    """The vectors nearest to the mean of all."""
    given = vectors(spark, sf_dir)
    mean = (
        given.select(F.posexplode("embedding").alias("at", "value"))
        .groupBy("at")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
        .orderBy("at")
        .collect()  # one row per component
    )
    hits = search(given, [row["value"] for row in mean], k=10)
    return hits.select(F.col("id").alias("vec_id"), "score")


def _all_against_all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    given = vectors(spark, sf_dir)
    return given.select(F.col("id").alias("query_id"), "embedding"), given


@query
def search_batch_(spark, sf_dir):
    return search_batch(*_all_against_all(spark, sf_dir)).withColumnRenamed("id", "vec_id")


@query
def search_split(spark, sf_dir):
    """The same search with the query table treated as too large to broadcast at once, the index as one of
    many splits, and the hits as too many to broadcast.
    """
    hits = search_batch(
        *_all_against_all(spark, sf_dir), query_bytes=1024 * 64 * 8, sampled_splits=1, broadcast_hits=0
    )
    return hits.withColumnRenamed("id", "vec_id")


@query
def search_labels(spark, sf_dir):
    """Vectors of one label lose a component; the others are searched among all, with labels fetched by a
    filter of the hits' ids.
    """
    given = table(spark, sf_dir, "embeddings")
    spoilt = F.when(F.col("label") == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    chunks = given.select(F.col("vec_id").alias("id"), spoilt.alias("embedding"), "label")
    queries = chunks.select(F.col("id").alias("query_id"), "embedding")
    return search_batch(queries, chunks, dim=64, broadcast_hits=0).withColumnRenamed("id", "vec_id")


@query
def search_approx_(spark, sf_dir):
    path = scratch_path(spark, "cells")
    queries, chunks = _all_against_all(spark, sf_dir)
    store_cells(chunks, path, cells=16)
    return search_approx(queries, path, probes=12).withColumnRenamed("id", "vec_id")


@query
def search_stats_(spark, sf_dir):
    return search_stats(search_batch(*_all_against_all(spark, sf_dir)))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("content")
    )


@query
def format_context_(spark, sf_dir):
    """Index all documents, then answer every benchmark text from the index."""
    return answer(spark, scratch_path(spark, "index"), _asked(spark, sf_dir), book_pages(spark, sf_dir))


@query
def format_context_some(spark, sf_dir):
    """Items of fewer than 150 characters ask without a word, and hits that score 0.6 or less do not count, so many
    queries have none.
    """
    path = scratch_path(spark, "index")
    build_index(book_pages(spark, sf_dir), path)
    asked = _asked(spark, sf_dir)
    vague = asked.withColumn("content", F.when(F.length("content") < 150, "\u2603 \u2603").otherwise(F.col("content")))
    hits = search_texts(spark, path, vague).where("score > 0.6")
    return format_context(vague, hits)


@query
def search_texts_(spark, sf_dir):
    """The same, but the hits themselves."""
    return search_texts(spark, scratch_path(spark, "index"), _asked(spark, sf_dir), book_pages(spark, sf_dir))


# --- table tools --------------------------------------------------------------------------


@query
def formula_columns_(spark, sf_dir):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    formulas: dict[str, Column] = {
        "charge": price * (1 - F.col("l_discount")) * (1 + F.col("l_tax")),
        "per_unit": divide(price, quantity),
        "per_off": divide(price, F.col("l_discount")),
        "rest": modulo(-quantity, F.lit(7.0)),
        "root": F.sqrt(price),
        "wave": F.sin(quantity * F.pi() / 50),
        "swing": F.cos(quantity * F.pi() / 50),
        "grown": F.power(1 + F.col("l_discount"), F.lit(10)),
        "scale": logarithm(price, 10),
        "above": F.ln(quantity - 25),
        "orderings": factorial(quantity),
        "explosion": F.exp(quantity * 20),
        "below": F.sqrt(25 - quantity),
        "huge": price * float(2**60),
    }
    # Much to compute per row, from one file.
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    computed = formula_columns(lines, formulas)
    plain = [n for n in formulas if n not in ("explosion", "huge", "orderings")]
    return computed.select(
        "l_orderkey",
        "l_linenumber",
        *[round_score(F.col(n)).alias(n) for n in plain],
        "orderings",
        "rest_integral",
        "orderings_integral",
        "per_off_status",
        "above_status",
        "orderings_status",
        "explosion_status",
        "huge_integral",
        (F.col("huge") / float(2**60)).alias("huge"),
        *[f"{n}_{part}" for n in ("per_off", "below", "explosion") for part in ("error", "hint")],
    )


# The conversions asked for, by size of the part: one unknown pair, one in mixed case.
ASKED_UNITS = [
    ("km", "miles"),
    ("miles", "km"),
    ("celsius", "fahrenheit"),
    ("fahrenheit", "celsius"),
    ("kg", "lbs"),
    ("lbs", "kg"),
    ("meters", "feet"),
    ("feet", "meters"),
    ("gallons", "liters"),
    ("KM", "Miles"),
]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = (F.col("p_size") % len(ASKED_UNITS) + 1).cast("int")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_retailprice").alias("value"),
        F.element_at(F.lit([a for a, _ in ASKED_UNITS]), which).alias("from_unit"),
        F.element_at(F.lit([b for _, b in ASKED_UNITS]), which).alias("to_unit"),
    )


@query
def convert_units_(spark, sf_dir):
    return convert_units(_requests(spark, sf_dir)).drop("error", "supported_units")


@query
def convert_unknown(spark, sf_dir):
    return (
        convert_units(_requests(spark, sf_dir))
        .where("status = 'error'")
        .select("p_partkey", "error", F.array_join("supported_units", ",").alias("supported_units"))
    )


@query
def supported_units(spark, sf_dir):
    return requested_units(_requests(spark, sf_dir))


# Keyword table for part names. "ring" comes before "red", so "red ring" finds the former.
ENTRIES = [
    (1, "ring", "Rings are round.", [("On rings", "https://example.org/ring", "All about rings.")]),
    (
        2,
        "red",
        "Red parts are painted.",
        [
            ("On red", "https://example.org/red", "All about red."),
            ("On paint", "https://example.org/paint", "All about paint."),
        ],
    ),
    (3, "widget", "Widgets do everything.", [("On widgets", "https://example.org/widget", "All about widgets.")]),
    (4, "old", "Old and cold parts are kept apart.", []),
]


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.initcap("p_name").alias("query")
    )


def _entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, LOOKUP_SCHEMA)


def _titles(results: str) -> Column:
    return F.array_join(F.transform(results, lambda r: r["title"]), "; ").alias("titles")


@query
def keyword_lookup_(spark, sf_dir):
    found = keyword_lookup(_names(spark, sf_dir), _entries(spark), max_results=1)
    return found.select("query_id", "query", "key", "answer", _titles("results"))


def _word_entries(names: DataFrame) -> DataFrame:
    """An entry for every word of ``query``, longer ones first."""
    words = names.select(F.explode(F.split(F.lower("query"), " ")).alias("key")).distinct()
    numbered = number_rows(words.withColumns({"all": F.lit(1), "short": -F.length("key")}), "all", ["short", "key"], "priority")
    return numbered.select(
        F.col("priority").cast("int").alias("priority"),
        "key",
        F.concat(F.lit("about "), "key").alias("answer"),
        F.array().cast("array<struct<title:string,url:string,content:string>>").alias("results"),
    )


@query
def keyword_lookup_table(spark, sf_dir):
    """Keys taken from the data: every word of a part name, longer first."""
    names = _names(spark, sf_dir)
    found = keyword_lookup(names, _word_entries(names), inline_keys=0)
    return found.select("query_id", "key", "answer")


@query
def keyword_lookup_documents(spark, sf_dir):
    """Whole documents asked for whole benchmark texts, as if the keys were too many to be sent to the tasks."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    items = table(spark, sf_dir, "benchmark")
    entries = items.select(
        F.col("item_id").cast("int").alias("priority"),
        F.lower("text").alias("key"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("answer"),
        F.array().cast("array<struct<title:string,url:string,content:string>>").alias("results"),
    )
    found = keyword_lookup(documents, entries, inline_keys=0, broadcast_keys=0)
    return found.select("query_id", "key", "answer")


@query
def route_documents(spark, sf_dir):
    """Whole documents routed by words of part names, by the same way."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    label = F.when(F.length("term") % 2 == 0, routing.RAG).otherwise(routing.GENERAL)
    routed = routing.route_queries(documents, words.withColumn("label", label), inline_terms=0, broadcast_terms=0)
    return routed.select("query_id", "rag_hits", "general_hits", "label", "confidence")


@query
def lookup_fallback(spark, sf_dir):
    replies = with_fallback(keyword_lookup(_names(spark, sf_dir), _entries(spark)))
    return replies.select(
        "query_id",
        "answer",
        _titles("results"),
        F.array_join(F.transform("results", lambda r: r["url"]), "; ").alias("urls"),
        "source",
        "status",
    )


@query
def reply_json(spark, sf_dir):
    return envelope(with_fallback(keyword_lookup(_names(spark, sf_dir), _entries(spark))))


def _stored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored reply for each event: full, partly filled, without fields, or cut off."""
    events = spread(table(spark, sf_dir, "events"), "event_id")
    k = F.get_json_object("props", "$.k")
    full = F.format_string(
        '{"answer":"about %s","results":['
        '{"title":"first","url":"https://example.org/%s","content":"%s"},'
        '{"title":"second"},{"url":"https://example.org/third","content":null},{"title":"fourth"}]}',
        k,
        k,
        F.repeat(F.lit("long text "), k.cast("int")),
    )
    raw = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("<"), F.col("props")))
        .when(F.col("event_type") == "view", F.col("props"))
        .otherwise(full)
    )
    return events.select(F.col("event_id").alias("query_id"), "event_type", raw.alias("raw"))


def _tidy(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "query_id",
        "answer",
        _titles("results"),
        F.array_join(F.transform("results", lambda r: r["url"]), "; ").alias("urls"),
        F.aggregate("results", F.lit(0), lambda n, r: n + F.length(r["content"])).alias("n_content"),
        *more,
    )


@query
def normalise_responses_(spark, sf_dir):
    return _tidy(normalise_responses(_stored_replies(spark, sf_dir)), "valid")


@query
def prefer_primary(spark, sf_dir):
    """Purchases have no stored reply; events without a usable one get a reply of their own."""
    stored = _stored_replies(spark, sf_dir)
    primary = normalise_responses(stored.where("event_type <> 'purchase'").drop("event_type"))
    own = F.struct(
        F.lit("own").alias("title"), F.lit("").alias("url"), F.col("event_type").alias("content")
    )
    fallback = stored.select(
        "query_id",
        F.concat(F.lit("nothing on "), "event_type").alias("answer"),
        F.array(own).alias("results"),
    )
    return _tidy(prefer(primary, fallback), "source")


# --- routing and sessions -----------------------------------------------------------------

TERMS = [
    ("ring", routing.RAG),
    ("gear", routing.RAG),
    ("hot", routing.RAG),
    ("red", routing.GENERAL),
    ("widget", routing.GENERAL),
    ("small", routing.GENERAL),
]


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame(TERMS, routing.TERM_SCHEMA)
    return routing.route_queries(_names(spark, sf_dir), terms)


@query
def route_queries(spark, sf_dir):
    return _routed(spark, sf_dir)


@query
def route_learned(spark, sf_dir):
    """Learn from the labelled documents, then route all of them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query"))
    labels = table(spark, sf_dir, "labels")
    labelled = documents.join(labels, "doc_id").select("query", F.col("quality").alias("label"))
    return routing.route_learned(documents, routing.train_router(labelled)).select(
        "doc_id", "label", "confidence"
    )


@query
def parse_verdicts(spark, sf_dir):
    """Assistants state a verdict, users quote one without brackets, systems give none."""
    turns = table(spark, sf_dir, "conversations")
    reason = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    text = (
        F.when(
            F.col("role") == "assistant",
            F.concat(F.lit("Classification: [RAG] -- Reason: "), reason, F.lit("\nConfidence: HIGH")),
        )
        .when(F.col("role") == "user", F.concat(F.lit("Classification: GENERAL -- Reason: "), reason))
        .otherwise(F.col("text"))
    )
    verdicts = routing.parse_verdicts(turns.withColumn("text", text))
    return verdicts.select("conv_id", "turn", "label", "reason", "confidence")


@query
def dispatch(spark, sf_dir):
    def stored(queries: DataFrame) -> DataFrame:
        return keyword_lookup(queries, _entries(spark)).select("query_id", "key", "answer")

    def always(queries: DataFrame) -> DataFrame:
        replies = with_fallback(keyword_lookup(queries, _entries(spark)))
        return replies.select("query_id", "answer", "source")

    return routing.dispatch(_routed(spark, sf_dir), {routing.RAG: stored, routing.GENERAL: always})


@query
def session_history_(spark, sf_dir):
    return session_history(table(spark, sf_dir, "conversations"), last_n=3)


@query
def turn_pairs_(spark, sf_dir):
    """Turns lie ten apart, those with a comma in their first sentence are lost, and a system note follows each turn of
    several lines.
    """
    turns = table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn") * 10)
    kept = turns.where((F.instr("text", ",") == 0) | (F.instr("text", ",") > F.instr("text", ".")))
    notes = kept.where(F.contains("text", F.lit("\n"))).select(
        "conv_id", (F.col("turn") + 5).alias("turn"), F.lit("system").alias("role"), F.lit("a note").alias("text")
    )
    return turn_pairs(kept.select("conv_id", "turn", "role", "text").unionByName(notes))


# --- evaluation ---------------------------------------------------------------------------


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("category")
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are completed, open ones failed with a message, the rest without."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("category"),
        F.when(status == "F", evaluation.COMPLETED).otherwise(evaluation.ERROR).alias("status"),
        F.when(status == "O", F.concat(F.lit("still open: "), F.col("o_custkey").cast("string"))).alias("error"),
    )


@query
def eval_outcomes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    responses = orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.repeat(F.concat(F.lit("order of customer "), F.col("o_custkey").cast("string"), F.lit("; ")), 12).alias(
            "response"
        ),
        F.when(F.col("o_orderstatus") == "P", F.lit("partly shipped")).alias("error"),
    )
    # Orders of the lowest priority are cases without a response.
    answered = responses.where(orders["o_orderpriority"] != "5-LOW")
    return evaluation.eval_outcomes(_cases(spark, sf_dir), answered)


@query
def category_summary(spark, sf_dir):
    return evaluation.category_summary(_outcomes(spark, sf_dir))


@query
def overall_summary(spark, sf_dir):
    """Orders that are partly shipped have no outcome yet but count as cases."""
    orders = table(spark, sf_dir, "orders")
    outcomes = orders.where("o_orderstatus <> 'P'").select(
        F.when(F.col("o_orderstatus") == "F", evaluation.COMPLETED).otherwise(evaluation.ERROR).alias("status")
    )
    return evaluation.overall_summary(_cases(spark, sf_dir), outcomes)


@query
def distinct_categories(spark, sf_dir):
    return evaluation.distinct_categories(_outcomes(spark, sf_dir))


@query
def failed_cases(spark, sf_dir):
    return evaluation.failed_cases(_outcomes(spark, sf_dir))


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents should go to the retriever; English ones do."""
    good, english = F.col("quality") == 1, F.col("lang") == "en"
    cases = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(good, "Retriever Agent").otherwise("General Agent").alias("expected_agent"),
        F.when(good, evaluation.SEARCH_TOOL).alias("expected_tool"),
    )
    chosen = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(english, "Retriever Agent").otherwise("General Agent").alias("agent"),
        F.when(english & (F.col("n_chars") > 500), evaluation.SEARCH_TOOL).alias("tool"),
    )
    return evaluation.route_accuracy(cases, chosen)


@query
def route_accuracy(spark, sf_dir):
    return _accuracy(spark, sf_dir)


@query
def route_confusion(spark, sf_dir):
    table_ = evaluation.confusion_table(_accuracy(spark, sf_dir), ["Retriever Agent", "General Agent"])
    return table_.toDF("expected_agent", "to_retriever", "to_general")


def _run_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as the tree of a run: turns are nested runs, two turns apart."""
    turns = table(spark, sf_dir, "conversations")
    turn, text, role = F.col("turn"), F.col("text"), F.col("role")
    own = F.concat(F.lit("t"), turn.cast("string"))
    parent = F.when(turn < 2, "root").otherwise(F.concat(F.lit("t"), (turn - 2).cast("string")))
    none = F.lit(None).cast("string")

    def rows(node, above, position, kind, name, content) -> DataFrame:
        return turns.select(
            F.col("conv_id").alias("response_id"),
            node.alias("node_id"),
            above.alias("parent_id"),
            position.alias("position"),
            F.lit(kind).alias("kind"),
            name.alias("name"),
            content.alias("content"),
        )

    search_tool = F.lit(evaluation.SEARCH_TOOL)
    tool = F.when(role == "system", F.lit("calculator")).otherwise(search_tool)
    result = F.when((role == "assistant") & (turn > 2), text).when(role == "user", F.lit(""))
    said = F.when(turn % 3 == 2, text).otherwise(F.lit(""))
    return (
        rows(F.lit("root"), none, F.lit(0).cast("long"), "run", none, none)
        .distinct()
        .unionByName(rows(own, parent, turn, "member", none, none))
        .unionByName(rows(F.concat(own, F.lit("-tool")), own, turn, "tool", tool, result))
        .unionByName(rows(F.concat(own, F.lit("-message")), own, turn, "message", search_tool, said))
    )


@query
def retrieved_context(spark, sf_dir):
    return evaluation.retrieved_context(_run_trees(spark, sf_dir))


@query
def evaluate_(spark, sf_dir):
    """Each conversation is a case, its fourth turn the response; categories go by the number of turns."""
    turns = table(spark, sf_dir, "conversations")
    id = F.col("conv_id").cast("string").alias("id")
    counted = turns.groupBy(id).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" turns")).alias("category"))
    error = F.when(F.col("role") == "user", F.lit("asked back")).alias("error")
    responses = turns.where("turn = 3").select(id, F.col("text").alias("response"), error)
    nodes = _run_trees(spark, sf_dir).withColumn("response_id", F.col("response_id").cast("string"))
    report = evaluate(counted, responses, nodes)
    verdicts = report.categories.select("category", "passed", F.col("status").alias("category_status"))
    return report.outcomes.join(verdicts, "category")


# A trailing underscore only keeps a query apart from the operator it is named after.
QUERIES = {name.rstrip("_"): run for name, run in QUERIES.items()}
