"""The chunk index: a Parquet table with a declared schema, and three narrow logs beside its files.

``_pages`` knows every page by its source and key, with its number and a digest of its text; ``_replaced``
names chunks that no longer count, and ``_moved`` pages whose number changed after their chunks were
written. Logs lie in the index's own folder under names that scans skip, are only ever appended to, and
the last entry counts. ``compact_index`` folds them into a fresh generation of files. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.filters import may_be_in
from lectern.session import file_system, scratch_table

_REPLACED, _REPLACED_SCHEMA = "_replaced/ids", "id string, gone boolean, at bigint"
_PAGES, _PAGES_SCHEMA = "_pages/log", "source string, page_key string, page_num int, digest string, gone boolean, at bigint"
_MOVED, _MOVED_SCHEMA = "_moved/log", "source string, page_key string, page_num int, at bigint"
_CURRENT, _GENERATION = "_current", "_generation-"

# Bits of a filter for each replaced id: of other ids one in a thousand passes.
_GONE_BITS = 64
# Share of dead rows, and number of logged updates, from which compaction pays.
DEAD_SHARE = 0.2
LOGGED_UPDATES = 64

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("page_num", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("page_key", T.StringType()),
    ]
)


class Written(NamedTuple):
    """What a write did: rows it added, and rows the table now holds."""

    added: int
    total: int


# --- files and logs ------------------------------------------------------------------------


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, none if it is missing."""
    files, place = file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def _generation(spark: SparkSession, path: str) -> int:
    return max(map(int, _names(spark, f"{path.rstrip('/')}/{_CURRENT}")), default=0)


def _home(spark: SparkSession, path: str) -> str:
    """The folder that holds the rows that count now: the index's own, or its latest generation."""
    generation = _generation(spark, path)
    return f"{path.rstrip('/')}/{_GENERATION}{generation}" if generation else path.rstrip("/")


def _log(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame | None:
    """A log, None as long as nothing was written to it."""
    try:
        return spark.read.schema(schema).parquet(f"{_home(spark, path)}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _updates(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the updates in a log; every update is a folder of its own."""
    return [int(n.removeprefix("at=")) for n in _names(spark, f"{_home(spark, path)}/{name}") if n.startswith("at=")]


def _append(entries: DataFrame, path: str, name: str) -> None:
    spark = entries.sparkSession
    at = max(_updates(spark, path, name), default=-1) + 1
    entries.write.mode("overwrite").parquet(f"{_home(spark, path)}/{name}/at={at}")


# --- the table -----------------------------------------------------------------------------


def create_index(spark: SparkSession, path: str) -> None:
    """Create the empty table unless something is stored at ``path``."""
    spark.createDataFrame([], INDEX_SCHEMA).write.mode("ignore").parquet(path)


def clear_index(spark: SparkSession, path: str) -> None:
    """Replace whatever is stored at ``path`` by the empty table."""
    spark.createDataFrame([], INDEX_SCHEMA).write.mode("overwrite").parquet(path)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, those that were replaced included."""
    return spark.read.schema(INDEX_SCHEMA).parquet(_home(spark, path))


def _gone(log: DataFrame) -> DataFrame:
    """Ids whose last entry says that they are gone."""
    return log.groupBy("id").agg(F.max_by("gone", "at").alias("gone")).where("gone").select("id")


def _same_page(df: DataFrame, other: DataFrame) -> tuple[DataFrame, object]:
    """``other`` with its keys renamed, and the condition that a row is of the same page."""
    named = other.withColumnsRenamed({"source": "_source", "page_key": "_key"})
    return named, F.col("source").eqNullSafe(F.col("_source")) & F.col("page_key").eqNullSafe(F.col("_key"))


def with_page_numbers(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with source, page_key, page_num as stored) with the numbers that the pages have now.

    A plain pass unless pages moved since; meant for hits, but right for any rows of the index.
    """
    log = _log(rows.sparkSession, path, _MOVED, _MOVED_SCHEMA)
    if log is None:
        return rows
    latest = log.groupBy("source", "page_key").agg(F.max_by("page_num", "at").alias("_now"))
    latest, same = _same_page(rows, latest)
    numbered = rows.join(latest, same, "left").withColumn("page_num", F.coalesce("_now", "page_num"))
    return numbered.select(*rows.columns)


def scan_index(spark: SparkSession, path: str, page_numbers: bool = True) -> DataFrame:
    """All chunks that count. Columns that are not used are never read.

    An index of which nothing was replaced or moved is a plain scan. Otherwise the scan tests rows against a filter
    of the replaced ids. Of those that pass, ids that are not replaced after all, very few, are found by ids
    alone. Rows that pass a filter of the moved pages, and only these, are shuffled to meet their numbers;
    ``page_numbers=False`` leaves numbers as they were written, for callers that look them up for a few rows only.
    """
    rows, log = stored_rows(spark, path), _log(spark, path, _REPLACED, _REPLACED_SCHEMA)
    moved = _log(spark, path, _MOVED, _MOVED_SCHEMA) if page_numbers else None
    if log is not None:
        gone = _gone(log)
        passes = may_be_in(gone, "id", gone.count(), _GONE_BITS)(F.col("id")) & F.col("id").isNotNull()
        kept = rows.select("id").where(passes).join(gone, "id", "left_anti").distinct()
        rows = rows.where(~passes).unionByName(rows.where(passes).join(kept, "id", "left_semi").select(*rows.columns))
    if moved is not None:
        page = F.xxhash64("source", "page_key")
        pages = moved.select(page.alias("page")).distinct()
        passes = may_be_in(pages, "page", pages.count())(page)
        rows = rows.where(~passes).unionByName(with_page_numbers(rows.where(passes), path))
    return rows


def index_count(spark: SparkSession, path: str) -> int:
    """Number of chunks that count; a missing table counts as empty.

    Taken from the file footers unless something was replaced.
    """
    create_index(spark, path)
    return scan_index(spark, path, page_numbers=False).count()


# --- pages ---------------------------------------------------------------------------------


def known_pages(spark: SparkSession, path: str) -> DataFrame | None:
    """``(source, page_key, page_num, digest)`` of the pages the index holds; None if it never heard of any."""
    log = _log(spark, path, _PAGES, _PAGES_SCHEMA)
    if log is None:
        return None
    last = F.max_by(F.struct("page_num", "digest", "gone"), "at").alias("last")
    now = log.groupBy("source", "page_key").agg(last).select("source", "page_key", "last.*")
    return now.where("not gone").drop("gone")


def log_pages(entries: DataFrame, path: str) -> None:
    """Note pages: source, page_key, page_num, digest, gone."""
    _append(entries.select("source", "page_key", "page_num", "digest", "gone"), path, _PAGES)


def log_moves(entries: DataFrame, path: str) -> None:
    """Note the present number of pages whose stored chunks have another one."""
    _append(entries.select("source", "page_key", "page_num"), path, _MOVED)


def moved_pages(spark: SparkSession, path: str) -> DataFrame | None:
    """``(source, page_key)`` of pages that have moved since chunks of theirs were written; None if none has."""
    log = _log(spark, path, _MOVED, _MOVED_SCHEMA)
    return None if log is None else log.select("source", "page_key").distinct()


def replace_stale(spark: SparkSession, path: str, places: DataFrame | None, ids: DataFrame) -> int:
    """Of the pages ``places`` (source, page_key), let only the chunks in ``ids`` count.

    Other chunks stored for these pages are logged as gone, and stored ones in ``ids`` that were
    gone come back. Nothing is rewritten. Without ``places`` chunks only come back. Returns how many did.
    """
    log = _log(spark, path, _REPLACED, _REPLACED_SCHEMA)
    parts = []
    if places is not None:
        rows = scan_index(spark, path, page_numbers=False).select("id", "source", "page_key")
        named, same = _same_page(rows, places.select("source", "page_key").distinct())
        stale = rows.join(named, same, "left_semi").join(ids, "id", "left_anti")
        parts.append(stale.select("id", F.lit(True).alias("gone")))
    if log is not None:
        parts.append(_gone(log).join(ids, "id", "left_semi").select("id", F.lit(False).alias("gone")))
    if not parts:
        return 0
    with scratch_table(reduce(DataFrame.unionByName, parts).distinct(), "entries") as entries:
        counts = entries.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("gone")).alias("back")).first()
        if counts["n"]:
            _append(entries, path, _REPLACED)
    return counts["back"]


# --- writes --------------------------------------------------------------------------------


def ids_stored(ids: DataFrame, path: str) -> DataFrame:
    """Those of ``ids`` (one column ``id``) that a row of the table carries, replaced rows included.

    Files whose range of ids lies outside that of ``ids`` are not read; the others are tested against a
    Bloom filter in the scan, and only rows that pass are compared. The table is not shuffled.
    """
    spark = ids.sparkSession
    found = ids.agg(F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    stored = stored_rows(spark, path).select("id")
    if not found["n"]:
        return stored.limit(0)
    near = stored.where(F.col("id").between(found["low"], found["high"]))
    return near.where(may_be_in(ids, "id", found["n"])(F.col("id"))).join(ids, "id", "left_semi").distinct()


def _refuse_doubles(chunks: DataFrame, path: str, mode: str) -> None:
    """Fail if an id is missing, comes twice, or is stored already."""
    with scratch_table(chunks.select(F.col("id").cast("string").alias("id")), "ids") as ids:
        doubles = ids.groupBy("id").count().where("count > 1 or id is null").select("id").limit(3).collect()
        if not doubles and mode == "append":
            doubles = ids_stored(ids, path).limit(3).collect()
    if doubles:
        raise ValueError(f"ids are missing, given twice or stored already, among them {[r['id'] for r in doubles]}")


def append_chunks(chunks: DataFrame, path: str, mode: str = "append", dim: int | None = None) -> None:
    """Write ``chunks`` (columns of the schema, in any order) without counting or comparing anything.

    With ``dim``, a vector that is missing or of another width fails the write. A missing ``page_key`` is
    the page's number.
    """
    columns = {f.name: F.col(f.name).cast(f.dataType) for f in INDEX_SCHEMA if f.name != "page_key"}
    columns["page_key"] = F.col("page_key" if "page_key" in chunks.columns else "page_num").cast("string")
    if dim is not None:
        unfit = F.raise_error(F.lit(f"a vector is missing or not {dim} wide"))
        fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
        columns["embedding"] = F.when(fits, columns["embedding"]).otherwise(unfit.cast(INDEX_SCHEMA["embedding"].dataType))
    target = path if mode == "overwrite" else _home(chunks.sparkSession, path)
    chunks.select(*[column.alias(name) for name, column in columns.items()]).write.mode(mode).parquet(target)


def write_index(chunks: DataFrame, path: str, mode: str = "overwrite", dim: int | None = None, unique: bool = True) -> Written:
    """Store ``chunks`` and count the table before and after.

    All vectors must be ``dim`` wide if that is given, and ids must be given once and not be stored yet; the
    write fails otherwise and adds nothing. ``unique=False`` leaves ids unchecked, for ids known to differ.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode is 'overwrite' or 'append'")
    spark = chunks.sparkSession
    before = index_count(spark, path) if mode == "append" else 0
    if unique:
        _refuse_doubles(chunks, path, mode)
    append_chunks(chunks, path, mode, dim)
    total = scan_index(spark, path, page_numbers=False).count()
    return Written(total - before, total)


def compact_index(spark: SparkSession, path: str, share: float = DEAD_SHARE, updates: int = LOGGED_UPDATES) -> bool:
    """Fold the logs into a new generation of files once more than ``share`` of the rows are dead or more
    than ``updates`` updates are logged; afterwards a scan is a plain scan again, with the same rows.

    The new generation counts from the moment its marker is made, so a compaction that was broken off
    changes nothing and is simply run again. The generation before it stays for scans that have begun;
    older ones are removed. Returns whether anything was done.
    """
    replaced = _log(spark, path, _REPLACED, _REPLACED_SCHEMA)
    logged = sum(len(_updates(spark, path, name)) for name in (_REPLACED, _PAGES, _MOVED))
    dead = 0 if replaced is None else _gone(replaced).count()
    if logged <= updates and (not dead or dead <= share * stored_rows(spark, path).count()):
        return False
    root, generation = path.rstrip("/"), _generation(spark, path) + 1
    target = f"{root}/{_GENERATION}{generation}"
    scan_index(spark, path).write.mode("overwrite").parquet(target)
    pages = known_pages(spark, path)
    if pages is not None:
        pages.withColumn("gone", F.lit(False)).write.parquet(f"{target}/{_PAGES}/at=0")
    files, marker = file_system(spark, f"{root}/{_CURRENT}/{generation}")
    files.mkdirs(marker)
    for name in _names(spark, root):
        old = int(name.removeprefix(_GENERATION)) if name.startswith(_GENERATION) else -1 if name == _CURRENT else 0
        if 0 <= old < generation - 1:
            files.delete(file_system(spark, f"{root}/{name}")[1], True)
    return True


def ensure_index(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The index at ``path``, filled from ``build()`` first if it is empty or missing."""
    create_index(spark, path)
    if scan_index(spark, path, page_numbers=False).isEmpty():
        append_chunks(build(), path, "overwrite")
    return scan_index(spark, path)


def check_unique(df: DataFrame, key: str = "id") -> DataFrame:
    """Values of ``key`` that occur more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def check_dimension(df: DataFrame, dim: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or not ``dim`` wide: key and width (null if missing)."""
    width = F.when(F.col(vector).isNotNull(), F.size(vector))
    return df.select(F.col(key), width.alias("width")).where(width.isNull() | (width != dim))
