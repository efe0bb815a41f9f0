"""Pages: one row per page of a book, numbered from 1 in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import source_name
from lectern.operators.numbering import number_rows


def read_pages(
    df: DataFrame,
    book: str = "source",
    order: str | list[str] = "position",
    text: str = "content",
    with_key: bool = False,
) -> DataFrame:
    """``(source, page_num, content)`` with ``page_num`` counted from 1 along ``order``.

    ``order`` must be unique within a book. ``with_key`` adds ``page_key``, the order key as text: what a page
    keeps when others are put before it, and what an index knows it by.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = [f"_order{i}" for i in range(len(order))]
    narrow = df.select(
        F.col(book).alias("source"),
        F.col(text).alias("content"),
        *[F.col(column).alias(key) for column, key in zip(order, keys)],
    )
    numbered = number_rows(narrow, "source", keys, "page_num")
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]).alias("page_key")
    return numbered.select("source", *([key] if with_key else []), F.col("page_num").cast("int").alias("page_num"), "content")


def numbered_pages(df: DataFrame, book: str, page: str, text: str, key: str | None = None) -> DataFrame:
    """The same table where the data already carries page numbers: a projection, no shuffle.

    ``key`` names the column that becomes ``page_key``.
    """
    return df.select(
        F.col(book).alias("source"),
        *([] if key is None else [F.col(key).cast("string").alias("page_key")]),
        F.col(page).cast("int").alias("page_num"),
        F.col(text).alias("content"),
    )


def read_text_books(spark: SparkSession, path: str, page_separator: str = "\f") -> DataFrame:
    """Pages of plain-text files, one book per file, pages parted by ``page_separator``.

    The file name without its folder is the source; positions in the file are the page
    numbers, so nothing is shuffled.
    """
    books = spark.read.text(path, wholetext=True).select(
        source_name(F.col("_metadata.file_path")).alias("source"), "value"
    )
    separator = "".join("\\x{%x}" % ord(c) for c in page_separator)
    return books.select("source", F.posexplode(F.split("value", separator)).alias("at", "content")).select(
        "source", (F.col("at") + 1).cast("int").alias("page_num"), "content"
    )
