"""Helpers that several operators share: slices of Arrow batches, stored tables, folds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import file_system, scratch_path

SLICE_BYTES = 2**20

_U = np.uint64


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has at most ``limit`` bytes of text, but one row at least.

    Arrays made per slice then stay small whatever the batch size; a longer text comes alone.
    """
    lengths = batch.column(column).cast(pa.large_binary())
    sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(lengths).to_pylist()])
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if len(sizes) > begin:
        yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, column: int = 0) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [v or b"" for v in batch.column(column).cast(pa.binary()).to_pylist()]


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove what ``stored`` writes inside the block when it ends; nothing lazy may read it afterwards."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            files, place = file_system(spark, path)
            files.delete(place, True)


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back.

    Cuts the lineage in a way that survives a lost executor, and computes ``df`` once. The table stays unless
    a ``scratch_scope`` is open. ``group_bytes`` is for rows of megabytes: groups of rows end once they have as
    many bytes, so that writer and reader hold no more, and the usual look at every 100th row would be too late.
    """
    path = scratch_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    writer = df.write
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", group_bytes)
        for part in ("block", "page"):
            writer = writer.option(f"parquet.{part}.size.row.check.min", 1)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """Rows (``id``, ``text``) in blocks of about ``limit`` bytes, one on the driver at a time; an id is in one block."""
    weight = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0)).alias("n")).first()["n"]
    n = int(weight // limit) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).collect()
        yield [(r["id"], (r["text"] or "").encode()) for r in rows]


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; remainder 2 is held out from learning."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def held_out(key: Column) -> Column:
    return F.coalesce(fold(key) == 2, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a published finalizer with its fixed constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words of one task up to a bound."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 17)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Spans:
    """Hashes of runs of words in O(1) each, from prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 2**64)

    def __init__(self):
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n > len(self.powers):
            m = max(n, 2 * len(self.powers))
            with np.errstate(over="ignore"):
                up, down = np.full(m, self.BASE, np.uint64), np.full(m, self.INVERSE, np.uint64)
                up[0] = down[0] = 1
                self.powers, self.inverses = np.cumprod(up), np.cumprod(down)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Prefix sums, one longer than ``hashes``."""
        n = len(hashes)
        self._reach(n + 1)
        out = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * self.powers[:n], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words ``begin`` to ``end`` (exclusive), equal wherever the words are."""
        with np.errstate(over="ignore"):
            return mixed((sums[end] - sums[begin]) * self.inverses[begin])


# Bits of a filter of keys: 16 MB, whatever the number of keys. A fuller filter lets more keys pass
# that are not in it, which costs rows later on and never loses any.
FILTER_BITS = 27


def _probes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each 64-bit key in the filter."""
    bits = mixed(keys.astype(np.uint64, copy=False))
    low = _U(2**FILTER_BITS - 1)
    return bits & low, (bits >> _U(32)) & low


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bloom filter of a bigint column, put together by an aggregation over its 64-bit words.

    At most 2**21 rows of two longs reach the driver, whatever the number of keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            places = np.unique(np.concatenate(_probes(found)))
            words = (places >> _U(6)).astype(np.int32)
            masks = _U(1) << (places & _U(63))
            firsts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
            masks = np.bitwise_or.reduceat(masks, firsts) if len(firsts) else masks
            yield pa.RecordBatch.from_arrays([pa.array(words[firsts]), pa.array(masks.view(np.int64))], ["word", "mask"])

    parts = keys.select(column).mapInArrow(run, "word int, mask bigint")
    table = parts.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(2 ** (FILTER_BITS - 6), np.uint64)
    words[table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return words


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in the filter."""
    out = np.ones(len(keys), bool)
    for places in _probes(keys):
        out &= ((words[places >> _U(6)] >> (places & _U(63))) & _U(1)).astype(bool)
    return out
