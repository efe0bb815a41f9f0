"""Which keys of a table occur as substrings of a text.

A short key table becomes one expression per key inside the scan stage. A longer one meets the texts
through anchors: every key is filed under a piece of at most six characters of its own, the one that
the fewest texts contain. The scan tests the piece at every place of a text against a filter of all anchors
and hands on only places that pass, a handful per text; those are joined with the keys of their anchor,
and the text around the place is compared with the whole key. No pair is lost, because a text that contains
a key contains its anchor at the right place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import contains_word
from lectern.operators.filters import KeyFilter, key_filter
from lectern.operators.sizing import weigh
from lectern.session import stored_table

# Key tables up to this many rows are turned into expressions.
INLINE_KEYS = 64
# Key tables up to this many rows, and this many bytes, are sent to every task.
BROADCAST_KEYS = 200_000
_BROADCAST_BYTES = 16 * 2**20
_ANCHOR = 6
# Bits of the filter for each anchor: it is asked at every place of every text, and each place that passes takes its
# surroundings along.
_FILTER_BITS = 4096
# How often anchors occur is measured on one of so many texts.
_MEASURED = 16
# Places of one anchor that go to one task, where keys are too many to be sent.
_PLACES_PER_TASK = 200_000
# Characters of a batch that are hashed at a time.
_STRETCH = 1 << 20

_PLACES = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("h", T.LongType())]))


def occurs(text: Column, key: str, word: bool) -> Column:
    """``key`` is part of ``text`` (of any word, or as words of its own)."""
    return contains_word(text, key) if word else F.contains(text, F.lit(key))


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` characters from each place on."""
    n = max(0, len(codes) - width + 1)
    h = np.full(n, width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = (h ^ codes[j : n + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _lists(rows: np.ndarray, at: np.ndarray, h: np.ndarray, n: int) -> pa.Array:
    """One list of places for each of ``n`` texts."""
    order = np.argsort(rows, kind="stable")
    offsets = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
    places = pa.StructArray.from_arrays([pa.array(at[order].astype(np.int32)), pa.array(h[order].view(np.int64))], ["at", "h"])
    return pa.ListArray.from_arrays(pa.array(offsets), places)


def _places(wanted: Callable[[], KeyFilter], widths: list[int]):
    """Places of each text at which a piece of one of the ``widths`` passes the filter."""

    def found(texts: pa.Array) -> pa.Array:
        held, words = wanted(), texts.to_pylist()
        codes = np.frombuffer("".join(w or "" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(w or "") for w in words])
        rows, ats, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for width in widths:
            if not width:  # the empty key stands at the start of every text
                here = np.array([i for i, w in enumerate(words) if w is not None], np.int64)
                rows.append(here)
                ats.append(np.zeros(len(here), np.int64))
                hashes.append(np.repeat(_hashes(codes[:0], 0)[:1], len(here)))
                continue
            for begin in range(0, len(codes), _STRETCH):
                h = _hashes(codes[begin : begin + _STRETCH + width - 1], width)
                passed = np.flatnonzero(held.passes(h))
                at = passed + begin
                row = np.searchsorted(ends, at, "right")
                whole = at + width <= ends[row]
                rows.append(row[whole])
                ats.append((at - np.r_[0, ends][row])[whole])
                hashes.append(h[passed][whole])
        return _lists(np.concatenate(rows), np.concatenate(ats), np.concatenate(hashes), len(words))

    return found


def _pieces(keys: pa.Array) -> pa.Array:
    """All pieces of each key that could be its anchor, with their places in it."""
    rows, ats, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    words = keys.to_pylist()
    for i, word in enumerate(words):
        if word is not None:
            codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
            h = _hashes(codes, min(len(codes), _ANCHOR))
            rows.append(np.full(len(h), i))
            ats.append(np.arange(len(h)))
            hashes.append(h)
    return _lists(np.concatenate(rows), np.concatenate(ats), np.concatenate(hashes), len(words))


def _with_places(texts: DataFrame, anchors: DataFrame, count: int, widths: list[int]) -> DataFrame:
    """``texts`` with ``_at`` (from 0) and ``_h`` of every place whose piece may be one of ``anchors`` (h)."""
    shared = texts.sparkSession.sparkContext.broadcast(key_filter(anchors, "h", count, _FILTER_BITS))
    # Not deterministic for the optimizer, which would otherwise run it twice for the explode.
    udf = F.arrow_udf(_places(lambda: shared.value, widths), _PLACES).asNondeterministic()
    found = texts.select("text_id", "text", F.explode(udf(F.col("text"))).alias("_place"))
    return found.select("text_id", "text", F.col("_place.at").alias("_at"), F.col("_place.h").alias("_h"))


def _filed(texts: DataFrame, keys: DataFrame, widths: list[int], many: int) -> tuple[DataFrame, DataFrame]:
    """Each key with its anchor (``key, h, off``), the one that is rarest among the texts, and how often
    pieces of keys occur in the texts (``h, n``, about)."""
    pieces = F.explode(F.arrow_udf(_pieces, _PLACES).asNondeterministic()(F.col("key"))).alias("p")
    pieces = keys.where("key IS NOT NULL").select("key").distinct().select("key", pieces)
    pieces = stored_table(pieces.select("key", F.col("p.h").alias("h"), F.col("p.at").alias("off")), "pieces")
    some = texts.where(F.pmod(F.xxhash64("text_id"), F.lit(_MEASURED)) == 0)
    counted = _with_places(some, pieces, many, widths).groupBy(F.col("_h").alias("h")).agg((F.count(F.lit(1)) * _MEASURED).alias("n"))
    counted = stored_table(counted, "counted")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("best")
    filed = pieces.join(counted, "h", "left").groupBy("key").agg(rarest).select("key", "best.h", "best.off")
    return stored_table(filed, "filed"), counted


def occurrences(texts: DataFrame, keys: DataFrame, word: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``text_id`` and the columns of ``keys``, for every place at which a key occurs in a text.

    Nothing of the texts is shuffled if the keys, counted and weighed, can be sent to the tasks. Otherwise
    places travel with as much text around them as the longest key has, and an anchor that very many texts
    contain is spread over tasks by how often it was met.
    """
    width = F.least(F.length("key"), F.lit(_ANCHOR))
    longest = F.coalesce(F.max(F.length("key")), F.lit(0)).alias("longest")
    size = keys.agg(*weigh(keys), F.array_sort(F.collect_set(width)).alias("widths"), longest).first()
    widths = size["widths"]
    filed, counted = _filed(texts, keys, widths, size["n_rows"] * max(1, size["longest"] - _ANCHOR + 1))
    found = _with_places(texts, filed, size["n_rows"], widths)
    told = keys.join(filed, "key")
    # The character before the place of the key, the key, and the one behind it.
    around = {"begin": F.col("_at") - F.col("off"), "text": F.col("text"), "length": F.length("key")}
    if size["n_rows"] <= broadcast_keys and size["n_bytes"] <= _BROADCAST_BYTES:
        met = found.join(F.broadcast(told), F.col("_h") == F.col("h"))
    else:
        hot = counted.select(F.col("h").alias("_hot"), F.ceil(F.col("n") / _PLACES_PER_TASK).cast("int").alias("_salts")).where("_salts > 1")
        spread = told.join(hot, F.col("h") == F.col("_hot"), "left")
        last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
        spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot", "_salts")
        reach = size["longest"] + 1
        first = F.greatest(F.col("_at") - reach, F.lit(0))
        cut = found.select("text_id", "_h", F.substring("text", first + 1, F.lit(2 * reach + _ANCHOR)).alias("text"), (F.col("_at") - first).alias("_at"))
        cut = cut.join(hot, F.col("_h") == F.col("_hot"), "left")
        salt = F.pmod(F.xxhash64("text_id", "text"), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
        cut = cut.withColumn("_own", salt).drop("_hot", "_salts")
        met = cut.join(spread, (F.col("_h") == F.col("h")) & (F.col("_own") == F.col("_salt")))
    begin, text, length = around.values()
    hit = (begin >= 0) & (F.substring(text, begin + 1, length) == F.col("key"))
    if word:
        beside = F.concat(F.when(begin > 0, F.substring(text, begin, F.lit(1))).otherwise(""), F.substring(text, begin + length + 1, F.lit(1)))
        hit &= ~F.rlike(beside, F.lit(r"[\p{L}\p{N}]"))
    return met.where(hit).select("text_id", *keys.columns)


def key_hits(texts: DataFrame, keys: DataFrame, word: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``texts(text_id, text)`` joined with the ``keys(key, …)`` that occur in each text.

    ``text_id`` must be unique and the rows of ``keys`` distinct. Gives ``text_id`` and the
    columns of ``keys``, once for each text and row of ``keys``.
    """
    return occurrences(texts, keys, word, broadcast_keys).distinct()
