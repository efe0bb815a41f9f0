"""Bloom filters of keys: which rows of a large table may carry a key, tested where the table is read."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits for each key, and for the whole filter: 16 MB, enough for 13 million keys. More keys let more rows
# pass that have none of them; rows that have one always pass.
BITS_PER_KEY = 10
MOST_BITS = 27


class KeyFilter(NamedTuple):
    """A filter as tasks hold it: 64-bit words, and the number of its bits as a power of two."""

    words: np.ndarray
    bits: int

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """Which 64-bit hashes may be in the filter."""
        low, high = np.uint64(2**self.bits - 1), np.uint64(32)
        out = np.ones(len(hashes), bool)
        for places in (hashes & low, (hashes >> high) & low):
            out &= (self.words[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def key_filter(hashes: DataFrame, column: str, count: int, bits_per_key: int = BITS_PER_KEY) -> KeyFilter:
    """A filter of the bigint ``column``, well mixed hashes of about ``count`` keys.

    Of other hashes about the square of 2 / ``bits_per_key`` pass, as long as there are so many bits. Put together by an aggregation; only its words, at most 2**21, reach the driver.
    """
    bits = min(MOST_BITS, max(10, math.ceil(math.log2(bits_per_key * max(1, count)))))
    low, h = F.lit(2**bits - 1), F.col(column)
    probes = F.array(h.bitwiseAND(low), F.shiftrightunsigned(h, 32).bitwiseAND(low))
    places = hashes.where(h.isNotNull()).select(F.explode(probes).alias("p"))
    parts = places.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("mask"))
    table = parts.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(2 ** (bits - 6), np.uint64)
    words[table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return KeyFilter(words, bits)


def may_be_in(keys: DataFrame, key: str, count: int, bits_per_key: int = BITS_PER_KEY) -> Callable[[Column], Column]:
    """A test of a column against the ``key`` column of ``keys``, which has about ``count`` rows.

    The test reads nothing but the column's hash and needs no shuffle.
    """
    held = keys.sparkSession.sparkContext.broadcast(key_filter(keys.select(F.xxhash64(key).alias("h")), "h", count, bits_per_key))

    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(held.value.passes(hashes.to_numpy(zero_copy_only=False).view(np.uint64)))

    udf = F.arrow_udf(test, T.BooleanType())
    return lambda column: udf(F.xxhash64(column))
