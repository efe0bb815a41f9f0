"""Text helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points counted as white space when a chunk is trimmed.
_SPACES = [
    *range(0x0009, 0x000E),
    *range(0x001C, 0x0021),
    0x0085,
    0x00A0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
]
WHITESPACE = "".join(map(chr, _SPACES))


def strip(text: Column) -> Column:
    """Drop white space of any kind (not only U+0020) from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def source_name(path: Column) -> Column:
    """Last segment of a path or address, taken as it stands."""
    return F.substring_index(path, "/", -1)


def preview(text: Column, width: int = 200) -> Column:
    """The first ``width`` characters."""
    return F.substring(text, 1, width)


def contains_word(text: Column, key: str) -> Column:
    """``key`` occurs in ``text`` with no letter or digit directly on either side."""
    quoted = "".join(c if c.isalnum() else "\\x{%x}" % ord(c) for c in key)
    return text.rlike(r"(?<![\p{L}\p{N}])" + quoted + r"(?![\p{L}\p{N}])")
