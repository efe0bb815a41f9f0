"""Column functions: nothing here reads data or starts a job."""

from lectern.functions.numbers import divide, factorial, logarithm, modulo, round_score
from lectern.functions.text import WHITESPACE, contains_word, preview, source_name, strip
from lectern.functions.vectors import cosine, dot, norm

__all__ = [
    "WHITESPACE",
    "contains_word",
    "cosine",
    "divide",
    "dot",
    "factorial",
    "logarithm",
    "modulo",
    "norm",
    "preview",
    "round_score",
    "source_name",
    "strip",
]
