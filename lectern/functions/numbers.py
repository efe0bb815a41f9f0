"""Arithmetic with the semantics the formula, conversion and search operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_score(value: Column, digits: int = 4) -> Column:
    """Round half up on the binary value.

    ``F.round`` goes through a decimal and differs between engines on values that sit at a
    half; the floor form is plain double arithmetic and therefore the same everywhere. The
    division goes by ``try_divide`` because ANSI division would add a zero check per row.
    """
    scale = float(10**digits)
    rounded = F.try_divide(F.floor(value * scale + 0.5).cast("double"), F.lit(scale))
    # From 2**53 on doubles have no such places, and a floor would not fit a long.
    return F.when(F.abs(value * scale) < float(2**53), rounded).otherwise(value.cast("double"))


def divide(left: Column, right: Column) -> Column:
    """Quotient, null where the divisor is zero."""
    return F.try_divide(left, right)


def modulo(left: Column, right: Column) -> Column:
    """Remainder with the sign of the divisor, null where the divisor is zero."""
    left, right = left.cast("double"), right.cast("double")
    rest = F.when(right != 0, left % F.when(right != 0, right).otherwise(1.0))
    return F.when((rest != 0) & ((rest < 0) != (right < 0)), rest + right).otherwise(rest)


def logarithm(value: Column, base: Column | float | None = None) -> Column:
    """Logarithm of ``value``: natural, or to ``base``. The value comes first."""
    if base is None:
        return F.ln(value)
    base = base if isinstance(base, Column) else F.lit(float(base))
    return F.try_divide(F.ln(value), F.ln(base))


def factorial(value: Column) -> Column:
    """Factorial of a whole number from 0 to 170, the last that a double holds, otherwise null."""
    known = F.lit(np.array([float(math.factorial(n)) for n in range(171)]))  # one literal
    inside = value.between(0, 170)
    place = F.when(inside, value.cast("double").cast("int"))
    return F.when(inside & (place == value.cast("double")), F.get(known, place))
