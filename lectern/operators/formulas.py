"""Computed columns with a status: the calculator, for whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Why a formula has no usable result, and what to look at.
_MISSING = ("no result", "look for missing inputs, divisors of zero and arguments outside a function's domain")
_NOT_A_NUMBER = ("result is not a number", "look for roots and logarithms of negative values")
_INFINITE = ("result is infinite", "use smaller values or exponents")


def formula_columns(df: DataFrame, formulas: dict[str, Column]) -> DataFrame:
    """Add ``name``, ``name_integral``, ``name_status``, ``name_error`` and ``name_hint`` for every formula.

    Formulas are Column expressions; ``lectern.functions`` has those whose usual Spark form
    differs (division, modulo, logarithm, factorial). A result that is null, NaN or infinite
    is an ``error`` and becomes null, with the reason in ``name_error`` and advice in ``name_hint``; both
    are null for a ``success``. ``name_integral`` tells whether the result is a whole number.
    """
    raw, kinds = {n: f"_raw_{n}" for n in formulas}, {n: f"_kind_{n}" for n in formulas}
    computed = df.withColumns({raw[n]: e.cast("double") for n, e in formulas.items()})

    def kind(value: Column) -> Column:
        """0 for a usable result, else the place of the reason."""
        # NaN compares above infinity, so one range test covers both.
        odd = F.when(value.isNull(), 1).when(F.isnan(value), 2).otherwise(3)
        return F.when(F.abs(value) < float("inf"), 0).otherwise(odd)

    computed = computed.withColumns({kinds[n]: kind(F.col(raw[n])) for n in formulas})
    reasons = [(None, None), _MISSING, _NOT_A_NUMBER, _INFINITE]
    errors, hints = (F.array(*[F.lit(r[i]).cast("string") for r in reasons]) for i in (0, 1))
    added = {}
    for name in formulas:
        value, usable = F.col(raw[name]), F.col(kinds[name]) == 0
        added[name] = F.when(usable, value)
        added[f"{name}_integral"] = usable & ((F.abs(value) >= float(2**53)) | (value == F.floor(value)))
        added[f"{name}_status"] = F.when(usable, "success").otherwise("error")
        added[f"{name}_error"] = F.get(errors, F.col(kinds[name]))
        added[f"{name}_hint"] = F.get(hints, F.col(kinds[name]))
    return computed.withColumns(added).drop(*raw.values(), *kinds.values())
