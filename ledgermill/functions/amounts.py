"""Amounts of money as exact decimals, and their sums.

An amount has up to 26 digits before the point and 12 after it. What does not
fit is not rounded: it reads as NULL and :func:`is_unreadable` says so, so that
a total can report that something is missing in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

PLACES = 12
MONEY = f"decimal(38,{PLACES})"
#: Totals have one digit less before the point, so that two of them can be subtracted.
TOTAL = f"decimal(37,{PLACES})"
#: Spark's sum adds ten digits to its input; up to here they fit.
PLAIN_DIGITS = 28

_NUMBER = r"^\s*[-+]?[0-9]+(?:\.[0-9]+)?\s*$"
_FITS = rf"^\s*[-+]?0*[0-9]{{0,26}}(?:\.[0-9]{{0,{PLACES}}}0*)?\s*$"


def money(c: Column) -> Column:
    """The exact amount of a text or number, else NULL."""
    return let(c.cast("string"), lambda t: F.when(t.rlike(_FITS) | ~t.rlike(_NUMBER), t.try_cast(MONEY)))


def is_unreadable(c: Column) -> Column:
    """Whether a text is a plain number with more digits than an amount has."""
    return let(c.cast("string"), lambda t: F.coalesce(t.rlike(_NUMBER) & ~t.rlike(_FITS), F.lit(False)))


def exact_sum(rows: DataFrame, name: str, when: Column | None = None) -> Column:
    """Sum of an amount column over (matching) rows, 0 where all are null.

    Narrow decimals are summed as they are. Wide ones would overflow, so two
    limbs are summed: what is before the point and what is after it. A total
    that does not fit is NULL; :func:`sum_overflows` tells so.
    """
    value, narrow = _amount(rows, name, when)
    if narrow:
        return F.coalesce(F.sum(value), F.lit(0)).try_cast(TOTAL)
    high = F.try_sum(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)))
    low = F.try_sum(value % F.lit(1).cast("decimal(1,0)"))  # has the sign of the amount
    carry = F.when(low < 0, F.ceil(low)).otherwise(F.floor(low))
    whole = (high.cast("decimal(37,0)") + carry.cast("decimal(14,0)")).try_cast("decimal(24,0)")
    rest = (low - carry).cast(f"decimal(13,{PLACES})")
    return F.when(F.count(value) == 0, F.lit(0).cast(TOTAL)).otherwise((whole + rest).cast(TOTAL))


def sum_overflows(rows: DataFrame, name: str, when: Column | None = None) -> Column:
    """Whether the sum has more digits than a total."""
    return exact_sum(rows, name, when).isNull()


def subtract(a: Column, b: Column) -> Column:
    """Difference of two totals; NULL where it does not fit."""
    return (a.cast(TOTAL) - b.cast(TOTAL)).try_cast(TOTAL)


def _amount(rows: DataFrame, name: str, when: Column | None) -> tuple[Column, bool]:
    kind = rows.schema[name].dataType
    exact = isinstance(kind, T.DecimalType) and kind.scale <= PLACES
    value = F.col(name) if exact else money(F.col(name))
    narrow = exact and kind.precision <= PLAIN_DIGITS
    return (value if when is None else F.when(when, value)), narrow
