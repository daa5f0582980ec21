"""The three truth regimes of note rules, as column helpers.

* A bare comparison is null when a side is missing, and a null rule says nothing.
* ``and``/``or``/``not`` are two-valued: a null operand counts as false.
* ``==``, ``!=`` and ``in`` never give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def decided(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def both(*values: Column) -> Column:
    return reduce(lambda a, b: a & b, [decided(v) for v in values])


def either(*values: Column) -> Column:
    return reduce(lambda a, b: a | b, [decided(v) for v in values])


def negated(value: Column) -> Column:
    return ~decided(value)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def member(value: Column, choices: list) -> Column:
    return decided(value.isin(choices))


def smallest(*values: Column) -> Column:
    """Null as soon as any argument is null, unlike ``least``."""
    return F.when(reduce(lambda a, b: a | b, [v.isNull() for v in values]), None).otherwise(F.least(*values))


def largest(*values: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [v.isNull() for v in values]), None).otherwise(F.greatest(*values))


def inside(value: Column, low: Column, high: Column) -> Column:
    """Inclusive; null when either comparison is undecided, even if the other one fails."""
    missing = value.isNull() | low.isNull() | high.isNull()
    return F.when(missing, None).otherwise((value >= low) & (value <= high))
