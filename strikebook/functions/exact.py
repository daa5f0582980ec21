"""Exact decimal arithmetic: 16-digit intermediates, money cut to cents.

Amounts stay DECIMAL so that a payoff on a cent boundary is not lost to binary rounding. Prices
are DECIMAL(18,8): their quotient carries 20 decimals, four more than is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(18,8)"
FACTOR = "decimal(28,16)"
MONEY = "decimal(18,2)"


def price(value: Column) -> Column:
    return value.cast(PRICE)


def factor(value: Column) -> Column:
    """Rounded half away from zero to 16 decimals."""
    return F.round(value, 16).cast(FACTOR)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient of two prices to 16 decimals; null on a zero or missing denominator."""
    return factor(F.try_divide(price(numerator), price(denominator)))


def percent(value: Column) -> Column:
    """A percentage as a fraction, exact."""
    return (value.cast("decimal(12,6)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(16,8)")


def times(rate: Column, value: Column) -> Column:
    """A fraction of at most eight decimals times a 16-decimal value, rounded to 16 decimals."""
    return factor(rate.cast("decimal(16,8)") * value.cast("decimal(20,16)"))


def share(part: Column, whole: Column) -> Column:
    """Quotient of two counts to 16 decimals; null when there is nothing to count."""
    # The numerator's scale decides how many decimals the quotient keeps.
    return factor(F.try_divide(part.cast("decimal(26,16)"), whole.cast("decimal(10,0)")))


def level(start: Column, pct: Column) -> Column:
    """A percentage of a starting price, as a price."""
    return (price(start) * pct.cast("decimal(9,4)") * F.lit("0.01").cast("decimal(3,2)")).cast(PRICE)


def at_least(value: Column, pct: Column, start: Column) -> Column:
    """``value >= pct% of start`` without dividing."""
    return price(value) * 100 >= price(start) * pct.cast("decimal(9,4)")


def money(nominal: Column, multiple: Column) -> Column:
    """``nominal * multiple`` cut (not rounded) to cents."""
    cents = (nominal.cast(MONEY) * 100).cast("decimal(16,0)") * multiple.cast("decimal(20,16)")
    whole = F.when(cents < 0, F.ceil(cents)).otherwise(F.floor(cents)).cast("decimal(16,0)")
    return (whole * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)
