"""Accrual factors of the fixed-income leg."""

from __future__ import annotations

import bisect
import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikebook.operators.asof import asof
from strikebook.operators.calendar import Calendar, business_days_between

# Decimals of the daily rate, the accumulated factor and the spread factor.
DAILY_DECIMALS = 8
DI_DECIMALS = 8
SPREAD_DECIMALS = 9


def _rounded(value: Column, decimals: int) -> Column:
    return F.round(value.cast("decimal(38,18)"), decimals).cast(f"decimal(18,{decimals})")


def daily_rate(annual: Column) -> Column:
    """Daily rate of an annual percentage on the 252-day basis."""
    return F.pow(annual.cast("double") / 100 + 1, F.lit(1 / 252)) - 1


def _with_ranks(notes: DataFrame, days: list[dt.date], start: str, end: str) -> DataFrame:
    """``_from`` and ``_to``: rated days before each date. Dates before the first and after the last rated day are clamped."""
    spark = notes.sparkSession
    first, last = days[0], days[-1] + dt.timedelta(days=1)
    dates = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    ranks = spark.createDataFrame([(d, bisect.bisect_left(days, d)) for d in dates], "_day date, _rank int")
    for column, out in ((start, "_from"), (end, "_to")):
        clamped = F.least(F.greatest(F.col(column), F.lit(first)), F.lit(last))
        side = ranks.select(F.col("_day").alias(f"_{column}"), F.col("_rank").alias(out))
        notes = notes.withColumn(f"_{column}", F.when(F.col(column).isNotNull(), clamped)).join(F.broadcast(side), f"_{column}", "left").drop(f"_{column}")
    return notes


def _literal(values: list, kind: str) -> Column:
    """A list of numbers as one folded array."""
    return F.split(F.lit(";".join(map(str, values))), ";").cast(f"array<{kind}>")


def di_factor(
    notes: DataFrame, rates: DataFrame, start: str, end: str, pct: str, out: str, rounding: str = "none"
) -> DataFrame:
    """Accumulated DI factor at a percentage over the rated days from ``start`` to before ``end``.

    The rated days, at most one a day, come to the driver and into the plan. ``rounding='none'`` multiplies freely:
    running sums of logarithms per distinct percentage and rated day, of which each note takes two. ``'handbook'``
    rounds the daily rate and, in date order, every accumulated step to 8 decimals: one pass over the days for all
    windows of a start and percentage. Without both dates, or a rated day between them, the factor is one.
    """
    if rounding not in ("none", "handbook"):
        raise ValueError(f"unknown rounding {rounding!r}")
    exact = rounding == "handbook"
    one = F.lit(1).cast("decimal(18,8)") if exact else F.lit(1.0)
    tdi = daily_rate(F.col("rate"))
    rated = rates.where("rate is not null").select("rate_date", _rounded(tdi, DAILY_DECIMALS) if exact else tdi).orderBy("rate_date").collect()
    if not rated:
        return notes.withColumn(out, one)
    ranked = _with_ranks(notes, [r[0] for r in rated], start, end)
    if not exact:
        step = F.log1p(F.col("_tdi") * F.col(pct).cast("double") / 100)
        up_to = Window.partitionBy(pct).orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        each = ranked.select(pct).distinct().select(pct, F.posexplode(_literal([r[1] for r in rated], "double")).alias("_rank", "_tdi"))
        sums = each.select(pct, (F.col("_rank") + 1).alias("_rank"), F.sum(step).over(up_to).alias("_s"))
        for rank, name in (("_from", "_s0"), ("_to", "_s1")):
            side = sums.select(pct, F.col("_rank").alias(rank), F.col("_s").alias(name))
            ranked = ranked.join(side, [pct, rank], "left")
        grown = F.exp(F.coalesce("_s1", F.lit(0.0)) - F.coalesce("_s0", F.lit(0.0)))
        value = F.when((F.col("_from") < F.col("_to")) & F.col(pct).isNotNull(), grown).otherwise(one)
        return ranked.withColumn(out, value).drop("_from", "_to", "_s0", "_s1")
    wanted = ranked.where("_from < _to").groupBy("_from", pct).agg(F.sort_array(F.collect_set("_to")).alias("_ends"))
    days = _literal([r[1] for r in rated], f"decimal(18,{DAILY_DECIMALS})")
    own = F.slice(days, F.col("_from") + 1, F.element_at("_ends", -1) - F.col("_from"))
    share = F.col(pct).cast("decimal(9,4)")
    begin = F.struct(one.alias("f"), F.col("_from").alias("at"), F.array().cast("array<decimal(18,8)>").alias("found"))

    def grow(state: Column, rate: Column) -> Column:
        f = F.round(state["f"] * (1 + rate * share / 100).cast("decimal(20,14)"), DI_DECIMALS).cast("decimal(18,8)")
        at = state["at"] + 1
        found = F.when(F.array_contains("_ends", at), F.concat(state["found"], F.array(f))).otherwise(state["found"])
        return F.struct(f.alias("f"), at.alias("at"), found.alias("found"))

    found = wanted.select("_from", pct, F.explode(F.arrays_zip(F.col("_ends").alias("e"), F.aggregate(own, begin, grow)["found"].alias("f"))).alias("_x"))
    factors = found.select("_from", pct, F.col("_x")["e"].alias("_to"), F.col("_x")["f"].alias("_f"))
    return ranked.join(factors, ["_from", pct, "_to"], "left").withColumn(out, F.coalesce("_f", one)).drop("_from", "_to", "_f")


def pre_factor(rate_pct: Column, business_days: Column) -> Column:
    """Compounding of an annual percentage over business days on the 252-day basis."""
    return F.pow(1 + rate_pct.cast("double") / 100, business_days / F.lit(252.0))


def ipca_factor(notes: DataFrame, index: DataFrame, start: str, end: str, pct: str, out: str) -> DataFrame:
    """Inflation factor on index numbers known the day before each date.

    ``index`` holds (month, ni, published_on). The number used is that of the latest month already
    published, so an unpublished month falls back to the one before it.
    """
    series = index.withColumn("_all", F.lit(1))
    for date, name in ((start, "_ni0"), (end, "_nin")):
        side = series.select("_all", F.col("published_on").alias(date), "month", "ni")
        notes = asof(notes.withColumn("_all", F.lit(1)), side, ["_all"], date, "ni", name, strict=True, rank="month")
    growth = F.try_divide(F.col("_nin").cast("double"), F.col("_ni0").cast("double")) - 1
    factor = 1 + growth * F.col(pct).cast("double") / 100
    return notes.withColumn(out, factor).drop("_all", "_ni0", "_nin")


def spread_factor(
    notes: DataFrame, rate: str, basis: str, start: str, end: str, calendar: Calendar, out: str
) -> DataFrame:
    """Spread on the registered day-count basis, rounded to 9 decimals."""
    counted = business_days_between(notes, start, end, calendar, "_du")
    i = F.col(rate).cast("double") / 100
    calendar_days = F.datediff(end, start)
    value = (
        F.when(F.col(basis) == "252 exp", F.pow(1 + i, F.col("_du") / 252.0))
        .when(F.col(basis) == "360 exp", F.pow(1 + i, calendar_days / 360.0))
        .when(F.col(basis) == "360 lin", 1 + i * calendar_days / 360.0)
    )
    return counted.withColumn(out, _rounded(value, SPREAD_DECIMALS)).drop("_du")


def interest_factor(di: Column, spread: Column) -> Column:
    """DI factor times spread factor, rounded to 9 decimals."""
    return _rounded(di.cast("decimal(18,8)") * spread.cast("decimal(18,9)"), SPREAD_DECIMALS)


def issue_budget(notes: DataFrame, rate: str, days: str, margin: str, option_price: str) -> DataFrame:
    """Value of the zero-coupon leg, what is left for options, and the participation it buys."""
    zero = 1 / pre_factor(F.col(rate), F.col(days))
    budget = 1 - zero
    bought = F.try_divide(budget - F.col(margin).cast("double"), F.col(option_price).cast("double"))
    return notes.withColumns({"zero_coupon": zero, "budget": budget, "participation": bought})
