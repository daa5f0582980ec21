"""Fixings of the underlying and what notes read from them.

Fixings are packed in blocks of (asset, month): at most 31 days in one array. A note meets the
blocks of the months it observes through an equi-join, so it costs a row per month instead of a
row per day, and a shared asset is a join key that Spark can split, not a group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikebook.functions import exact
from strikebook.operators.asof import asof
from strikebook.operators.calendar import Calendar, roll_following

QUOTES = ["close", "avg", "high", "low"]


def daily_fixings(ticks: DataFrame) -> DataFrame:
    """Close, mean, highest and lowest price per asset and day, combined on the map side."""
    return ticks.groupBy("asset", "fixing_date").agg(
        F.max_by("price", F.struct("ts", "tick_id")).alias("close"),
        F.round(F.avg("price"), 8).cast(exact.PRICE).alias("avg"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
    )


def quoted(row, quote: Column) -> Column:
    """The price of the registered quote type out of a fixing."""
    chosen = F.when(quote == QUOTES[0], row[QUOTES[0]])
    for name in QUOTES[1:]:
        chosen = chosen.when(quote == name, row[name])
    return chosen


def attach_fixings(
    schedule: DataFrame, fixings: DataFrame, date: str, quote: str, calendar: Calendar
) -> DataFrame:
    """The fixing of each scheduled date, rolled to the following business day."""
    rolled = roll_following(schedule, date, calendar, "fixing_date")
    joined = rolled.join(fixings, ["asset", "fixing_date"], "left")
    return joined.withColumn("price", quoted({q: F.col(q) for q in QUOTES}, F.col(quote))).drop(*QUOTES)


def month_blocks(fixings: DataFrame) -> DataFrame:
    day = F.struct("fixing_date", *QUOTES)
    return fixings.groupBy("asset", F.trunc("fixing_date", "month").alias("month")).agg(
        F.array_sort(F.collect_list(day)).alias("days")
    )


def note_blocks(notes: DataFrame, fixings: DataFrame, start: str, end: str, quote: str) -> DataFrame:
    """One row per note and observed month, with the observed (day, price) pairs in date order."""
    months = F.sequence(F.trunc(F.col(start), "month"), F.trunc(F.col(end), "month"), F.expr("interval 1 month"))
    joined = (
        notes.filter(F.col(start) <= F.col(end))
        .withColumn("month", F.explode(months))
        .join(month_blocks(fixings), ["asset", "month"])
    )
    inside = F.filter("days", lambda d: (d["fixing_date"] >= F.col(start)) & (d["fixing_date"] <= F.col(end)))
    pairs = F.transform(
        inside,
        lambda d: F.struct(d["fixing_date"].alias("day"), quoted(d, F.col(quote)).alias("price")),
    )
    return joined.withColumn("observed", pairs).drop("days")


def note_paths(notes: DataFrame, fixings: DataFrame, key: str, start: str, end: str, quote: str) -> DataFrame:
    """The whole observed path of each note as one array, bounded by the days of its window."""
    blocks = note_blocks(notes.select(key, "asset", start, end, quote), fixings, start, end, quote)
    ordered = F.array_sort(F.collect_list(F.struct("month", "observed")))
    path = F.flatten(F.transform(ordered, lambda m: m["observed"]))
    return blocks.groupBy(key).agg(path.alias("path"))


def _mean(prices: Column) -> Column:
    total = F.aggregate(prices, F.lit(0).cast("decimal(28,8)"), lambda a, p: (a + p).cast("decimal(28,8)"))
    return F.round(F.try_divide(total, F.size(prices).cast("decimal(10,0)")), 8).cast(exact.PRICE)


def reduce_path(path: Column, criterion: Column, n: Column, from_end: bool) -> Column:
    """One value out of a path: its edge, the mean of ``n`` edge fixings, or max, mean, min."""
    prices = F.transform(path, lambda d: d["price"])
    size = F.size(prices)
    edge = F.when(F.lit(from_end), F.get(prices, size - 1)).otherwise(F.get(prices, F.lit(0)))
    first = F.when(F.lit(from_end), F.greatest(size - n, F.lit(0)) + 1).otherwise(F.lit(1))
    tail = F.slice(prices, first, F.least(n, size))
    value = (
        F.when(criterion == "single", edge)
        .when(criterion == "mean_n", _mean(tail))
        .when(criterion == "max", F.array_max(prices))
        .when(criterion == "min", F.array_min(prices))
        .when(criterion == "mean", _mean(prices))
    )
    return F.when(size > 0, value)


# Fixed value: a basket starts from this number of points.
BASKET_START = 10_000


def window_value(
    notes: DataFrame, fixings: DataFrame, start: str, end: str, quote: str, criterion: str, n: str, out: str,
    from_end: bool,
) -> DataFrame:
    """Initial (``from_end=False``) or final value of each note over its window.

    Notes with the same asset, window and criterion share one computed value.
    """
    keys = ["asset", start, end, quote, criterion, n]
    requests = notes.select(*keys).distinct().withColumn("_request", F.struct(*keys))
    paths = note_paths(requests, fixings, "_request", start, end, quote)
    request = {k: F.col("_request")[k] for k in keys}
    value = reduce_path(F.col("path"), request[criterion], request[n], from_end)
    answers = paths.select(*[request[k].alias(k) for k in keys], value.alias(out))
    return notes.join(answers, keys, "left")


def note_performance(notes: DataFrame, initial: str = "s0", final: str = "st", out: str = "perf") -> DataFrame:
    """Final over initial value minus one, to 16 decimals."""
    return notes.withColumn(out, (exact.ratio(F.col(final), F.col(initial)) - 1).cast(exact.FACTOR))


def fx_performance(notes: DataFrame, fx: DataFrame, start: str, end: str) -> DataFrame:
    """Quanto notes keep the local performance; composite notes carry the currency as well.

    ``fx`` holds (currency, quoted_on, rate); each side takes the last rate known on its date.
    """
    for date, name in ((start, "fx0"), (end, "fxt")):
        side = fx.select("currency", F.col("quoted_on").alias(date), "rate")
        notes = asof(notes, side, ["currency"], date, "rate", name)
    composite = F.try_divide(
        F.col("st").cast("double") * F.col("fxt").cast("double"),
        F.col("s0").cast("double") * F.col("fx0").cast("double"),
    )
    local = F.try_divide(F.col("st").cast("double"), F.col("s0").cast("double"))
    return notes.withColumn("fx_perf", F.when(F.col("quanto"), local).otherwise(composite) - 1)


def basket_performance(components: DataFrame) -> DataFrame:
    """Weighted sum, worst and best component of each note's basket.

    The weighted sum is this library's reading: percentage weights times component performance.
    """
    weighted = F.col("weight").cast("decimal(18,8)") * F.col("perf").cast("decimal(18,8)")
    return components.groupBy("note_id").agg(
        (F.sum(weighted) / 100).alias("weighted"), F.min("perf").alias("worst"), F.max("perf").alias("best")
    )


def breach(price: Column, level: Column, direction: Column) -> Column:
    """Up barriers are hit when touched; down barriers only when passed."""
    return F.when(direction == "up", price >= level).otherwise(price < level)


def barrier_hit(
    notes: DataFrame, fixings: DataFrame, start: str, end: str, quote: str, observation: str, level: str,
    direction: str,
) -> DataFrame:
    """Whether and when each note's barrier is hit.

    ``american`` looks at every day of the window, ``european`` only at the end date, and
    ``discrete`` at the dates of the note's ``schedule`` array, where there is one.
    """
    blocks = note_blocks(notes, fixings, start, end, quote)
    watched = F.when(F.col(observation) == "american", F.col("observed")).when(
        F.col(observation) == "european", F.filter("observed", lambda d: d["day"] == F.col(end))
    )
    if "schedule" in notes.columns:
        listed = F.filter("observed", lambda d: F.array_contains(F.col("schedule"), d["day"]))
        watched = watched.when(F.col(observation) == "discrete", listed)
    hits = F.filter(watched, lambda d: breach(d["price"], F.col(level), F.col(direction)))
    first = F.array_min(F.transform(hits, lambda d: d["day"]))
    found = blocks.select("note_id", first.alias("_day")).groupBy("note_id").agg(F.min("_day").alias("first_breach"))
    return notes.join(found, "note_id", "left").withColumn("hit", F.col("first_breach").isNotNull())


def schedule_length(start: str, end: str, calendar: Calendar) -> Column:
    """Business days of a window, both ends included: the registered number of daily observations."""
    return F.greatest(calendar.index(F.col(end)) - calendar.index(F.date_sub(F.col(start), 1)), F.lit(0)).cast("long")


def scheduled_blocks(notes: DataFrame, fixings: DataFrame, start: str, end: str, quote: str, calendar: Calendar) -> DataFrame:
    """``note_blocks`` of the business days alone."""
    blocks = note_blocks(notes, fixings, start, end, quote)
    return blocks.withColumn("observed", F.filter("observed", lambda d: calendar.is_open(d["day"])))


def days_in_range(
    notes: DataFrame, fixings: DataFrame, start: str, end: str, quote: str, low: str, high: str, calendar: Calendar
) -> DataFrame:
    """Observations of each note, and how many lie between its two levels, both ends included.

    ``n_all`` is the number of the schedule, so a day without a fixing, missing or to come, raises no coupon; ``n_missing``
    counts these days.
    """
    blocks = scheduled_blocks(notes, fixings, start, end, quote, calendar)
    within = F.filter("observed", lambda d: (d["price"] >= F.col(low)) & (d["price"] <= F.col(high)))
    counts = (
        blocks.select("note_id", F.size(within).alias("_in"), F.size("observed").alias("_found"))
        .groupBy("note_id")
        .agg(F.sum("_in").alias("n_in"), F.sum("_found").alias("_found"))
    )
    zero = F.lit(0).cast("long")
    counted = notes.join(counts, "note_id", "left").withColumns(
        {"n_in": F.coalesce("n_in", zero), "n_all": F.coalesce(schedule_length(start, end, calendar), zero)}
    )
    return counted.withColumn("n_missing", F.col("n_all") - F.coalesce("_found", zero)).drop("_found")
