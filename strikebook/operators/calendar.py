"""Business-day calendars over any date, as expressions.

Weekdays up to a date are counted in closed form. A calendar lists its holidays per year, so the number of
holidays up to a date is what came before the year plus a rank among the dozen of the year itself. Counting,
rolling and offsetting need no list of days, no join and no bound on dates; a year without listed holidays has weekdays only.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BRAZIL = "BRASIL"

# Month and day of the national holidays that do not move, and the first year of those that are new.
FIXED_HOLIDAYS = [(1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (11, 20), (12, 25)]
HOLIDAY_SINCE = {(11, 20): 2024}
# Days from Easter Sunday to Carnival Monday and Tuesday, Good Friday, Corpus Christi.
EASTER_OFFSETS = [-48, -47, -2, 60]


#: A Monday, from which days are counted.
MONDAY = "0001-01-01"
#: No day of a year has this number.
NO_DAY = 400


def _table(values: list[int]) -> Column:
    """A list of numbers as one folded array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _weekdays(days: Column) -> Column:
    """Weekdays among the first days that are counted from a Monday."""
    rest = F.pmod(days, F.lit(7))
    return ((days - rest) / 7 * 5 + F.least(rest, F.lit(5))).cast("int")


@dataclass(frozen=True)
class Calendar:
    """Weekdays without the listed holidays; those on weekends change nothing."""

    holidays: tuple[dt.date, ...]

    def _years(self) -> tuple[int, list[list[int]]]:
        """The first year, and per year the day numbers of its holidays on weekdays."""
        days = sorted({d for d in self.holidays if d.weekday() < 5})
        first = days[0].year if days else 1
        years: list[list[int]] = [[] for _ in range((days[-1].year if days else 1) - first + 1)]
        for d in days:
            years[d.year - first].append(d.timetuple().tm_yday)
        return first, years

    def longest_pause(self) -> int:
        """Most days in a row that are closed."""
        listed = set(self.holidays)
        longest = 2
        for d in listed:
            before, after = d, d
            while before.weekday() > 4 or before in listed:
                before -= dt.timedelta(days=1)
            while after.weekday() > 4 or after in listed:
                after += dt.timedelta(days=1)
            longest = max(longest, (after - before).days - 1)
        return longest

    def _rank(self, date: Column) -> Column:
        """Holidays on weekdays up to and including the date."""
        first, years = self._years()
        before, total = [], 0
        for days in years:
            before.append(total)
            total += len(days)
        at, day = F.year(date) - first, F.dayofyear(date)
        inside = F.get(_table(before), at)
        for k in range(max(map(len, years))):
            numbers = _table([days[k] if k < len(days) else NO_DAY for days in years])
            inside = inside + (F.get(numbers, at) <= day).cast("int")
        return F.when(at < 0, 0).when(at >= len(years), total).otherwise(inside)

    def index(self, date: Column) -> Column:
        """Business days from the year 1 up to and including the date."""
        return _weekdays(F.datediff(date, F.lit(MONDAY).cast("date")) + 1) - self._rank(date)

    def is_open(self, date: Column) -> Column:
        first, years = self._years()
        listed = F.split(F.lit(";".join(" " + " ".join(map(str, days)) + " " for days in years)), ";")
        own = F.coalesce(F.get(listed, F.year(date) - first), F.lit(""))
        closed = F.contains(own, F.concat(F.lit(" "), F.dayofyear(date).cast("string"), F.lit(" ")))
        return (F.weekday(date) < 5) & ~closed

    def next_open(self, date: Column) -> Column:
        """The date itself or the following business day."""
        days = [F.date_add(date, i) for i in range(self.longest_pause() + 1)]
        return F.coalesce(*[F.when(self.is_open(d), d) for d in days])


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday."""
    golden, century, rest = year % 19, year // 100, year % 100
    moon = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * (rest // 4) - moon - rest % 4) % 7
    late = (golden + 11 * moon + 22 * weekday) // 451
    month, day = divmod(moon + weekday - 7 * late + 114, 31)
    return dt.date(year, month, day + 1)


def national_days(first_year: int, last_year: int) -> list[dt.date]:
    """Fixed and Easter-bound national holidays; about thirteen per year."""
    days = []
    for year in range(first_year, last_year + 1):
        days += [dt.date(year, m, d) for m, d in FIXED_HOLIDAYS if year >= HOLIDAY_SINCE.get((m, d), year)]
        days += [easter(year) + dt.timedelta(days=n) for n in EASTER_OFFSETS]
    return sorted(days)


def national_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    rows = ", ".join(f"('{BRAZIL}', DATE '{d}')" for d in national_days(first_year, last_year))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS h(calendar_code, holiday_date)")


def national_calendar(first_year: int, last_year: int) -> Calendar:
    return Calendar(tuple(national_days(first_year, last_year)))


def build_calendar(holidays: DataFrame, span: DataFrame) -> DataFrame:
    """One row per calendar and day of ``span`` (columns calendar_code, lo, hi): the calendar as a table.

    ``bd_index`` counts business days up to and including the day; ``next_bd`` is the day itself
    or the following business day. The windows are bounded by the days of the span.
    """
    days = span.select("calendar_code", F.explode(F.sequence("lo", "hi")).alias("day"))
    off = holidays.select("calendar_code", F.col("holiday_date").alias("day"), F.lit(True).alias("_off")).distinct()
    open_day = (F.weekday("day") < 5) & F.col("_off").isNull()
    by_day = Window.partitionBy("calendar_code").orderBy("day")
    ahead = by_day.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        days.join(off, ["calendar_code", "day"], "left")
        .withColumn("is_business_day", open_day)
        .drop("_off")
        .withColumn("bd_index", F.sum(F.col("is_business_day").cast("int")).over(by_day))
        .withColumn("next_bd", F.min(F.when(F.col("is_business_day"), F.col("day"))).over(ahead))
    )


def business_day_index(df: DataFrame, column: str, calendar: Calendar, since: dt.date, out: str) -> DataFrame:
    """Business days from ``since`` up to and including the date."""
    return df.withColumn(out, (calendar.index(F.col(column)) - calendar.index(F.lit(since - dt.timedelta(days=1)))).cast("long"))


def is_business_day(df: DataFrame, column: str, calendar: Calendar, out: str) -> DataFrame:
    """Flag; null where the date is missing."""
    return df.withColumn(out, calendar.is_open(F.col(column)))


def business_days_between(df: DataFrame, start: str, end: str, calendar: Calendar, out: str) -> DataFrame:
    """Business days after ``start`` up to ``end``; negative when reversed, zero when equal."""
    return df.withColumn(out, (calendar.index(F.col(end)) - calendar.index(F.col(start))).cast("long"))


def roll_following(df: DataFrame, column: str, calendar: Calendar, out: str) -> DataFrame:
    return df.withColumn(out, calendar.next_open(F.col(column)))


def expand_schedule(df: DataFrame, start: str, end: str, calendar: Calendar, out: str) -> DataFrame:
    """One row per business day of each window."""
    window = F.when(F.col(start) <= F.col(end), F.sequence(start, end))
    return df.withColumn(out, F.explode(window)).where(calendar.is_open(F.col(out)))


def fixing_window(df: DataFrame, maturity: str, n: str, lag: str, calendar: Calendar, out: str) -> DataFrame:
    """The ``n`` business days that end ``lag`` business days before maturity, one row each; null without a maturity.

    Between two open days at most the longest pause is closed, which bounds how far back the days lie.
    """
    pause = calendar.longest_pause()
    reach = (F.col(lag) + F.col(n)) * (pause + 1) + pause
    days = F.sequence(F.col(maturity), F.date_sub(F.col(maturity), reach.cast("int")), F.expr("interval -1 day"))
    found = F.slice(F.filter(days, calendar.is_open), F.col(lag) + 1, F.col(n))
    return df.withColumn(out, F.explode(F.coalesce(F.reverse(found), F.array_repeat(F.lit(None).cast("date"), F.col(n)))))


def calendar_gap_audit(df: DataFrame, column: str, holidays: DataFrame) -> DataFrame:
    """Years that are asked for but hold no holiday, with how often each is asked for."""
    asked = df.groupBy(F.year(column).alias("year")).agg(F.count(column).alias("n_dates"))
    loaded = holidays.select(F.year("holiday_date").alias("year")).distinct()
    return asked.filter(F.col("year").isNotNull()).join(loaded, "year", "left_anti")
