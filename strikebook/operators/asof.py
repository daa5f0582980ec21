"""Last known value at or before a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame, series: DataFrame, by: list[str], on: str, value: str, out: str, strict: bool = False,
    rank: str | None = None,
) -> DataFrame:
    """Attach to each left row the latest ``series`` value at or before its date.

    The search runs over the distinct (by, on) pairs only, so a key holds at most one row per day
    however many left rows share it; the left rows then get their answer by an equi-join.
    ``strict`` looks before the date. ``rank`` names a series column whose greatest known value
    wins (a month that is published late); by default the latest date wins.
    """
    newest = F.col(rank) if rank else F.col(on)
    entry = F.max(F.struct(newest.alias("_rank"), F.col(value).alias("_value"))).alias("_entry")
    known = series.filter(F.col(on).isNotNull()).groupBy(*by, on).agg(entry).withColumn("_asked", F.lit(False))
    asked = (
        left.filter(F.col(on).isNotNull())
        .select(*by, on)
        .distinct()
        .withColumn("_entry", F.lit(None).cast(known.schema["_entry"].dataType))
        .withColumn("_asked", F.lit(True))
    )
    last = -1 if strict else 0
    window = Window.partitionBy(*by).orderBy(F.unix_date(F.col(on).cast("date")))
    answers = (
        known.unionByName(asked)
        .withColumn("_found", F.max("_entry").over(window.rangeBetween(Window.unboundedPreceding, last)))
        .filter("_asked")
        .select(*by, on, F.col("_found._value").alias(out))
    )
    return left.join(answers, [*by, on], "left")
