"""Keep-one aggregations that combine on the map side, so a hot key never sits in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key in ``order``; ties fall to the smallest remaining columns.

    ``min_by`` over a struct is a partial aggregate: each task keeps one row per key before
    the shuffle, where a row_number window would ship and sort every row of the key.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    kept = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(kept.alias("_kept")).select(*keys, "_kept.*")


def last_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    kept = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(kept.alias("_kept")).select(*keys, "_kept.*")
