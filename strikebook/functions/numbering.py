"""Row numbers inside a key without sending one hot key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """1-based position of each row inside ``keys`` by ``order``.

    ``bucket`` must not decrease along ``order`` (a month, a block of ids). Rows are ranked inside
    (keys, bucket) and shifted by the number of rows in earlier buckets, so the largest sort is
    one bucket, and what is windowed per key is one row per bucket.
    """
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(inner))
    return (
        ranked.join(offsets, [*keys, "_b"])
        .withColumn(out, (F.col("_rank") + F.col("_before")).cast("long"))
        .drop("_b", "_rank", "_before")
    )
