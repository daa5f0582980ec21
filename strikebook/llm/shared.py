"""What several operators need: shared folders for intermediates, written tables, a checked broadcast."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikebook.session import checkpoint_dir

#: Rows of a thin side (a few short columns) up to which a broadcast hint is given.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder in ``spark.checkpoint.dir``."""
    return checkpoint_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut, safe if executors go.

    Shuffle files that only this write needed stay on the executors' disks until the driver collects its
    garbage. ``release`` asks for that at once, for steps that shuffle about as much as the input holds; a local
    master, as in tests, is spared the wait.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if release and not spark.sparkContext.master.startswith("local"):
        # the first collection frees the plans, the next ones the shuffles they held
        for _ in range(3):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
    return spark.read.schema(df.schema).parquet(path)


def small_or_plain(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a written table that is counted to be small; any other is left to the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def carried(columns: list[str], results: tuple[str, ...], needed: tuple[str, ...] = ()) -> list[str]:
    """The input's columns that stay: all but those named like a result, in any case."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c in needed or c.lower() not in taken]


def integer_key(df: DataFrame, key: str) -> None:
    """Refuses keys that are no integers before any work is done."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer column, not {kind}")
