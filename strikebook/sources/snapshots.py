"""Replacing reference tables as a whole, and keeping the bytes of generated files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = "export string, as_of string, n_rows long, loaded_at timestamp, location string"


def replace_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame], as_of: str) -> bool:
    """Write every table to a new folder, then append the ledger rows that make them current.

    Readers follow the ledger, so they see all the new tables or none. Nothing changes when one
    of the exports is empty.
    """
    version, rows = uuid.uuid4().hex, []
    for name, df in tables.items():
        location = f"{root}/{name}/{version}"
        df.write.parquet(location)
        n = spark.read.parquet(location).count()
        if n == 0:
            return False
        rows.append((name, as_of, n, location))
    ledger = spark.createDataFrame(rows, "export string, as_of string, n_rows long, location string")
    ledger = ledger.withColumn("loaded_at", F.current_timestamp()).select("export", "as_of", "n_rows", "loaded_at", "location")
    ledger.coalesce(1).write.mode("append").parquet(f"{root}/_ledger")
    return True


def load_ledger(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{root}/_ledger")


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a table: the folder of its newest ledger row."""
    newest = load_ledger(spark, root).filter(F.col("export") == name).agg(F.max_by("location", "loaded_at"))
    return spark.read.parquet(newest.first()[0])


def load_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("export"), "n_rows") for name, df in tables.items()]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


def store_artifacts(files: DataFrame) -> DataFrame:
    """Exact bytes with their size and hash."""
    return files.withColumn("n_bytes", F.octet_length("content").cast("long")).withColumn("sha256", F.sha2("content", 256))


def artifact_history(sets: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest sets per note with a line per set about its files; the bytes are never read.

    ``limit`` is 50 by default and from 1 to 200.
    """
    k = 50 if limit is None else limit
    if not 1 <= k <= 200:
        raise ValueError("a history holds 1 to 200 sets")
    newest = Window.partitionBy("note_id").orderBy(F.col("generated_on").desc(), F.col("set_id").desc())
    kept = sets.withColumn("generation", F.row_number().over(newest)).filter(F.col("generation") <= k)
    # One file per operation and set: the nested list is a dozen entries at most.
    nested = files.groupBy("set_id").agg(
        F.count("*").alias("n_files"),
        F.sum("n_bytes").alias("n_bytes"),
        F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"),
    )
    return kept.join(nested, "set_id", "left")


def read_artifact(sets: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files by (note, file), only where the file's set belongs to that note."""
    owned = files.join(sets.select("set_id", "note_id"), "set_id")
    return wanted.join(owned, ["note_id", "file_id"])
