"""Session settings the operators rely on."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates and daily windows are calendar dates, never the machine's.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins on a hot key are split by Spark at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Generated methods above this size are not compiled by the JVM; Spark then splits them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be whole documents, some of them very long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strikebook")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def one_process(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process, as in tests."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def release(spark: SparkSession) -> None:
    """Ask for shuffle files of finished jobs to be deleted; they stay on the executors' disks until the driver collects its garbage.

    Executors of their own leave the driver little garbage, so that may be long after. A single process collects often.
    """
    if not one_process(spark):
        # the first collection frees the plans, the next ones the shuffles they held
        for _ in range(3):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    """A folder for stream state and written intermediates, shared by all executors.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local master, as in tests, may leave
    it unset and gets a temporary folder, one for each application; elsewhere executors would each write to
    their own disk, so the job is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        context = spark.sparkContext
        if not one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL_ROOTS.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="strikebook-")
        _LOCAL_ROOTS[context.applicationId] = root
    return f"{root.rstrip('/')}/{name}"


#: Temporary folders of local applications that set no shared folder.
_LOCAL_ROOTS: dict[str, str] = {}
