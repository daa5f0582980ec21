"""Queries that drain a stream over the tables; most are compared with their batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikebook.functions.layouts import LAYOUTS
from strikebook.operators import payoffs
from strikebook.plans.clearing import d_record
from strikebook.plans.frames import frame, query
from strikebook.plans.registry import Registry
from strikebook.plans.settlement import PHOENIX, watched
from strikebook.plans.sources import scratch
from strikebook.plans.validation import (
    ALWAYS, CHANGED, DATES, EVERY_ROW, FIELDS, FIGURES, LENGTHS, NUMBERS, OPTIONS, REQUIRED, ROWS, RULES, SERVER, TYPED,
    _reached, checks, documents, expected,
)
from strikebook.sources.commit_log import CommitLog
from strikebook.streaming import barriers, jobs

registry = Registry()


def table_stream(spark, sf, table):
    """The table as a stream source, be it one file or a folder of part files."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    # A pattern may match either; a plain path would have to be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


def ticks(spark, sf):
    return table_stream(spark, sf, "events").select(
        F.col("event_id").alias("tick_id"), F.col("user_id").alias("asset"), "ts", F.to_date("ts").alias("fixing_date"),
        (F.lit(100) + F.col("value")).cast("decimal(18,8)").alias("price"),
    )


@registry.add("P6_stream_quotes", "SELECT * FROM {d_fixings} f")
def stream_quotes(spark, sf):
    path, checkpoint = scratch(spark, "quotes"), scratch(spark, "quotes-state")
    jobs.run(jobs.stream_quotes(ticks(spark, sf)), "update", checkpoint, jobs.keep(path))
    return jobs.latest(spark, path, ["asset", "fixing_date"])


REGISTERED = """SELECT note_id, CASE WHEN modality = 'VNP' THEN '0031' ELSE '0030' END AS operation_code, instrument_code, issuer_account, maturity_date,
 CASE WHEN modality = 'VNP' THEN '2' ELSE '1' END AS direction_code FROM {book} bk"""
TRIGGER = d_record(LAYOUTS["Y7_trigger"]["fixed"][1], set("operation_code instrument_code issuer_account maturity_date direction_code update_date trigger_date underlying_value".split()))[0]


@registry.add(
    "P4_stream_barrier",
    f"""SELECT h.note_id, first_breach, underlying_value AS price, {TRIGGER} AS line FROM (
 SELECT note_id, min(day) AS first_breach, min(day) AS update_date, min(day) AS trigger_date, arg_min(price, day) AS underlying_value FROM {{d_observed}} o
 WHERE CASE WHEN direction = 'up' THEN price >= level ELSE price < level END GROUP BY 1) h JOIN ({REGISTERED}) r ON r.note_id = h.note_id""",
)
def stream_barrier(spark, sf):
    """Ticks in three arrivals; some of a third's last day come with the next. A last arrival closes the days.

    What every micro-batch reads of the notes is derived once.
    """
    arrivals, path, checkpoint = scratch(spark, "ticks"), scratch(spark, "barrier"), scratch(spark, "barrier-state")
    every = frame(spark, sf, "ticks").select("tick_id", "asset", F.col("ts").cast("timestamp").alias("ts"), "price")
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    late = (F.dayofmonth("ts").isin(10, 20)) & (F.col("tick_id") % 5 == 0)
    close = every.agg((F.max("ts") + F.expr("interval 9 days")).alias("ts")).select(
        F.lit(-1).cast("long").alias("tick_id"), F.lit(-1).cast("long").alias("asset"), "ts", F.lit(1).cast("decimal(18,8)").alias("price")
    )
    numbered = every.withColumn("arrival", third + F.when(late, 1).otherwise(0))
    notes = frame(spark, sf, "barriers").select("note_id", "asset", "quote_type", "direction", "level", "start_date", "end_date")
    kept = scratch(spark, "barrier-notes")
    for name, df in (("registered", query(spark, sf, REGISTERED)), ("parts", barriers.asset_parts(notes))):
        df.write.parquet(f"{kept}/{name}")
    registered, parts = (spark.read.parquet(f"{kept}/{name}") for name in ("registered", "parts"))
    for part in [*(numbered.where(F.col("arrival") == i).drop("arrival") for i in range(3)), close]:
        part.write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(every.schema).parquet(arrivals)
        jobs.run(barriers.stream_barrier(stream, notes, parts=parts), "append", checkpoint, barriers.keep_firings(path, registered))
    return barriers.firings(spark, path).drop("problem")


@registry.add("P5_stream_autocall", PHOENIX)
def stream_autocall(spark, sf):
    arrivals, path, checkpoint = scratch(spark, "observed"), scratch(spark, "autocall"), scratch(spark, "autocall-state")
    numbered = payoffs.observation_no(watched(spark, sf)).select(
        "note_id", "obs_date", F.col("obs_no").cast("int").alias("obs_no"), "price", "state", "s0", "trigger_pct", "coupon_pct", "lower_pct", "coupon", "vn", F.col("n_obs").cast("int").alias("n_obs")
    ).where("state <> 'open'")
    numbered.write.parquet(arrivals)
    stream = spark.readStream.schema(numbered.schema).parquet(arrivals)
    jobs.run(jobs.stream_autocall(stream), "append", checkpoint, jobs.keep(path))
    return spark.read.parquet(path).drop("batch_id")


@registry.add(
    "P3_stream_edits",
    f"""
WITH changed AS ({CHANGED}), typed AS (SELECT t.*, c.exact, c.general, c.sections FROM ({TYPED}) t JOIN changed c ON c.note_id = t.note_id),
obs AS ({ROWS})
SELECT note_id, path, finding, severity FROM ({expected(
    NUMBERS + DATES + OPTIONS + LENGTHS + REQUIRED + ALWAYS + FIGURES + SERVER, EVERY_ROW, _reached)}) e""",
)
def stream_edits(spark, sf):
    path, checkpoint = scratch(spark, "edits"), scratch(spark, "edits-state")
    conversations = table_stream(spark, sf, "conversations")
    turn = F.col("turn")
    edited = (
        F.when(F.col("role") == "user", F.concat(F.lit("observations["), (turn % 3).cast("string"), F.lit("].couponBarrier")))
        .when(turn % 2 == 0, "payoff.cap")
        .when(turn % 3 == 0, "common.modality")
        .otherwise("common.maturityDate")
    )
    edits = conversations.select((F.col("conv_id") * 7 % 1500).alias("note_id"), edited.alias("path"))
    jobs.stream_edits(edits, documents(spark, sf), FIELDS, RULES, checks(spark, sf), path, checkpoint)
    found = jobs.current_findings(spark, path)
    return found.select("note_id", "path", F.coalesce("rule_id", "check").alias("finding"), "severity")


# Three listings: a first load, an older file of one export beside a new one of another, and an empty file.
LISTINGS = [
    [("20260828", "supplier", "{supplier}", "s_name"), ("20260828", "part", "{part}", "p_name")],
    [("20260820", "supplier", "{supplier}", "CAST(s_nationkey AS STRING)"), ("20260829", "part", "{part}", "p_type")],
    [("20260830", "supplier", "{supplier} WHERE 1 = 0", "s_name"), ("20260830", "region", "{region}", "r_name")],
]


@registry.add(
    "P1_stream_exports",
    "SELECT 'supplier' AS export, '20260828' AS stamp, CAST(s_name AS STRING) AS line FROM supplier UNION ALL "
    "SELECT 'part', '20260829', p_type FROM part UNION ALL SELECT 'region', '20260830', r_name FROM region",
)
def stream_exports(spark, sf):
    """Three arrivals of files; the tables hold the newest good file of each export."""
    arrivals, root, checkpoint = scratch(spark, "arrivals"), scratch(spark, "tables"), scratch(spark, "exports-state")
    names = ["supplier", "part", "region", "nation"]
    exports_ = spark.createDataFrame([(n,) for n in names], "export string")
    aliases = spark.createDataFrame([(n, n.title(), 1) for n in names], "export string, alias string, alias_rank int")
    for listing in LISTINGS:
        for stamp, name, table, column in listing:
            lines = query(spark, sf, f"SELECT {column} AS line FROM {table}")
            # An export is one file by name; a folder of its date keeps the name the exchange gives it.
            lines.coalesce(1).write.text(f"{arrivals}/{stamp}_{name}.csv")
        files = (
            spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("recursiveFileLookup", "true").load(arrivals)
            .select(F.regexp_extract("path", r"(.*)/part-[^/]*$", 1).alias("path"), "length")
        )
        jobs.stream_exports(spark, files, exports_, aliases, root, checkpoint)
    log = CommitLog(spark, root)
    out = None
    for name in names[:3]:
        held = log.head(name)
        rows = log.read(name).select(F.lit(name).alias("export"), F.lit(held["stamp"]).alias("stamp"), "line")
        out = rows if out is None else out.unionByName(rows)
    return out


# Two arrivals: every figure's first file, then a later one of some, an older one of others and the same of the rest.
DRAFTS = """SELECT p_partkey AS figure_code, concat('{"figureCode":', CAST(p_partkey AS STRING), ',"name":"', p_name, '"', CASE WHEN p_size % 7 = 0 THEN '' ELSE '}' END) AS content,
 p_size % 7 <> 0 AS valid, CAST(DATE '2026-01-10' AS TIMESTAMP) AS modified FROM {part}"""
REVISIONS = """SELECT p_partkey AS figure_code, concat('{"figureCode":', CAST(p_partkey AS STRING), ',"name":"', CASE WHEN p_size % 3 = 2 THEN p_name ELSE p_type END, '"', CASE WHEN p_size % 5 = 0 THEN '' ELSE '}' END) AS content,
 p_size % 5 <> 0 AS valid, CAST(DATE '2026-01-01' + CAST(p_size % 3 * 10 AS INT) AS TIMESTAMP) AS modified FROM {part}"""


@registry.add(
    "P2_stream_domain_files",
    f"""
WITH a AS (SELECT * FROM ({DRAFTS}) d), b AS (SELECT * FROM ({REVISIONS}) r),
j AS (SELECT b.*, a.valid AS held, sha256(a.content) AS before, sha256(b.content) AS content_hash, a.modified AS since FROM a JOIN b ON b.figure_code = a.figure_code)
SELECT figure_code, content_hash, CASE WHEN held AND before = content_hash THEN 'unchanged' WHEN held AND modified < since THEN 'stale' WHEN valid THEN 'published' ELSE 'quarantined' END AS outcome,
  CAST(held AS INT) + CAST(valid AND NOT (held AND (before = content_hash OR modified < since)) AS INT) AS version FROM j""",
)
def stream_domain_files(spark, sf):
    arrivals, path, checkpoint = scratch(spark, "drafts"), scratch(spark, "figures"), scratch(spark, "figures-state")
    for text in (DRAFTS, REVISIONS):
        files = query(spark, sf, text)
        files.write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(files.schema).parquet(arrivals)
        jobs.stream_domain_files(spark, stream, path, checkpoint)
    return jobs.latest(spark, path, ["figure_code"]).drop("modified")
