"""Streaming jobs: the same operators, run as data arrives.

Every job drains what is there (``availableNow``) or runs on; state and offsets live under the
shared checkpoint folder, so a lost executor or a restart resumes where the stream stood. A sink
is a parquet folder to which every micro-batch appends under its batch id; a batch that is run
again overwrites its own rows. Readers take the last row of each key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strikebook.functions.dedupe import last_wins
from strikebook.functions.exact import at_least, money, percent, ratio
from strikebook.operators import validation as v
from strikebook.sources.commit_log import CommitLog
from strikebook.sources.exports import newest_export, sync_status
from strikebook.sources.single_byte import read_lines


def run(stream: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Drain the stream through ``each`` once and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


def keep(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of each key over all micro-batches."""
    return last_wins(spark.read.parquet(path), keys, ["batch_id"]).drop("batch_id")


def stream_quotes(ticks: DataFrame, delay: str = "2 days") -> DataFrame:
    """Daily quote types in a tumbling window on event time; update mode re-emits changed days."""
    return (
        ticks.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy("asset", F.window("ts", "1 day"))
        .agg(
            F.max_by("price", F.struct("ts", "tick_id")).alias("close"),
            F.round(F.avg("price"), 8).cast("decimal(18,8)").alias("avg"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
        )
        .select("asset", F.to_date("window.start").alias("fixing_date"), "close", "avg", "high", "low")
    )


#: Groups of the autocall state; a group holds every so-manyth note, so its rows are worked on as one array.
AUTOCALL_GROUPS = 4096
STEPS = "known boolean, id long, obs_no long, day long, step int, periods int, vn long, coupon long, principal long"
#: Stands for a missing value in the whole numbers that pass through the state.
ABSENT = -(2**63)
STATE = "notes binary"
COUPON, CALLED, MATURITY, UNRESOLVED = range(4)
_SEEN = np.dtype([("known", "?"), ("note", "<i8"), ("last_paid", "<i4"), ("done", "?")])


def _group_steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The payments of a group of notes; the state holds each note's last paid number and whether it has ended."""
    rows = pd.concat(list(batches), ignore_index=True)
    held = np.frombuffer(state.get[0], _SEEN) if state.exists else np.empty(0, _SEEN)
    # a missing note is a note of its own
    known, ids = rows.known.to_numpy(bool), rows.id.to_numpy("int64")
    order = np.lexsort((rows.obs_no.to_numpy(), ids, known))
    rows, known, ids = rows.iloc[order], known[order], ids[order]
    n = len(rows)
    first = np.ones(n, bool)
    first[1:] = (known[1:] != known[:-1]) | (ids[1:] != ids[:-1])
    note, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    before = {(bool(k), int(i)): (int(p), bool(d)) for k, i, p, d in held.tolist()}
    came = [(bool(k), int(i)) for k, i in zip(known[starts], ids[starts], strict=True)]
    paid_before = np.array([before.get(c, (0, False))[0] for c in came], "int64")
    done_before = np.array([before.get(c, (0, False))[1] for c in came], bool)
    no = rows.obs_no.to_numpy("int64")
    unresolved, called = rows.unresolved.to_numpy(bool), rows.called.to_numpy(bool) & ~rows.unresolved.to_numpy(bool)
    ends = unresolved | called | (no == rows.n_obs.to_numpy("int64"))
    # rows after the one that ends a note are not looked at
    passed = np.cumsum(ends) - ends
    alive = (passed == passed[starts][note]) & ~done_before[note]
    paid = alive & rows.paid.to_numpy(bool) & ~unresolved
    # numbers ascend in a note, so the last paid one before a row is the largest
    position = np.where(paid, np.arange(n), -1)
    earlier = np.maximum.accumulate(np.concatenate(([-1], position[:-1]))) if n else position
    own = earlier >= starts[note]
    periods = no - np.where(own, no[np.maximum(earlier, 0)], paid_before[note])
    latest = np.maximum.accumulate(position)[np.append(starts[1:], n) - 1]
    last_paid = np.where(latest >= starts, no[np.maximum(latest, 0)], paid_before)
    ended = done_before | np.bitwise_or.reduceat(alive & ends, starts)
    before.update(zip(came, zip(last_paid.tolist(), ended.tolist(), strict=True), strict=True))
    state.update((np.array([(k, i, p, d) for (k, i), (p, d) in before.items()], _SEEN).tobytes(),))
    end = np.where(unresolved, UNRESOLVED, np.where(called & (no < rows.n_obs.to_numpy("int64")), CALLED, MATURITY))
    for chosen, step in ((paid, np.zeros(n, "int64")), (alive & ends, end)):
        if chosen.any():
            out = rows.loc[chosen, ["known", "id", "obs_no", "day", "vn", "coupon", "principal"]].assign(step=step[chosen], periods=periods[chosen])
            yield out[["known", "id", "obs_no", "day", "step", "periods", "vn", "coupon", "principal"]]


def _whole(value: Column, decimals: int) -> Column:
    """A decimal as a whole number of its last place; an array of these is cheap, one of decimals is not."""
    return F.coalesce((value.cast(f"decimal(18,{decimals})") * 10**decimals).cast("long"), F.lit(ABSENT))


def _value(column: str, decimals: int) -> Column:
    unit = F.lit(f"{10**-decimals:.{decimals}f}").cast(f"decimal({decimals + 1},{decimals})")
    value = F.col(column).cast("decimal(19,0)") * unit
    return F.when(F.col(column) != ABSENT, value.cast(f"decimal(18,{decimals})"))


def stream_autocall(observations: DataFrame) -> DataFrame:
    """Coupons and redemption as fixings arrive in the order of the schedule; a few numbers of state per note.

    Each row brings its registered number, trigger and barriers. A row may say that a past date is unresolved; that
    ends what can be said of the note. Prices are compared and amounts computed in the plan; the state is keyed by
    groups of notes and says which observation pays for how many periods.
    """
    price, s0 = F.col("price"), F.col("s0")
    called, no = at_least(price, F.col("trigger_pct"), s0), F.lit(False)
    kept = called | at_least(price, F.col("lower_pct"), s0)
    steps = (
        observations.select(
            F.col("obs_no").cast("long").alias("obs_no"), F.col("n_obs").cast("long").alias("n_obs"),
            F.coalesce(F.unix_date("obs_date").cast("long"), F.lit(ABSENT)).alias("day"),
            _whole(F.col("vn"), 2).alias("vn"), _whole(F.col("coupon"), 4).alias("coupon"),
            F.col("note_id").isNotNull().alias("known"), F.coalesce("note_id", F.lit(0).cast("long")).alias("id"),
            F.pmod(F.xxhash64("note_id"), F.lit(AUTOCALL_GROUPS)).cast("int").alias("notes_of"),
            F.coalesce(F.col("state") == "unresolved", no).alias("unresolved"),
            F.coalesce(at_least(price, F.col("coupon_pct"), s0), no).alias("paid"), F.coalesce(called, no).alias("called"),
            _whole(F.when(kept, F.col("vn")).otherwise(money(F.col("vn"), ratio(price, s0))), 2).alias("principal"),
        )
        .groupBy("notes_of")
        .applyInPandasWithState(_group_steps, STEPS, STATE, "append", GroupStateTimeout.NoTimeout)
    )
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("coupon", "early redemption", "maturity", "unresolved")]), F.col("step") + 1)
    coupon = money(_value("vn", 2), percent(_value("coupon", 4)) * F.col("periods"))
    amount = F.when(F.col("step") == COUPON, coupon).when(F.col("step") != UNRESOLVED, _value("principal", 2))
    day = F.when(F.col("day") != ABSENT, F.date_from_unix_date(F.col("day").cast("int")))
    return steps.select(F.when(F.col("known"), F.col("id")).alias("note_id"), F.col("obs_no").cast("int").alias("obs_no"), day.alias("obs_date"), kinds.alias("kind"), amount.cast("decimal(18,2)").alias("amount"))


def stream_edits(
    edits: DataFrame, documents: DataFrame, fields: list[dict], rules: list[dict], checks: v.Checks,
    path: str, checkpoint: str,
) -> None:
    """Validate what each batch of edits reaches; store findings and the paths spoken for."""

    def each(batch: DataFrame, batch_id: int) -> None:
        changed = batch.groupBy("note_id").agg(F.collect_set("path").alias("changed"))
        notes = documents.join(changed, "note_id")
        found = v.validate(notes, fields, rules, checks, "field", changed="changed")
        found.write.mode("overwrite").parquet(f"{path}/findings/batch_id={batch_id}")
        spoken = v.evaluated_paths(notes, fields, rules, checks, "field", "changed")
        spoken.write.mode("overwrite").parquet(f"{path}/spoken/batch_id={batch_id}")

    run(edits, "append", checkpoint, each)


def current_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the last batch that spoke for their path; older ones are superseded."""
    spoken = spark.read.parquet(f"{path}/spoken").groupBy("note_id", "path").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{path}/findings").join(spoken, ["note_id", "path", "batch_id"]).drop("batch_id")


def load_exports(
    spark: SparkSession, files: DataFrame, exports: DataFrame, aliases: DataFrame, root: str, batch_id: int, allow_older: bool = False
) -> DataFrame:
    """Load what a listing (path, length) brings: each export's newest file, unless it is held or a newer one is.

    Exports are loaded one by one; one that fails leaves its table alone and the others go on. The result, also
    stored under the batch, has a row per export that came or is missing altogether: export, name, stamp, held,
    status, n_rows, detail.
    """
    log = CommitLog(spark, root)
    named = files.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))
    newest = newest_export(named.select("name"), aliases)
    due = sync_status(exports, newest, log.heads(), allow_older)
    found = due.join(newest.select("export", "name"), "export", "left").join(named, "name", "left")
    rows = []
    # as many rows as there are exports in the catalogue
    for r in found.where("stamp is not null or held is null").select("export", "name", "stamp", "held", "status", "path", "length").toLocalIterator():
        status, n_rows, detail = r.status, None, None
        if status == "downloaded":
            location = f"{root}/{quote(r.export, safe='')}/{r.stamp}-{uuid.uuid4().hex[:12]}"
            try:
                if not r.length:
                    raise ValueError(f"{r.name} is empty")
                read_lines(spark, r.path).select("line_no", "line").write.parquet(location)
                n_rows = spark.read.parquet(location).count()
                status = log.append(r.export, r.stamp, r.name, n_rows, location, batch_id, allow_older)
            except (ValueError, PySparkException, Py4JJavaError) as error:
                status, detail = "failed", str(error).splitlines()[0][:300]
        rows.append((r.export, r.name, r.stamp, r.held, status, n_rows, detail))
    result = spark.createDataFrame(rows, "export string, name string, stamp string, held string, status string, n_rows long, detail string")
    result.coalesce(1).write.mode("overwrite").parquet(f"{root}/_outcomes/batch_id={batch_id}")
    return result


def stream_exports(spark: SparkSession, files: DataFrame, exports: DataFrame, aliases: DataFrame, root: str, checkpoint: str) -> None:
    """Load the newest file of each export as files arrive; ``files`` streams (path, length) of a folder.

    Tables are merged export by export through their commit logs. A batch that is run again finds its stamps held.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        load_exports(spark, batch, exports, aliases, root, batch_id)

    run(files.select("path", "length"), "append", checkpoint, each)


PUBLISHED = "figure_code long, content_hash string, modified timestamp, outcome string, version int"


def stream_domain_files(spark: SparkSession, files: DataFrame, path: str, checkpoint: str) -> None:
    """Publish changed figure files as new versions; unchanged ones are skipped, bad ones quarantined.

    A quarantined file leaves the figure's active version alone. ``files`` holds (figure_code, content, valid,
    modified). Of a figure's files in a batch the newest counts, of equally new ones the one with the largest hash; one that
    is older than the version published last is named stale and changes nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    schema = PUBLISHED.replace("figure_code long", f"figure_code {kinds['figure_code']}")
    # an empty batch before the first, so that there always is a table to read
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch_id=-1")

    def each(batch: DataFrame, batch_id: int) -> None:
        hashed = last_wins(batch.withColumn("content_hash", F.sha2("content", 256)), ["figure_code"], ["modified", "content_hash"])
        earlier = spark.read.parquet(path).filter((F.col("outcome") == "published") & (F.col("batch_id") < batch_id))
        known = last_wins(earlier, ["figure_code"], ["version"]).select(
            "figure_code", F.col("content_hash").alias("_hash"), F.col("version").alias("_version"), F.col("modified").alias("_modified")
        )
        joined = hashed.join(known, "figure_code", "left")
        outcome = (
            F.when(F.col("_hash").eqNullSafe(F.col("content_hash")), "unchanged")
            .when(F.coalesce(F.col("modified") < F.col("_modified"), F.lit(False)), "stale")
            .when(F.col("valid"), "published")
            .otherwise("quarantined")
        )
        version = F.coalesce("_version", F.lit(0)) + F.when(outcome == "published", 1).otherwise(0)
        result = joined.select("figure_code", "content_hash", "modified", outcome.alias("outcome"), version.alias("version"))
        result.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run(files, "append", checkpoint, each)
