"""Streams over several micro-batches give what one batch gives."""

import datetime as dt
import random
import uuid
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from strikebook.operators import payoffs
from strikebook.plans import streams
from strikebook.session import checkpoint_dir
from strikebook.streaming import barriers, jobs


def test_autocall_state_spans_batches(spark):
    levels = {1: [65, 75, 55], 2: [95, 102, 50], 3: [60, 60, 71]}
    rows = [
        (n, dt.date(2024, 1, 1 + i), i + 1, Decimal(x), "fixed", Decimal(100), Decimal(100), Decimal(70), Decimal(70), Decimal(4), Decimal(1000), 3)
        for n, path in levels.items()
        for i, x in enumerate(path)
    ]
    schema = (
        "note_id long, obs_date date, obs_no int, price decimal(18,8), state string, s0 decimal(18,8), trigger_pct decimal(9,4), "
        "coupon_pct decimal(9,4), lower_pct decimal(9,4), coupon decimal(9,4), vn decimal(18,2), n_obs int"
    )
    obs = spark.createDataFrame(rows, schema)
    base = checkpoint_dir(spark, f"stream-test-{uuid.uuid4().hex}")
    for i in range(3):
        obs.filter(F.dayofmonth("obs_date") == i + 1).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.run(jobs.stream_autocall(stream), "append", f"{base}/state", jobs.keep(f"{base}/out"))
    got = spark.read.parquet(f"{base}/out").select("note_id", "obs_no", "obs_date", "kind", "amount")
    expected = payoffs.phoenix(obs.drop("n_obs", "obs_no"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_barriers_over_batches_with_late_ticks(spark):
    ticks_schema = "tick_id long, asset long, ts timestamp, price decimal(18,8)"
    notes_schema = "note_id long, asset long, quote_type string, direction string, level decimal(18,8), start_date date, end_date date"

    def day(n):
        return dt.date(2024, 1, n)

    notes = spark.createDataFrame(
        [
            (1, 7, "close", "up", Decimal(110), day(2), day(20)),
            (2, 7, "low", "down", Decimal(95), day(1), day(3)),
            (3, 7, "avg", "up", Decimal("105"), day(1), day(31)),
            (4, 8, "high", "up", Decimal(50), day(1), day(31)),
            (5, 7, "low", "down", Decimal(90), day(4), day(31)),
            (6, 7, "low", "down", Decimal("90.00000001"), day(4), day(31)),
            (7, 7, "other", "up", Decimal(1), day(1), day(31)),
            (8, 7, "high", "up", None, day(1), day(31)),
            (9, 8, "high", "up", Decimal(10), day(8), day(6)),
        ],
        notes_schema,
    )
    batches = [
        [(1, 7, 1, 9, 100), (2, 7, 1, 10, 120), (3, 7, 2, 9, 104), (4, 8, 1, 9, 10)],
        # the close of day 2 comes late, but before the day is judged
        [(5, 7, 2, 11, 111), (6, 7, 5, 9, 90), (7, 8, 6, 9, 60)],
        # a tick of a judged day is dropped
        [(8, 7, 1, 23, 1), (9, 7, 9, 9, 94), (10, 7, 20, 1, 100), (11, 8, 20, 1, 1)],
    ]
    registered = spark.createDataFrame(
        [(n, "0031", f"IF{n}", "40001", day(31), "2") for n in range(1, 10)],
        "note_id long, operation_code string, instrument_code string, issuer_account string, maturity_date date, direction_code string",
    )
    base = checkpoint_dir(spark, f"barrier-test-{uuid.uuid4().hex}")
    for rows in batches:
        arrived = [(i, asset, dt.datetime(2024, 1, d, hour), Decimal(price)) for i, asset, d, hour, price in rows]
        spark.createDataFrame(arrived, ticks_schema).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(ticks_schema).parquet(f"{base}/in")
        # small parts: ticks of an asset go to each of its parts, a note is in one
        watched = barriers.stream_barrier(stream, notes, notes_per_key=2)
        jobs.run(watched, "append", f"{base}/state", barriers.keep_firings(f"{base}/out", registered))
    rows = {r.note_id: r for r in barriers.firings(spark, f"{base}/out").collect()}
    assert {k: (r.first_breach, r.price) for k, r in rows.items()} == {
        1: (day(2), Decimal(111)),
        3: (day(1), Decimal(110)),
        4: (day(6), Decimal(60)),
        6: (day(5), Decimal(90)),
    }
    assert rows[1].line == "COE  10031IF1        40001     2024013122024010220240102" + "11100000000".rjust(20, "0")
    assert all(r.problem is None for r in rows.values())


def test_ticks_of_a_task_are_summed_up_once(spark):
    """More ticks than an Arrow batch holds; one has no price."""
    ticks = spark.range(5000).coalesce(1).selectExpr(
        "id AS tick_id", "7L AS asset", "timestamp_seconds(1704067200 + id) AS ts", "CAST(nullif(id, 10) AS DECIMAL(18,8)) AS price"
    )
    (row,) = barriers.daily_sums(ticks).collect()
    assert (row.last_id, row.close, row.n, row.high, row.low) == (4999, 4999 * barriers.UNIT, 4999, 4999 * barriers.UNIT, 0)
    assert row.whole * barriers.UNIT + row.rest == (sum(range(5000)) - 10) * barriers.UNIT


def test_assets_share_the_keys_of_the_barrier_state(spark, monkeypatch):
    monkeypatch.setattr(barriers, "GROUPS", 3)
    notes = spark.range(40).selectExpr(
        "id AS note_id", "id % 20 AS asset", "CASE WHEN id % 2 = 0 THEN 'high' ELSE 'close' END AS quote_type", "'up' AS direction",
        "CAST(100 + id AS DECIMAL(18,8)) AS level", "DATE'2024-01-01' AS start_date", "DATE'2024-01-04' AS end_date",
    )
    base = checkpoint_dir(spark, f"barrier-test-{uuid.uuid4().hex}")
    registered = notes.selectExpr("note_id", "'0031' AS operation_code")
    schema = "tick_id long, asset long, ts timestamp, price decimal(18,8)"
    for day, price in ((1, 110), (2, 125), (30, 1)):
        rows = [(day * 100 + a, a, dt.datetime(2024, 1, day), Decimal(price)) for a in range(20)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.run(barriers.stream_barrier(stream, notes, notes_per_key=1), "append", f"{base}/state", barriers.keep_firings(f"{base}/out", registered))
        if day == 1:
            assert spark.read.format("statestore").option("stateVarName", "index").load(f"{base}/state").count() <= 3
    got = sorted((r.note_id, r.first_breach.day, int(r.price)) for r in barriers.firings(spark, f"{base}/out").collect())
    assert got == [(n, 1, 110) if n <= 10 else (n, 2, 125) for n in range(26)]


def test_price_bands_keep_the_order_of_levels():
    levels = sorted({1, 2, 3, 99, 100, 101, *(7**k for k in range(1, 20)), *(10**k + d for k in range(1, 18) for d in (-1, 0, 1))})
    bands = [barriers.band_of(x) for x in [-5, 0, *levels]]
    assert bands == sorted(bands)


def test_newest_figure_file_counts(spark):
    schema = "figure_code string, content string, valid boolean, modified timestamp"
    base = checkpoint_dir(spark, f"figures-test-{uuid.uuid4().hex}")

    def at(n):
        return dt.datetime(2026, 1, n)

    batches = [
        [("A", "one", True, at(5)), ("A", "zero", True, at(4)), ("B", "bad", False, at(5))],
        [("A", "older", True, at(3)), ("B", "good", True, at(6))],
        [("A", "two", True, at(7)), ("A", "broken", False, at(8)), ("B", "good", True, at(9))],
        [("A", "three", True, at(9))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/in")
        jobs.stream_domain_files(spark, spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state")
    rows = spark.read.parquet(f"{base}/out").collect()
    assert sorted((r.batch_id, r.figure_code, r.outcome, r.version) for r in rows) == [
        (0, "A", "published", 1), (0, "B", "quarantined", 0), (1, "A", "stale", 1), (1, "B", "published", 1),
        (2, "A", "quarantined", 1), (2, "B", "unchanged", 1), (3, "A", "published", 2),
    ]


def test_a_table_of_part_files_streams_like_one_file(spark):
    base = checkpoint_dir(spark, f"table-stream-test-{uuid.uuid4().hex}")
    rows = spark.range(0, 20, 1, 4).withColumn("text", F.col("id").cast("string"))
    rows.write.parquet(f"{base}/folder/events.parquet")
    rows.coalesce(1).write.parquet(f"{base}/parts")
    Path(f"{base}/single").mkdir()
    next(Path(f"{base}/parts").glob("part-*.parquet")).rename(f"{base}/single/events.parquet")
    for sf in ("folder", "single"):
        # a table beside it whose name begins alike is not read
        rows.write.parquet(f"{base}/{sf}/events.parquet2")
        stream = streams.table_stream(spark, f"{base}/{sf}", "events")
        jobs.run(stream, "append", f"{base}/{sf}-state", jobs.keep(f"{base}/{sf}-out"))
        assert sorted(r.id for r in spark.read.parquet(f"{base}/{sf}-out").collect()) == list(range(20)), sf


def test_autocall_groups_hold_many_notes(spark):
    """Notes share a group of the state, over batches, with unresolved dates, missing ids and rows out of order."""
    draw = random.Random(5)
    rows = []
    for note in [*range(400), None]:
        n = draw.randint(1, 6)
        for i in range(1, n + 1):
            state = "unresolved" if draw.random() < 0.05 else "fixed"
            price = None if state == "unresolved" else Decimal(draw.randint(40, 103))
            rows.append((note, dt.date(2024, 1, i), i, price, state, Decimal(100), Decimal(100), Decimal(70), Decimal(55), Decimal("4.1234"), Decimal("1000.55"), n))
    draw.shuffle(rows)
    schema = (
        "note_id long, obs_date date, obs_no int, price decimal(18,8), state string, s0 decimal(18,8), trigger_pct decimal(9,4), "
        "coupon_pct decimal(9,4), lower_pct decimal(9,4), coupon decimal(9,4), vn decimal(18,2), n_obs int"
    )
    obs = spark.createDataFrame(rows, schema)
    base = checkpoint_dir(spark, f"stream-test-{uuid.uuid4().hex}")
    for i in range(3):
        obs.filter(F.floor((F.dayofmonth("obs_date") - 1) / 2) == i).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.run(jobs.stream_autocall(stream), "append", f"{base}/state", jobs.keep(f"{base}/out"))
    got = spark.read.parquet(f"{base}/out").select("note_id", "obs_no", "obs_date", "kind", "amount").collect()
    expected = payoffs.phoenix(obs.drop("n_obs", "obs_no")).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len(got) > 400
    # the state is asked for once a group and batch, not once a note
    assert "notes_of" in jobs.stream_autocall(stream)._jdf.queryExecution().logical().toString()
