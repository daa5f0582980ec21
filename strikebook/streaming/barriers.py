"""Barriers watched as ticks arrive: open levels live in keyed state, ordered by price band.

Ticks are summed up per asset and day inside each task, so a busy asset sends few rows per task and day. Assets are
dealt to a fixed number of groups, each a key of the state whose notes and days are worked on as arrays; an asset with
many notes has several parts, in groups of their own, and its daily sums go to each. A day is
judged once the watermark has passed it, with the quote each note registers. Only bands on the far side of the days'
prices are read. A note leaves the state when it fires or when a timer finds its window closed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strikebook.operators.clearing import render
from strikebook.functions.layouts import LAYOUTS
from strikebook.operators.fixings import QUOTES

#: Notes of an asset that share one key of the state.
NOTES_PER_KEY = 50_000
#: Keys of the state; each holds the assets, or parts of an asset, that hash to it.
GROUPS = 1024
#: Ticks a task holds at once to sum them up.
TICKS_AT_ONCE = 500_000
DAY_MS = 86_400_000
#: Prices and levels are counted in units of 10 ** -8.
UNIT = 100_000_000
DIRECTIONS = ("up", "down")
#: Bands a doubling of the level is divided into.
BANDS = 4
#: Stands for a missing price, and for a missing tick number, which counts as the last.
ABSENT, LAST = -(2**63), 2**63 - 1
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_NOTE = np.dtype([("asset", "<i8"), ("level", "<i8"), ("note", "<i8"), ("start", "<i4"), ("end", "<i4")])
#: What is known of an asset's day: the last tick, the sum of prices in whole numbers and the rest, their number, highest and lowest.
_DAY = np.dtype([(f, "<i8") for f in ("asset", "day", "micros", "last_id", "close", "whole", "rest", "n", "high", "low")])
_SUMS = ", ".join(f"{f} long" for f in _DAY.names)
FIRINGS = "note_id long, first_breach date, price decimal(18,8)"


def merged(days: np.ndarray) -> np.ndarray:
    """One row per asset and day, in this order, of rows that may share them."""
    if not len(days):
        return days
    days = days[np.lexsort([days[f] for f in ("close", "last_id", "micros", "day", "asset")])]
    first = np.ones(len(days), bool)
    first[1:] = (days["asset"][1:] != days["asset"][:-1]) | (days["day"][1:] != days["day"][:-1])
    starts = np.flatnonzero(first)
    out = days[np.append(starts[1:], len(days)) - 1]
    for name, of in (("whole", np.add), ("rest", np.add), ("n", np.add), ("high", np.maximum), ("low", np.minimum)):
        out[name] = of.reduceat(days[name], starts)
    return out


def daily_sums(ticks: DataFrame) -> DataFrame:
    """Ticks (tick_id, asset, ts, price) as few rows per task, asset and day, which later rows can be added to."""

    def summed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        days = np.empty(rows.num_rows, _DAY)
        for name in ("asset", "day", "micros", "last_id", "close"):
            days[name] = rows.column(name).to_numpy()
        known = days["close"] != ABSENT
        # the sum of a day may pass 64 bits
        days["whole"], days["rest"] = np.divmod(np.where(known, days["close"], 0), UNIT)
        days["n"], days["high"], days["low"] = known, days["close"], np.where(known, days["close"], LAST)
        days = merged(days)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(days[f])) for f in _DAY.names], names=list(_DAY.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TICKS_AT_ONCE:
                yield summed(held)
                held, n = [], 0
        if n:
            yield summed(held)

    ts = F.col("ts").cast("timestamp")
    rows = ticks.where("asset is not null and ts is not null").select(
        "asset", F.unix_date(F.to_date(ts)).cast("long").alias("day"), F.unix_micros(ts).alias("micros"),
        F.coalesce("tick_id", F.lit(LAST)).alias("last_id"), F.coalesce((F.col("price") * UNIT).cast("long"), F.lit(ABSENT)).alias("close"),
    )
    return rows.mapInArrow(run, _SUMS).withColumn("ts", F.timestamp_micros("micros"))


def band_of(level: np.ndarray | int) -> np.ndarray:
    """Bands ascend with the level; levels of nought and below share the first."""
    mantissa, exponent = np.frexp(np.asarray(level, "float64"))
    band = (exponent - 1) * BANDS + np.floor((2 * mantissa - 1) * BANDS)
    return np.where(np.asarray(level) > 0, band, -1).astype("int64")


def quotes(days: np.ndarray) -> np.ndarray:
    """A row of prices per quote, as ``QUOTES`` names them; a day without a price has none."""
    n = np.maximum(days["n"], 1)
    mean, left = np.divmod(days["whole"], n)
    mean = mean * UNIT + (2 * (left * UNIT + days["rest"]) + n) // (2 * n)
    found = {"close": days["close"], "avg": mean, "high": days["high"], "low": days["low"]}
    return np.array([np.where(days["n"] > 0, found[q], ABSENT) for q in QUOTES])


class BarrierWatch(StatefulProcessor):
    """Open days, the bands that exist with the first day a note of theirs ends on, and their notes in one or more runs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getValueState("days", "days binary")
        self.index = handle.getValueState("index", "bands string")
        self.notes = handle.getMapState("notes", "band string, run int", "notes binary")

    def _held(self) -> tuple[int | None, dict[str, list[int]]]:
        """The timer that is set, and per band its number of runs and first end."""
        return tuple(json.loads(self.index.get()[0])) if self.index.exists() else (None, {})

    def _open(self) -> np.ndarray:
        return np.frombuffer(self.days.get()[0], _DAY) if self.days.exists() else np.empty(0, _DAY)

    def _hold(self, timer: int | None, bands: dict[str, list[int]], days: np.ndarray, closed: int) -> None:
        """Stores the index with a timer for the first day to close or to end notes."""
        at = min([*(end for _, end in bands.values()), *days["day"].tolist()], default=None)
        at = None if at is None else max(at + 1, closed + 1) * DAY_MS
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        self.index.update((json.dumps([at, bands]),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802
        timer, bands = self._held()
        notes = np.empty(len(initialState), _NOTE)
        for name in _NOTE.names:
            notes[name] = initialState[name].to_numpy()
        named = initialState.quote_type + ":" + initialState.direction + ":" + pd.Series(band_of(notes["level"]).astype(str), initialState.index)
        for band, at in named.groupby(named).indices.items():
            runs, end = bands.get(band, (0, LAST))
            self.notes.updateValue((band, runs), (notes[at].tobytes(),))
            bands[band] = [runs + 1, min(end, int(notes["end"][at].min()))]
        self._hold(timer, bands, self._open(), timerValues.getCurrentWatermarkInMs() // DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        came = []
        for part in rows:
            days = np.empty(len(part), _DAY)
            for name in _DAY.names:
                days[name] = part[name].to_numpy()
            came.append(days[days["day"] >= closed])  # earlier days have been judged
        if sum(map(len, came)):
            days = merged(np.concatenate([self._open(), *came]))
            self.days.update((days.tobytes(),))
            self._hold(*self._held(), days, closed)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Judges every day that has closed, then lets go of the notes whose window is over."""
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        days, (timer, bands) = self._open(), self._held()
        past, days = days[days["day"] < closed], days[days["day"] >= closed]
        prices = quotes(past)
        touched = [b for b, (_, end) in bands.items() if end < closed or self._reached(b, prices)]
        read = [np.concatenate([np.frombuffer(self.notes.getValue((b, r))[0], _NOTE) for r in range(bands[b][0])]) for b in touched]
        fired = []
        if touched:
            alive = self._judge(touched, read, past, prices, fired)
            for band, notes, open_ in zip(touched, read, np.split(alive, np.cumsum([len(r) for r in read])[:-1]), strict=True):
                self._keep(band, notes, open_ & (notes["end"] >= closed), bands)
        if len(past):
            self.days.update((days.tobytes(),))
        # the timer that has run out is gone
        self._hold(None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, bands, days, closed)
        if fired:
            yield pd.DataFrame(np.concatenate(fired), columns=["note_id", "day", "units"])

    @staticmethod
    def _reached(band: str, prices: np.ndarray) -> bool:
        quote, direction, number = band.split(":")
        seen = prices[QUOTES.index(quote)]
        seen = seen[seen != ABSENT]
        if not len(seen):
            return False
        return int(number) <= band_of(seen.max()) if direction == DIRECTIONS[0] else int(number) >= band_of(seen.min())

    @staticmethod
    def _judge(bands: list[str], read: list[np.ndarray], past: np.ndarray, prices: np.ndarray, fired: list) -> np.ndarray:
        """Which notes stay open, day by day; the others are added to ``fired`` as (note, day, price)."""
        notes, sizes = np.concatenate(read), [len(r) for r in read]
        quote = np.repeat([QUOTES.index(b.split(":")[0]) for b in bands], sizes)
        up = np.repeat([b.split(":")[1] == DIRECTIONS[0] for b in bands], sizes)
        alive = np.ones(len(notes), bool)
        for day in np.unique(past["day"]):
            rows = np.flatnonzero(past["day"] == day)
            assets = past["asset"][rows]
            at = np.minimum(np.searchsorted(assets, notes["asset"]), len(rows) - 1)
            price = prices[quote, rows[at]]
            hit = alive & (assets[at] == notes["asset"]) & (price != ABSENT) & (notes["start"] <= day) & (notes["end"] >= day)
            hit &= np.where(up, notes["level"] <= price, notes["level"] > price)
            if hit.any():
                fired.append(np.column_stack([notes["note"][hit], np.full(hit.sum(), day), price[hit]]))
                alive &= ~hit
        return alive

    def _keep(self, band: str, notes: np.ndarray, stay: np.ndarray, bands: dict[str, list[int]]) -> None:
        if stay.all():
            return
        for run in range(1 if stay.any() else 0, bands[band][0]):
            self.notes.removeKey((band, run))
        if stay.any():
            self.notes.updateValue((band, 0), (notes[stay].tobytes(),))
            bands[band] = [1, int(notes["end"][stay].min())]
        else:
            del bands[band]

    def close(self) -> None:
        pass


def _watched(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("quote_type").isin(*QUOTES) & F.col("direction").isin(*DIRECTIONS)).dropna(
        subset=["note_id", "asset", "level", "start_date", "end_date"]
    )


def asset_parts(notes: DataFrame, notes_per_key: int = NOTES_PER_KEY) -> DataFrame:
    """The number of parts (asset, parts) that each asset's notes are dealt to."""
    return _watched(notes).groupBy("asset").agg(F.ceil(F.count("*") / notes_per_key).cast("int").alias("parts"))


def _group(asset, part):
    return F.pmod(F.xxhash64(asset, part), F.lit(GROUPS)).cast("int")


def stream_barrier(ticks: DataFrame, notes: DataFrame, delay: str = "2 days", notes_per_key: int = NOTES_PER_KEY, parts: DataFrame | None = None) -> DataFrame:
    """A row per note whose barrier is breached, once: note_id, first_breach, price.

    ``ticks`` is a stream (tick_id, asset, ts, price); ``notes`` a table (note_id, asset, quote_type, direction,
    level, start_date, end_date). Ticks later than ``delay`` are dropped, as their day has been judged. Notes
    with a null in any of these, an unknown quote or direction never fire. ``parts`` is what ``asset_parts`` gives;
    every micro-batch reads it, so it is best stored.
    """
    spark = notes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    parts = asset_parts(notes, notes_per_key) if parts is None else parts
    days = [F.unix_date(f"{n}_date").alias(n) for n in ("start", "end")]
    dealt = _watched(notes).join(parts, "asset").select(
        _group(F.col("asset"), F.pmod(F.xxhash64("note_id"), "parts").cast("int")).alias("grp"), "asset", F.col("note_id").alias("note"),
        "quote_type", "direction", (F.col("level") * UNIT).cast("long").alias("level"), *days,
    )
    sums = daily_sums(ticks).withWatermark("ts", delay).join(parts, "asset")
    # parts that share a group get a sum once
    groups = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: _group(F.col("asset"), p)))
    fired = sums.withColumn("grp", F.explode(groups)).drop("parts").groupBy("grp").transformWithStateInPandas(
        statefulProcessor=BarrierWatch(),
        outputStructType="note_id long, day long, units long",
        outputMode="append",
        timeMode="eventTime",
        initialState=dealt.groupBy("grp"),
    )
    return fired.select(
        "note_id",
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("first_breach"),
        (F.col("units").cast("decimal(28,0)") / UNIT).cast("decimal(18,8)").alias("price"),
    )


def trigger_records(firings: DataFrame, notes: DataFrame) -> DataFrame:
    """The clearing record of each firing, from what ``notes`` registers of it; an unfit value is named in ``problem``."""
    event = firings.join(notes, "note_id").withColumns(
        {"update_date": F.col("first_breach"), "trigger_date": F.col("first_breach"), "underlying_value": F.col("price")}
    )
    return render(event, LAYOUTS["Y7_trigger"]["fixed"][1])


def keep_firings(path: str, notes: DataFrame):
    """A sink that stores each batch's firings with their records; a batch that is run again replaces its own.

    Firings are stored first, so that the notes are joined outside the stream's plan, and only if some fired.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, place = notes.sparkSession, f"{path}/_fired/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(place)
        fired = spark.read.schema(FIRINGS).parquet(place)
        if fired.isEmpty():
            fired = spark.createDataFrame([], FIRINGS)
        columns = ["note_id", "first_breach", "price", "line", "problem"]
        trigger_records(fired, notes).select(*columns).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def firings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")
