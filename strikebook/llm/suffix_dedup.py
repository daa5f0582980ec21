"""Exact substring deduplication over all texts as bytes, with a run-length index per bucket of candidates.

A byte goes if a string of ``SIZE`` bytes that covers it also starts earlier: in a document with a smaller
key, or earlier in the same one.

1. *Anchors.* Every window of SIZE bytes picks the 32-byte string in it with the least hash; consecutive
   windows with the same pick form a block. Equal windows pick alike, so a repeat shows as blocks with the
   same anchor. Blocks travel as hashes. Blocks with equal content are settled by hash alone: all but the
   earliest go, within a task before the shuffle, else by a window over the anchor.
2. *Hot anchors.* Tasks first report their most frequent anchors; for those with ``HOT_FROM`` blocks or more
   every window travels by the hash of its whole content instead, so no anchor gathers a large group.
3. *Run-length index.* Blocks that share an anchor but not their content get their bytes by a join with
   the texts and meet in buckets by anchor. Each bucket is indexed (``run_index``) in order of place; the
   streamed matching statistics mark the windows that another block holds; all but the earliest go.
4. Removed ranges are merged per document.

Defined cases: a null text is empty. Texts shorter than SIZE keep everything. Rows with a null key precede
all others. Rows that share a key are ordered by a 64-bit hash of their text; rows equal in both are one
document and get the same result. Empty tables give no rows. Columns of the input with the names of results are
replaced; a null text stays null where texts are returned. Contents are compared by 64-bit hashes in steps 1 and 2, byte by byte in step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikebook.llm.run_index import repeated_windows
from strikebook.llm.shared import carried, integer_key, table, written
from strikebook.llm.shingles import byte_sums, mixed, range_hashes

SIZE, ANCHOR = 100, 32
HOT_FROM, HOT_MOST, REPORTED = 2_000, 65_536, 4_096
#: Blocks a task holds to settle equal ones before the shuffle; bytes of a bucket.
HELD, BUCKET_BYTES = 1_000_000, 1 << 20


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values: from running minima of blocks in both directions."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def blocks_of(data: bytes, hot: np.ndarray | None = None, size: int = SIZE, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, start and length in bytes of the blocks of a text of ``size`` bytes or more."""
    raw = np.frombuffer(data, np.uint8)
    sums = byte_sums(raw)
    places = np.arange(len(raw) - anchor + 1)
    hashes = range_hashes(sums, places, places + anchor)
    least = _sliding_least(hashes, size - anchor + 1)
    # a pick ends with the last window that holds its first place, even if the same string follows
    start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1])]))
    end = np.concatenate([start[1:], [len(least)]])
    name = least[start]
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
        often = hot[at] == name
        if often.any():
            single = np.flatnonzero(np.repeat(often, end - start))
            own = range_hashes(sums, single, single + size)
            start, end, name = start[~often], end[~often], name[~often]
            content = range_hashes(sums, start, end - 1 + size)
            return (
                np.concatenate([name, mixed(own)]), np.concatenate([content, own]), np.concatenate([start, single]),
                np.concatenate([end - start + size - 1, np.full(len(single), size)]),
            )
    return name, range_hashes(sums, start, end - 1 + size), start, end - start + size - 1


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(*[c.alias(n) for c, n in zip(_columns(key, text), ("_doc", "_tag", "_text"), strict=True)])


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors with many different blocks, ascending: from every task's most frequent ones over all texts."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        held, size = [], 0

        def add() -> None:
            pairs = _distinct(np.concatenate(held, axis=1))
            names, n = np.unique(pairs[0], return_counts=True)
            for name, count in zip(names[n > 1].tolist(), n[n > 1].tolist(), strict=True):
                sums[name] = sums.get(name, 0) + count
            if len(sums) > 16 * REPORTED:
                top = sorted(sums.items(), key=lambda x: -x[1])[:REPORTED]
                sums.clear()
                sums.update(top)

        for batch in batches:
            for value in batch.column(0).to_pylist():
                data = (value or "").encode()
                if len(data) >= SIZE:
                    name, content, _, _ = blocks_of(data)
                    held.append(np.stack([name, content]))
                    size += len(name)
            if size >= HELD:
                add()
                held, size = [], 0
        if held:
            add()
        top = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:REPORTED]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([a for a, _ in top], np.uint64).view(np.int64)), pa.array([n for _, n in top], pa.int64())], ["anchor", "n"]
        )

    counts = docs.select("_text").mapInArrow(report, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= HOT_FROM).orderBy(F.desc("n"), "anchor").limit(HOT_MOST).select("anchor").toArrow()
    return np.sort(top.column("anchor").to_numpy().view(np.uint64))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    order = np.argsort(pairs[1], kind="stable")
    pairs = pairs[:, order]
    return pairs[:, np.concatenate([[True], pairs[1, 1:] != pairs[1, :-1]])]


BLOCK = "anchor long, content long, doc long, tag long, start long, length int"


def blocks(docs: DataFrame) -> DataFrame:
    """``BLOCK`` rows, one per content and batch of a task; rows without content are ranges already settled."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs))

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        name, content, start, length = (np.concatenate([h[i] for h in held]) for i in range(4))
        counts = [len(h[0]) for h in held]
        doc, tag = (np.repeat(np.array([h[i] for h in held], np.int64), counts) for i in (4, 5))
        known = np.repeat(np.array([h[6] for h in held], bool), counts)
        rank = np.where(known, doc, np.iinfo(np.int64).min)
        order = np.lexsort((start, tag, rank, known, content))
        first = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        keep, drop = order[first], order[~first]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(name[keep].view(np.int64)), pa.array(content[keep].view(np.int64)), pa.array(doc[keep], mask=~known[keep]),
                pa.array(tag[keep]), pa.array(start[keep]), pa.array(length[keep].astype(np.int32)),
            ],
            BLOCK_NAMES,
        )
        if len(drop):
            drop = drop[np.lexsort((start[drop], tag[drop], doc[drop], known[drop]))]
            d, t, k, s, e = doc[drop], tag[drop], known[drop], start[drop], start[drop] + length[drop]
            new = np.ones(len(drop), bool)
            new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (s[1:] > e[:-1])
            at = np.flatnonzero(new)
            reach = np.maximum.reduceat(e, at)
            spread = mixed(d[at].view(np.uint64) + s[at].astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(spread), pa.nulls(len(at), pa.int64()), pa.array(d[at], mask=~k[at]), pa.array(t[at]),
                    pa.array(s[at]), pa.array((reach - s[at]).astype(np.int32)),
                ],
                BLOCK_NAMES,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held, size, seen = shared.value, [], 0, set()
        for batch in batches:
            for doc, tag, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = (value or "").encode()
                if len(data) < SIZE or (doc, tag) in seen:
                    continue
                seen.add((doc, tag))
                held.append((*blocks_of(data, hot), doc if doc is not None else 0, tag, doc is not None))
                size += len(held[-1][0])
            if size >= HELD:
                yield from settle(held)
                held, size = [], 0
        if held:
            yield from settle(held)

    return docs.select("_doc", "_tag", "_text").mapInArrow(run, BLOCK)


BLOCK_NAMES = ["anchor", "content", "doc", "tag", "start", "length"]


def _place() -> Column:
    return F.struct("doc", "tag", "start")


def removed_ranges(docs: DataFrame) -> DataFrame:
    """Rows (doc, tag, start, end) of ranges to remove; they may overlap. ``docs`` as from ``_keyed``."""
    spark = docs.sparkSession
    anchor, content = Window.partitionBy("anchor"), Window.partitionBy("anchor", "content")
    rows = blocks(docs)
    rows = rows.withColumn("n", F.count("*").over(anchor)).where("n > 1 or content is null")
    rows = rows.withColumn("lo", F.min("content").over(anchor)).withColumn("hi", F.max("content").over(anchor))
    rows = rows.withColumn("first", F.min(_place()).over(content)).withColumn("is_first", F.col("first").eqNullSafe(_place()))
    # rows equal in key and text come once per task: they are one place
    live = written(
        rows.where("content is null or not is_first or lo <> hi").select(*BLOCK_NAMES, "is_first", (F.col("lo") != F.col("hi")).alias("varied")),
        "blocks", release=True,
    )
    settled = live.where("content is null or not is_first").select("doc", "tag", "start", (F.col("start") + F.col("length")).alias("end"))
    pieces = live.where("content is not null and is_first and varied").dropDuplicates(["anchor", "content"])
    held = pieces.agg(F.sum("length").alias("n")).first().n or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // BUCKET_BYTES)
    wanted = pieces.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "start", "length")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for doc, tag, value, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (doc, tag) in seen:
                    continue
                seen.add((doc, tag))
                data = value.encode()
                for p in places:
                    for column, x in zip(columns, (p["anchor"] % buckets, doc, tag, p["start"], data[p["start"] : p["start"] + p["length"]]), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "doc", "tag", "start", "piece"])

    def search(group: pa.Table) -> pa.Table:
        rows = sorted(
            {(d is not None, d or 0, t, s, p) for d, t, s, p in zip(*(group.column(n).to_pylist() for n in ("doc", "tag", "start", "piece")), strict=True)}
        )
        out: list[tuple] = []
        for (known, doc, tag, start, _), places in zip(rows, repeated_windows([r[4] for r in rows], SIZE), strict=True):
            if len(places):
                cuts = np.flatnonzero(np.diff(places) > SIZE) + 1
                for some in np.split(places, cuts):
                    out.append((doc if known else None, tag, start + int(some[0]), start + int(some[-1]) + SIZE))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc", "tag", "start", "end"), columns, strict=True)})

    joined = _with(docs, wanted).where("wanted is not null")
    texts = joined.select("_doc", "_tag", "_text", "wanted").mapInArrow(cut, "bucket long, doc long, tag long, start long, piece binary")
    matched = texts.groupBy("bucket").applyInArrow(search, "doc long, tag long, start long, end long")
    return settled.unionByName(matched)


def _with(docs: DataFrame, other: DataFrame) -> DataFrame:
    """``docs`` with the rows of ``other`` for the same document."""
    same = F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_tag") == F.col("tag"))
    return docs.join(other, same, "left").drop("doc", "tag")


RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` without its texts, with ``RESULTS`` and removed (spans in bytes).

    ``with_text`` adds the remaining text as kept_text; bytes of characters that were cut apart are left out.
    """
    integer_key(docs, key)
    own = [c for c in carried(docs.columns, (*RESULTS, "removed", "kept_text"), (key,)) if c != text]
    ranges = written(removed_ranges(_keyed(docs, key, text)), "ranges", release=True)
    spans = ranges.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    whole = docs.select(F.struct(*own).alias("_row"), *[c.alias(n) for c, n in zip(_columns(key, text), ("_doc", "_tag", "_text"), strict=True)])
    rows = _with(whole, spans)
    found = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: bigint, end: bigint>>, kept_text string"
    names = [*RESULTS, "removed", "kept_text"]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value, cuts in zip(batch.column("_text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data, spans_, at, parts = (value or "").encode(), [], 0, []
                for a, b in sorted((c["start"], c["end"]) for c in cuts or ()):
                    if spans_ and a <= spans_[-1]["end"]:
                        spans_[-1]["end"] = max(b, spans_[-1]["end"])
                    else:
                        spans_.append({"start": a, "end": b})
                for c in spans_:
                    parts.append(data[at : c["start"]])
                    at = c["end"]
                kept = b"".join([*parts, data[at:]])
                rest = kept.decode(errors="ignore") if with_text and value is not None else None
                out.append((len(data), len(data) - len(kept), len(spans_), hashlib.sha256(kept).hexdigest(), spans_, rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.string())
            results = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *results], ["_row", *names])

    schema = whole.select("_row").schema
    for field in docs.sparkSession.createDataFrame([], found).schema:
        schema = schema.add(field)
    done = rows.select("_row", "_text", "ranges").mapInArrow(cut, schema)
    return done.select(*[F.col("_row")[c].alias(c) for c in own], *(names if with_text else names[:-1]))


def reduced(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with the repeated bytes cut from their texts; n_chars, if there, follows."""
    own = docs.columns
    plain = docs.select(F.col(key).alias("_id"), F.col(text).alias("_body"), F.struct(*[c for c in own if c != text]).alias("_rest"))
    cut = deduplicated(plain, "_id", "_body", with_text=True).withColumn(text, F.col("kept_text"))
    values = {c: F.col("_rest")[c] for c in own if c != text} | {text: F.col(text)}
    if "n_chars" in own:
        values["n_chars"] = F.length(text).cast("long")
    return cut.select(*[values[c].alias(c) for c in own])


def _columns(key: str, text: str) -> tuple[Column, Column, Column]:
    return F.col(key).cast("long"), F.xxhash64(F.col(text)), F.col(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM d, range(0, octet_length(b) - 99) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
edged AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM later),
numbered AS (SELECT doc_id, i, sum((coalesce(gap, 1000) > 100)::int) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edged),
span AS (SELECT doc_id, g, min(i) AS s, max(i) + 100 AS e FROM numbered GROUP BY ALL),
kept AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS from_, false AS last FROM span),
parts AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (s - from_)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS k
  FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
  sha256(CASE WHEN n_spans > 0 THEN unhex(k) ELSE b END) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)"""
