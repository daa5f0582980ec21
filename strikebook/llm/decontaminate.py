"""Benchmark decontamination with an FM-index per shard of documents.

A task cuts its partition into shards of at most ``SHARD_BYTES`` of text. Words become numbers by the
vocabulary of the test phrases; stretches that are too short to hold a phrase of known words, and unknown
words, become one separator, which no phrase contains. Over what is left the task builds the
Burrows-Wheeler transform, a wavelet matrix for its ranks, and a sample of suffix positions. All phrases go
through backward search together; occurrences are located by stepping to the next sampled position. The
places found are merged to removal spans per document.

Phrases are broadcast in blocks of at most ``BLOCK_BYTES`` of text; a larger benchmark is searched block by
block, each over all documents, with the spans so far carried along.

Defined cases: a null or empty text has no words, no hits and is not contaminated. An item without words
has no windows. An item with a null id marks words but is not listed. Items that share an id count once.
Repeated documents are judged one by one. Empty tables give no rows or no hits. Columns of the documents
with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikebook.llm.shared import carried, table, written
from strikebook.llm.suffixes import suffix_array

WINDOW, SHARD_BYTES, BLOCK_BYTES, SAMPLED = 13, 24 << 20, 4 << 20, 16
#: Bytes of a word in lower case, all others as blanks.
_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


class Bits:
    """A bit vector with ranks: packed words and the count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class FmIndex:
    """Backward search over integer text with ranks from a wavelet matrix and a sample of positions.

    The text ends in 0, which stands nowhere else.
    """

    def __init__(self, text: np.ndarray, sampled: int = SAMPLED) -> None:
        sa = suffix_array(text)
        self.n = len(text)
        last = text[sa - 1]  # the symbol before each suffix; cyclic at the start
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)
        self.depth = max(1, int(text.max()).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bits = ((last >> level) & 1).astype(np.uint8)
            vector = Bits(bits)
            zeros = self.n - int(vector.before[-1])
            self.levels.append((vector, zeros))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        marked = (sa % sampled == 0).astype(np.uint8)
        self.marked, self.positions = Bits(marked), sa[marked == 1]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        lo, hi = np.zeros_like(at), at
        for i, (vector, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - i)) & 1 == 1
            a, b = vector.ones(lo), vector.ones(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def step(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one symbol earlier."""
        symbol, lo, hi = np.zeros_like(at), np.zeros_like(at), at
        for vector, zeros in self.levels:
            one = vector.get(hi) == 1
            a, b = vector.ones(lo), vector.ones(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
            symbol = 2 * symbol + one
        return self.begin[symbol] + hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows for each row of ``phrases`` (equal lengths)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for symbol in phrases.T[::-1]:
            known = np.minimum(symbol, len(self.begin) - 2)
            live = (symbol == known) & (lo < hi)
            lo = np.where(live, self.begin[known] + self.rank(known, lo), 0)
            hi = np.where(live, self.begin[known] + self.rank(known, hi), 0)
        return lo, hi - lo

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        rows, at, steps = rows.copy(), np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.marked.get(here) == 1
            found = open_[done]
            at[found] = self.positions[self.marked.ones(here[done])] + steps[found]
            open_ = open_[~done]
            rows[open_] = self.step(rows[open_])
            steps[open_] += 1
        return at


class Phrases:
    """Separators are 1, words count from 2. The windows of a block of items, by length, and which items each belongs to."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for size in sorted({len(p) for p in owners}):
            some = [p for p in owners if len(p) == size]
            self.by_length[size] = (np.array(some, np.int64), [sorted(x for x in owners[p] if x is not None) for p in some])
        self.shortest = min(self.by_length, default=0)


def shard_hits(texts: list[list[bytes]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Per document the places [start, end) of phrases, in words, and the items found."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not phrases.shortest:
        return spans, items
    get, pieces, owner, origin, at = phrases.vocabulary.get, [], [], [], 0
    for d, words in enumerate(texts):
        if len(words) < phrases.shortest:
            continue
        ids = np.array([get(w, 1) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 1).view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= phrases.shortest:
                pieces += [ids[a:b], np.ones(1, np.int64)]
                owner.append(d)
                origin.append((at, a))
                at += b - a + 1
    if not pieces:
        return spans, items
    index = FmIndex(np.concatenate([*pieces, np.zeros(1, np.int64)]))
    starts, owner, shift = np.array([x for x, _ in origin]), np.array(owner), np.array([a for _, a in origin])
    for size, (patterns, ids_of) in phrases.by_length.items():
        first, count = index.search(patterns)
        which = np.repeat(np.arange(len(patterns)), count)
        if not len(which):
            continue
        rows = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which))
        places = index.locate(rows)
        piece = np.searchsorted(starts, places, side="right") - 1
        word = places - starts[piece] + shift[piece]
        for d, w, p in zip(owner[piece].tolist(), word.tolist(), which.tolist(), strict=True):
            spans[d].append((w, w + size))
            items[d].update(ids_of[p])
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap."""
    joined: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


FOUND = "_n_words long, _spans array<struct<start: int, end: int>>, _items array<string>"


def _search(docs: DataFrame, text: str, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    """One block of items against all documents; ``docs`` may hold what earlier blocks found."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    fresh = "_spans" not in docs.columns
    own = [c for c in docs.columns if c not in ("_n_words", "_spans", "_items")]
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)

        def flush(held: list[pa.RecordBatch], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            spans, items_ = shard_hits(texts, phrases)
            at = 0
            for batch in held:
                end = at + batch.num_rows
                s, t = spans[at:end], items_[at:end]
                if not fresh:
                    s = [x + [(y["start"], y["end"]) for y in old] for x, old in zip(s, batch.column("_spans").to_pylist(), strict=True)]
                    t = [x | set(old) for x, old in zip(t, batch.column("_items").to_pylist(), strict=True)]
                found = [
                    pa.array([len(w) for w in texts[at:end]], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in merged(x)] for x in s], spans_type),
                    pa.array([sorted(x) for x in t], pa.list_(pa.string())),
                ]
                kept = [batch.column(c) for c in own]
                yield pa.RecordBatch.from_arrays([*kept, *found], [*own, "_n_words", "_spans", "_items"])
                at = end

        held, texts, size = [], [], 0
        for batch in batches:
            held.append(batch)
            for value in batch.column(text).to_pylist():
                texts.append(words_of(value))
                size += len(value or "")
            if size >= SHARD_BYTES:
                yield from flush(held, texts)
                held, texts, size = [], [], 0
        yield from flush(held, texts)

    schema = docs.select(*own).schema
    for field in docs.sparkSession.createDataFrame([], FOUND).schema:
        schema = schema.add(field)
    return docs.mapInArrow(run, schema)


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """Items (id as text, text) in blocks of bounded size; one partition at a time comes to the driver."""
    block, size = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        if block and size + len(row.t) > most:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    yield block


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")


def annotated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``RESULTS``: counts, the verdict, merged spans in words, and the item ids found."""
    own = carried(docs.columns, RESULTS, (text,))
    df = docs.select(F.struct(*own).alias("_row"), F.col(text).alias("_text"))
    for n, block in enumerate(blocks(benchmark, item, item_text, block_bytes)):
        df = _search(written(df, "decontaminate") if n else df, "_text", block, window)
    hit = F.aggregate("_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long")
    df = df.withColumn("n_hit", hit)
    return df.select(
        *[F.col("_row")[c].alias(c) for c in own], F.col("_n_words").alias("n_words"), "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("_n_words"))).alias("contaminated"),
        F.col("_spans").alias("spans"), F.col("_items").alias("items"),
    )


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text"))
    return annotated(whole, benchmark).where(~F.col("contaminated")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotated(docs, table(spark, sf_dir, "benchmark")).drop("text", "spans", "items")


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM b, range(1, len(w) - least(13, len(w)) + 2) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM phrase),
place AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM d, sizes, range(1, len(w) - n + 2) AS t(i)),
hit AS (SELECT doc_id, place.n, i, item_id FROM place JOIN phrase USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM hit), range(0, 13) AS t(k) WHERE k < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
