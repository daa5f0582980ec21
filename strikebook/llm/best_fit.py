"""Bounded-space online best fit: texts become token sequences of a fixed capacity.

Each task packs the documents of its partition in their order. At most ``open_bins`` bins are open; one
integer serves as a bitset whose bit f says that an open bin has f tokens free. A piece goes into the open
bin with the least free space that holds it (shift and lowest set bit); without one, a new bin is opened,
and when too many are open, the fullest (the lowest set bit) closes first. Memory is bounded by the open
bins and the batch. Only documents longer than the capacity are cut, into full pieces and a rest.

Defined cases: a null text is empty and gives the end token alone. Repeated rows are packed each. A null
key stays null. An empty table gives no rows. Other columns are not carried.

The number of a sequence is the task's partition number times 2^33 plus a count, so a task that runs again
gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from strikebook.llm.pretokens import id_bytes, packed, worker_cache
from strikebook.llm.shared import table

CAPACITY, OPEN_BINS, END_ID = 4096, 512, 1


class OpenBins:
    """Open bins by free space."""

    def __init__(self, capacity: int, most: int, first: int) -> None:
        self.capacity, self.most, self.next = capacity, most, first
        self.bits, self.open = 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """Sequence number and offset for a piece."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.next, self.capacity
            self.next += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free


SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int | None = END_ID,
    capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
) -> DataFrame:
    """A row per piece: the key, then ``SCHEMA``."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[key].dataType.simpleString()
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(path, "ids", packed("I"))
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 33)
        for batch in batches:
            rows: list[tuple] = []
            origin: list[int] = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                ids = id_bytes(cache, value) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part), *bins.place(len(part) // 4)))
                    origin.append(i)
            if rows:
                keys = batch.column(0).take(pa.array(origin))
                kinds = (pa.int32(), *[pa.int64()] * 5)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [batch.schema.names[0], "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([keys, *columns], names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
