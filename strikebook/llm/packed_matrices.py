"""Best-fit-decreasing packing, written as id matrices with cumulative segment lengths and position resets.

Each task gathers the token ids of its partition's documents in blocks of at most ``BLOCK_TOKENS`` tokens.
A block's pieces are placed longest first, each into the bin with the least free space that holds it; a
segment tree over free capacities, which counts the bins of each, finds it. Documents longer than the
capacity are cut without loss into full pieces and a rest. A sequence becomes a row of the written table:
``ids`` (capacity little-endian unsigned 16-bit ids, the rest filled with the end id), ``cu_seqlens`` (0,
then the end of each segment), ``position_resets`` (where positions start at 0 again: each segment, and the
filling) and ``segments`` (key, piece, start, length). Memory is bounded by the block.

Defined cases: a null text is empty and gives the end token alone. Repeated rows are packed each. A null
key stays null. An empty table writes no rows. Other columns are not carried. A task that runs again writes
the same rows, since sequence numbers come from its partition number.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strikebook.llm.pretokens import id_bytes, packed, worker_cache
from strikebook.llm.shared import table, written

CAPACITY, END_ID, BLOCK_TOKENS, ROWS_AT_ONCE = 4096, 50256, 8_000_000, 256


class CapacityTree:
    """Counts of bins by free capacity; finds the least capacity of at least a size in logarithmic time."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def least(self, size: int) -> int | None:
        node = size + self.leaves
        if self.count[node]:
            return size
        while node > 1 and (node & 1 or not self.count[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers; items of equal size keep their order."""
    tree, by_free, bins = CapacityTree(capacity), {}, []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        free = tree.least(sizes[item])
        if free is None:
            bins.append([item])
            number, left = len(bins) - 1, capacity - sizes[item]
        else:
            number, left = by_free[free].pop(), free - sizes[item]
            bins[number].append(item)
            tree.add(free, -1)
        if left:
            by_free.setdefault(left, []).append(number)
            tree.add(left, 1)
    return bins


def matrices(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID,
    capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """A row per sequence: sequence_id, ids, cu_seqlens, position_resets, segments."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[key].dataType
    end = end_id.to_bytes(2, "little")
    schema = pa.schema(
        [
            ("sequence_id", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
            ("position_resets", pa.list_(pa.int32())),
            ("segments", pa.list_(pa.struct([("key", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())]))),
        ]
    )

    def rows_of(block: list[tuple], first: int) -> Iterator[tuple]:
        for n, items in enumerate(best_fit_decreasing([len(x[3]) // 2 for x in block], capacity)):
            bounds = [0]
            for i in items:
                bounds.append(bounds[-1] + len(block[i][3]) // 2)
            ids = b"".join([block[i][3] for i in items])
            yield (
                first + n, ids + end * (capacity - bounds[-1]), bounds, bounds if bounds[-1] < capacity else bounds[:-1],
                [{"key": k, "piece": p, "start": s, "length": len(b) // 2} for k, p, s, b in (block[i] for i in items)],
            )

    def flush(block: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        for row in rows_of(block, first):
            some.append(row)
            if len(some) == ROWS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(path, "ids16", packed("H"))
        block, held, first = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = id_bytes(cache, value) + end
                for piece, at in enumerate(range(0, len(ids), 2 * capacity)):
                    part = ids[at : at + 2 * capacity]
                    block.append((k, piece, at // 2, part))
                    held += len(part) // 2
                    if held >= block_tokens:
                        yield from flush(block, first)
                        first += len(block)
                        block, held = [], 0
        yield from flush(block, first)

    struct = f"struct<key: {kind.simpleString()}, piece: int, start: bigint, length: int>"
    return docs.select(key, text).mapInArrow(
        run, f"sequence_id long, ids binary, cu_seqlens array<int>, position_resets array<int>, segments array<{struct}>"
    )


def segments(sequences: DataFrame) -> DataFrame:
    """A row per segment of a written table: key, piece, start, length, sequence_id, offset and the CRC-32 of its 16-bit ids."""
    each = sequences.select("sequence_id", "ids", "cu_seqlens", F.posexplode("segments").alias("n", "s"))
    offset = F.get("cu_seqlens", F.col("n"))
    return each.select(
        F.col("s.key").alias("key"), "s.piece", "s.start", F.col("s.length").cast("long").alias("length"), "sequence_id",
        offset.cast("long").alias("offset"),
        F.crc32(F.substring("ids", 2 * offset + 1, 2 * F.col("s.length"))).alias("ids_crc32"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices are written, then read back segment by segment."""
    docs = table(spark, sf_dir, "documents")
    return segments(written(matrices(docs), "matrices")).withColumnRenamed("key", "doc_id")
