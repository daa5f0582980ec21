"""Ranked lexical search of many items at once, with common subexpressions evaluated once.

1. *Terms.* The terms of a block of items become a sorted table of 64-bit hashes, which is broadcast. One pass
   over the texts writes a thin row per document: its number of terms and, for terms of the block, how often
   each occurs. N, L and the document frequencies are aggregates of these rows.
2. *Shared sets.* Terms that stand in exactly the same items form one set, so each document has one partial
   accumulator per set. Items become sequences of sets, the most shared first. The pair of neighbours that most items have is
   replaced by a new node until no pair is left in two items; nodes are sums of two earlier ones. This is
   the query-sharing graph: every node is computed once per document, whatever number of items use it.
3. *Scores.* A task fills the accumulators of a slice of documents, adds up the nodes level by level, and
   each item sums the few nodes left in its sequence. The task keeps the ``k`` best documents of each item;
   only these are shuffled, and ranked in two steps so that no item's rows meet in one task unreduced.

Memory: a block holds at most ``BLOCK_TERMS`` pairs of item and term (an item with more is a block of its own)
and a slice at most ``SLICE_CELLS`` accumulators. Each block reads the texts once.

Defined cases: null and empty texts have no terms, are not counted in N and never listed. Items without terms
have no rows. Items that repeat an id are ranked one by one. Rows without a key come last among equal scores.
Repeated documents are ranked one by one, in any order among themselves. Empty tables give no rows. Other columns are not
read. Keys are integers. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikebook.llm.decontaminate import words_of
from strikebook.llm.decontaminate import _BYTES as LOWER_WORDS
from strikebook.llm.shared import integer_key, table, written
from strikebook.llm.shingles import word_hashes

TOP, BLOCK_TERMS, SLICE_CELLS, CHUNK_BYTES, SALTS = 50, 1 << 16, 1 << 22, 1 << 20, 32
LAST = np.iinfo(np.int64).max


class Plan:
    """A block of items: hashed terms, the set each term belongs to, and the graph that combines sets."""

    def __init__(self, items: list[set[bytes]]) -> None:
        holders: dict[bytes, list[int]] = {}
        for i, terms in enumerate(items):
            for term in terms:
                holders.setdefault(term, []).append(i)
        terms = sorted(holders)
        hashes = word_hashes(b" ".join(terms))[1]
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        sets: dict[tuple[int, ...], int] = {}
        for term in terms:
            sets.setdefault(tuple(holders[term]), len(sets))
        self.set_of = np.array([sets[tuple(holders[term])] for term in terms], np.int64)[order]
        self.n_sets = len(sets)
        mine: list[list[int]] = [[] for _ in items]
        for held, number in sorted(sets.items(), key=lambda x: (-len(x[0]), x[0])):
            for i in held:
                mine[i].append(number)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_nodes = self.n_sets
        while pairs := self._shared_pairs(mine):
            self.levels.append(self._replace(mine, pairs))
        self.items = [np.array(x, np.int64) for x in mine]

    @staticmethod
    def _shared_pairs(mine: list[list[int]]) -> set[tuple[int, int]]:
        """Neighbours that two items or more have, chosen so that no two of them compete for a node."""
        found = Counter(pair for nodes in mine for pair in zip(nodes[:-1], nodes[1:], strict=True))
        taken: set[int] = set()
        chosen = set()
        for pair, n in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            if n > 1 and not taken.intersection(pair):
                chosen.add(pair)
                taken.update(pair)
        return chosen

    def _replace(self, mine: list[list[int]], pairs: set[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        names = {pair: self.n_nodes + i for i, pair in enumerate(sorted(pairs))}
        self.n_nodes += len(names)
        for i, nodes in enumerate(mine):
            out, at = [], 0
            while at < len(nodes):
                name = names.get(tuple(nodes[at : at + 2]))
                out.append(nodes[at] if name is None else name)
                at += 1 if name is None else 2
            mine[i] = out
        left, right = zip(*sorted(pairs), strict=True)
        return np.array(left, np.int64), np.array(right, np.int64)

    def scores(self, accumulated: np.ndarray) -> Iterator[np.ndarray]:
        """Scores of each item, a row per set and a column per document coming in; rows of nodes are filled in place."""
        at = self.n_sets
        for left, right in self.levels:
            accumulated[at : at + len(left)] = accumulated[left] + accumulated[right]
            at += len(left)
        for nodes in self.items:
            yield accumulated[nodes].sum(axis=0)


def counted(docs: DataFrame, key: str, text: str, plan: Plan) -> DataFrame:
    """A row per text: key, n (terms with repeats), at (places of terms in the block's table) and tf."""
    shared = docs.sparkSession.sparkContext.broadcast(plan.hashes)

    def chunk(keys: list, texts: list[bytes]) -> pa.RecordBatch:
        hashes = shared.value
        starts, words = word_hashes(b" ".join(texts))
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]))
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        at = np.minimum(np.searchsorted(hashes, words), max(len(hashes) - 1, 0))
        known = hashes[at] == words if len(hashes) else np.zeros(len(words), bool)
        cells, tf = np.unique(doc[known] * max(len(hashes), 1) + at[known], return_counts=True)
        owner, term = np.divmod(cells, max(len(hashes), 1))
        ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.diff(bounds), pa.int64()), *lists], ["key", "n", "at", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                texts.append((value.as_py() or "").encode().translate(LOWER_WORDS))
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield chunk(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield chunk(keys, texts)

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "key long, n long, at array<int>, tf array<int>")


def weights(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each term of the block."""
    n, total = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[held.column("at").to_numpy()] = held.column("df").to_numpy()
    return n, total, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class Best:
    """The best documents of one item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        better = scores >= self.least
        if better.any():
            scores, keys = np.concatenate([self.scores, scores[better]]), np.concatenate([self.keys, keys[better]])
            order = np.lexsort((keys, -scores))[: self.k]
            self.scores, self.keys = scores[order], keys[order]
            if len(order) == self.k:
                self.least = int(self.scores[-1])


def best(rows: DataFrame, plan: Plan, n: int, total: int, weight: np.ndarray, k: int) -> DataFrame:
    """Of each task the ``k`` best documents of each item: item (its place in the block), key, score."""
    shared = rows.sparkSession.sparkContext.broadcast((plan, weight))
    width = max(16, SLICE_CELLS // max(plan.n_nodes, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = shared.value
        found = [Best(k) for _ in plan.items]
        for whole in batches:
            for start in range(0, whole.num_rows, width):
                batch = whole.slice(start, width)
                length = batch.column("n").to_numpy()
                held = batch.column("at")
                doc = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
                term, tf = held.flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.int64)
                m = 50 + 50 * length * n // total if total else length
                cells = np.zeros((plan.n_nodes, batch.num_rows), np.int64)
                np.add.at(cells, (plan.set_of[term], doc), weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])))
                keys = batch.column("key").fill_null(LAST).to_numpy()
                for one, scores in zip(found, plan.scores(cells), strict=True):
                    one.add(scores, keys)
        for i, one in enumerate(found):
            if len(one.keys):
                key = pa.array(one.keys, mask=one.keys == LAST)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one.keys), i, np.int32)), key, pa.array(one.scores)], ["item", "key", "score"])

    return rows.where("size(at) > 0").mapInArrow(run, "item int, key long, score long")


def blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[object, set[bytes]]]]:
    """Items (id, terms) in blocks of bounded size; one partition at a time comes to the driver."""
    block, size = [], 0
    for row in items.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        terms = set(words_of(row.t))
        if block and size + len(terms) > most:
            yield block
            block, size = [], 0
        if terms:
            block.append((row.i, terms))
            size += len(terms)
    if block:
        yield block


def ranked(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    k: int = TOP, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """For each item its ``k`` best documents: item, rank, key, score."""
    integer_key(docs, key)
    spark = docs.sparkSession
    names = items.select(F.lit(0).alias("item"), F.col(item).alias("name")).schema
    out = None
    for block in blocks(items, item, item_text, block_terms):
        plan = Plan([terms for _, terms in block])
        rows = written(counted(docs, key, text, plan), "term-counts")
        found = best(rows, plan, *weights(rows, len(plan.hashes)), k)
        order = [F.desc("score"), F.col("key").asc_nulls_last()]
        some = Window.partitionBy("item", F.pmod(F.xxhash64("key", F.spark_partition_id()), F.lit(SALTS))).orderBy(*order)
        few = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
        last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], names)
        rows = last.join(F.broadcast(ids), "item").select("name", "rank", "key", "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "item int, key long, score long").join(spark.createDataFrame([], names), "item")
        out = out.select("name", F.lit(1).alias("rank"), "key", "score")
    return out.select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
whole AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_all FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
item AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark)),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint AS w FROM df, whole),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_all::bigint)))))::bigint AS score
  FROM item JOIN weight USING (t) JOIN tf USING (t), whole GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank FROM scored WHERE score > 0) WHERE rank <= 50"""
