"""Similarity join of texts on sets of five-word shingles: prefix filtering with rare shingles first.

1. *Order.* Every task sends the shingles of its texts, in sorted blocks by hash range; each range counts
   its shingles. The ``HOT`` most frequent ones, at most, are broadcast with their counts. Sets are ordered
   by that count (0 for all others), then by hash. The order decides only how much work there is.
2. *Prefixes.* Two sets of Jaccard similarity t share one of the first n - ceil(t n) + 1 shingles of each.
   Texts with equal sets form a class, sent once per task. Shingles that only one class has in a prefix
   are dropped.
3. *Leaders.* In each shingle's group one class leads: first the one for which it stands earliest, in later rounds
   any. Each class is compared with the leader it shares most with, and the components of all
   links so far are taken. That connects large groups of near copies without pairs between their members; shingles whose
   classes are all in one component are done. Rounds end when one links nothing.
4. *Pairs.* What is left is joined on the shingle under the length, the positional and the suffix filter, between different
   components only, and counted per pair. The suffix filter bounds the Hamming distance of whole sets
   from below by the segments of the hash space in which one has an odd and the other an even number of shingles. Each
   pair, with a leader or not, is verified once, on whole sets, which only classes in pairs that pass the suffix filter get.
5. Components of the links give the result; copies follow their class.

Defined cases: texts without words, and null texts, have an empty set and are linked with nothing. Fewer
than five words are one shingle. A null key is no key: such a row has a null component unless a row with an
equal set has a key, and ``keep_one`` keeps it. Repeated rows are one class. Empty tables give no rows. Other columns are not carried. Shingles
are 64-bit hashes and classes are named by the first 64 bits of a digest of the set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikebook.llm.components import components
from strikebook.llm.shared import table, written
from strikebook.llm.shingles import shingle_sets

PERCENT, HOT, HOT_FROM = 80, 1 << 18, 8
#: Shingles that a task holds for counting, and sends at once.
FLUSH, SENT = 2_000_000, 1 << 18
#: Rounds of leaders before pairs; segments of the hash space that the suffix filter compares.
ROUNDS, SEGMENTS = 3, 1024


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _block(heads: np.ndarray) -> pa.RecordBatch:
    """A row per range: the distinct heads of an ascending run and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    counts = np.minimum(np.diff(first, append=len(heads)), 65535).astype(np.uint16)
    heads = heads[first]
    low = heads.astype(np.uint32)
    which, first = np.unique((heads >> np.uint64(32)).astype(np.int32), return_index=True)
    bounds = [*first.tolist(), len(low)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(which, pa.int32()),
            pa.array([low[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
        ],
        ["bucket", "low", "n"],
    )


def _flushed(shingles: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The heads are taken and sorted in place and sent some whole ranges at a time."""
    shingles >>= np.uint64(32 - bits)
    shingles.sort()
    at = 0
    while at < len(shingles):
        last = int(shingles[min(at + SENT, len(shingles)) - 1]) >> 32
        end = int(np.searchsorted(shingles, np.uint64((last + 1) << 32)))
        yield _block(shingles[at:end])
        at = end


def shingle_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """How often shingles occur in the distinct sets of texts: sorted blocks by range, from one buffer of ``FLUSH`` shingles."""
    held, size, seen = np.empty(FLUSH, np.uint64), 0, set()
    for batch in batches:
        for shingles in shingle_sets(batch.column(0).to_pylist()):
            if not len(shingles) or (name := class_of(shingles)) in seen:
                continue
            seen.add(name)
            if size + len(shingles) > FLUSH:
                yield from _flushed(held[:size], bits)
                size = 0
            if len(shingles) > FLUSH:
                yield from _flushed(shingles, bits)
            else:
                held[size : size + len(shingles)] = shingles
                size += len(shingles)
    yield from _flushed(held[:size], bits)


def frequent_shingles(docs: DataFrame, text: str, most: int = HOT) -> tuple[np.ndarray, np.ndarray, int]:
    """The hash heads of the most frequent shingles, ascending, their counts over the tasks' classes, and the bits of a range."""
    spark = docs.sparkSession
    bits = max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def count(key: tuple, group: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(x.as_py() for x in group.column("low")), np.uint32)
        n = np.frombuffer(b"".join(x.as_py() for x in group.column("n")), np.uint16)
        order = np.argsort(low)
        low, n = low[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        sums = np.add.reduceat(n, first)
        hot = sums >= HOT_FROM
        heads = low[first[hot]].astype(np.int64) + (int(key[0].as_py()) << 32)
        return pa.table({"head": pa.array(heads, pa.int64()), "n": pa.array(sums[hot], pa.int64())})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shingle_blocks(batches, bits)

    sent = docs.select(text).mapInArrow(send, "bucket int, low binary, n binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "head long, n long")
    top = counted.orderBy(F.desc("n"), "head").limit(most).toArrow()
    heads, counts = top.column("head").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(heads)
    return heads[order], counts[order], bits


def ordered(shingles: np.ndarray, heads: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """A set with rare shingles first; ties by hash."""
    if not len(heads):
        return shingles
    own = shingles >> np.uint64(32 - bits)
    at = np.minimum(np.searchsorted(heads, own), len(heads) - 1)
    n = np.where(heads[at] == own, counts[at], 0)
    return shingles[np.argsort(n, kind="stable")] if n.any() else shingles


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of ``SEGMENTS`` segments of the hash space, whether it holds an odd number of a set's shingles, as words."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (SEGMENTS - 1), minlength=SEGMENTS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefixes(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """A row per text: key, n, class (null when empty) and, once per class and task, its prefix and sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text))
    kind = docs.schema[key].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, counts, bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            sizes, names, firsts, sketches = [], [], [], []
            for shingles in shingle_sets(batch.column(1).to_pylist()):
                n = len(shingles)
                name = class_of(shingles) if n else None
                sizes.append(n)
                names.append(name)
                first = n > 0 and name not in seen
                if first:
                    seen.add(name)
                firsts.append(ordered(shingles, heads, counts, bits)[: prefix_length(n, percent)].view(np.int64) if first else None)
                sketches.append(sketch(shingles) if first else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(firsts, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n", "class", "prefix", "sketch"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, n long, class long, prefix array<long>, sketch array<long>")


def _long_enough(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Common shingles that sets of sizes a and b need."""
    return F.ceil(percent * (a + b) / (100 + percent))


def _near_enough(a: str, b: str, n: Column, m: Column, percent: int) -> Column:
    """The suffix filter: segments that differ are at least that many shingles which only one of both sets has."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SEGMENTS // 64)), F.lit(0))
    return differ + 2 * _needed(n, m, percent) <= n + m


def sets_of(classes: DataFrame, docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """The whole sets (node, shingles) of ``classes``. Only one text of each is needed."""
    wanted = written(members.join(classes, "class", "left_semi").groupBy("class").agg(F.min("key").alias("_key")), "wanted", release=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([class_of(x) if len(x) else None for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                ["_wanted", "node", "shingles"],
            )

    texts = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).join(wanted, F.col("_doc") == F.col("_key"))
    # a key that occurs twice gives a set twice, and at worst a link twice
    sets = texts.select("class", "_text").mapInArrow(run, "_wanted long, node long, shingles binary")
    return written(sets.where("node = _wanted").select("node", "shingles"), "sets", release=True)


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Of written pairs of classes (u, v) those whose sets are similar enough.

    Few classes are the v of many pairs: the set of each u travels to that of its v, where a hot v is split.
    """
    nodes = pairs.select(F.col("u").alias("class")).union(pairs.select(F.col("v").alias("class"))).distinct()
    sets = sets_of(nodes, docs, members, key, text)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (a, b))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                similar.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(similar, pa.bool_()))

    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")).join(pairs, "u")
    second = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")).join(pairs.select("v"), "v", "left_semi")
    two = one.join(second, "v")
    return written(two.select("u", "v", "su", "sv").mapInArrow(compare, "u long, v long"), "links", release=True)


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """Prefix shingles that two classes or more have, a row per class: shingle, class, n, at, component."""
    each = rows.where("prefix is not null").select("class", "n", F.posexplode("prefix").alias("at", "shingle"))
    ends = each.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    shared = written(ends.select("shingle"), "shared", release=True)
    # a class has copies of its rows from every task that met it
    live = each.join(shared, "shingle", "left_semi").dropDuplicates(["shingle", "class"])
    return written(live.withColumn("component", F.col("class")), "live", release=True)


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Members (key, n, class) and links (u, v) between classes; links connect just what is connected."""
    rows = written(prefixes(docs, key, text, percent), "prefixes", release=True)
    members = rows.select("key", "n", "class")
    sketches = rows.where("sketch is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    live = shared_prefixes(rows)
    sketches = written(sketches.join(live.select("class").distinct(), "class", "left_semi"), "sketches", release=True)
    found = tried = docs.sparkSession.createDataFrame([], "u long, v long")
    for turn in range(ROUNDS):
        pairs = written(_close(_untried(_with_leaders(live, turn, percent), tried), sketches, percent), "pairs", release=True)
        new = verified(pairs, docs, members, key, text, percent)
        found, tried = found.unionByName(new), tried.unionByName(pairs)
        if new.isEmpty():
            break
        live = _unconnected(live, components(found))
    pairs = written(_untried(_remaining(live, sketches.select("class", "sketch"), percent), tried), "pairs", release=True)
    return members, found.unionByName(verified(pairs, docs, members, key, text, percent))


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the suffix filter."""
    u, v = (sketches.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"of_{x}")) for x in "uv")
    met = pairs.join(u, "u").join(v, "v")
    return met.where(_near_enough("of_u", "of_v", F.col("n_u"), F.col("n_v"), percent)).select("u", "v")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs that no earlier round has verified, whichever class led."""
    before = tried.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
    return pairs.join(before, (F.least("u", "v") == F.col("x")) & (F.greatest("u", "v") == F.col("y")), "left_anti")


def _with_leaders(live: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each class (u) and the leader (v), in another component, that it shares most prefix shingles with.

    In the first round the class for which a shingle stands earliest leads it, later any one.
    """
    first = F.col("at") if turn == 0 else F.xxhash64("class", F.lit(turn))
    lead = live.groupBy("shingle").agg(F.min(F.struct(first.alias("x"), "n", "class", "component")).alias("l"))
    apart = (F.col("component") != F.col("l.component")) & _long_enough(F.col("n"), F.col("l.n"), percent)
    shared = live.join(lead, "shingle").where(apart).groupBy("class", F.col("l.class").alias("leader")).agg(F.count("*").alias("c"))
    best = shared.groupBy("class").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader"))
    # two classes that lead each other are one pair
    pairs = best.select(F.col("class").alias("u"), F.col("leader").alias("v"))
    each = pairs.groupBy(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).agg(F.min("v").alias("v"))
    return each.select(F.when(F.col("v") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("u"), "v")


def _unconnected(live: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of shingles whose classes are not all in one component."""
    own = live.drop("component").join(joined, live["class"] == joined["node"], "left").drop("node")
    own = own.withColumn("component", F.coalesce("component", "class"))
    mixed = own.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return written(own.join(mixed.select("shingle"), "shingle", "left_semi"), "live", release=True)


def _remaining(live: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of unconnected classes that pass the length, positional and suffix filters.

    What two unconnected classes share in both prefixes is left in ``live``; what stands in the prefix of
    one and behind that of the other need not be. Before a live shingle of both they share live ones only.
    From it on they share at most the rest of each set, and at most the live ones of each prefix plus all
    behind the prefix that ends first in the order.
    """
    own = Window.partitionBy("class")
    live = live.withColumn("before", F.row_number().over(own.orderBy("at")) - 1)
    live = live.withColumn("after", F.count("*").over(own) - F.col("before")).withColumn("rest", F.col("n") - F.col("at"))
    live = written(live.join(sketches, "class"), "live")
    a, b = live.alias("a"), live.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    tails = F.greatest(n - _prefix(n, percent), m - _prefix(m, percent))
    from_here = F.least(F.col("a.rest"), F.col("b.rest"), F.least("a.after", "b.after") + tails)
    met = a.join(
        b,
        (F.col("a.shingle") == F.col("b.shingle"))
        & (F.col("a.class") < F.col("b.class"))
        & (F.col("a.component") != F.col("b.component"))
        & _long_enough(n, m, percent)
        & (F.least("a.before", "b.before") + from_here >= _needed(n, m, percent))
        & _near_enough("a.sketch", "b.sketch", n, m, percent),
    )
    pair = met.groupBy(F.col("a.class").alias("u"), F.col("b.class").alias("v")).agg(
        F.count("*").alias("c"), F.first("a.n").alias("n"), F.first("b.n").alias("m")
    )
    # of the set whose prefix ends first, only the rest can hold further common shingles
    tail = F.greatest(F.col("n") - _prefix(F.col("n"), percent), F.col("m") - _prefix(F.col("m"), percent))
    return pair.where(F.col("c") + tail >= _needed(F.col("n"), F.col("m"), percent)).select("u", "v")


def _prefix(n: Column, percent: int) -> Column:
    return n - F.ceil(percent * n / 100) + 1


def grouped(docs: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """A row per text: key, n, class, component_id and the class that stays (the least one with that key)."""
    members, found = links(docs, key, text, percent)
    groups = components(found)
    classes = members.where("class is not null").groupBy("class").agg(F.min("key").alias("least"))
    each = classes.join(groups, classes["class"] == groups["node"], "left").withColumn("component", F.coalesce("component", "class"))
    # null keys come last
    first = F.struct(F.col("least").isNull().alias("none"), "least", "class")
    least = each.groupBy("component").agg(F.min(first).alias("first"))
    own = (F.col("class").alias("of"), F.col("first.least").alias("component_id"), F.col("first.class").alias("stays"))
    of_class = written(each.join(least, "component").select(*own), "class-components")
    rows = members.join(of_class, F.col("class") == F.col("of"), "left")
    component = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return rows.select("key", "n", "class", component.alias("component_id"), "stays")


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row per text: key, n_shingles, component_id (the least key reachable by links)."""
    rows = grouped(docs, key, text, percent)
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: the one with the least key. Rows without a key or words stay.

    Where rows share the least key, those of the least class do, and of these the one with the least text.
    Only rows whose keys repeat are told apart by their sets and shuffled for it.
    """
    rows = grouped(docs.where(F.col(key).isNotNull()), key, text)
    out = F.col("class").isNotNull() & ((F.col("key") != F.col("component_id")) | (F.col("class") != F.col("stays")))
    marked = rows.select("key", "class", out.alias("out"))
    by_key = marked.groupBy(F.col("key").alias("_drop")).agg(F.count("*").alias("n"), F.max("out").alias("out"))
    keys = written(by_key.where("n > 1 or out"), "near-duplicates")
    alone = docs.join(keys, docs[key] == keys["_drop"], "left_anti")
    twice = keys.where("n > 1").select("_drop")
    kept = marked.join(twice, F.col("key") == F.col("_drop"), "left_semi").where("class is not null and not out")
    kept = written(kept.select("key", "class").distinct(), "repeated-keys")
    again = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct(*docs.columns).alias("_row"))
    again = again.join(twice, F.col("_key") == F.col("_drop"), "left_semi")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [class_of(x) if len(x) else None for x in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], ["_key", "_text", "_row", "_class"])

    again = again.mapInArrow(classes, again.select("*").schema.add("_class", "long"))
    own = again.join(kept, (F.col("_key") == F.col("key")) & (F.col("_class") == F.col("class")), "left_semi")
    order = F.struct("_text", F.to_json("_row"))
    one = own.groupBy("_key", "_class").agg(F.min_by("_row", order).alias("_row"))
    back = one.select("_row").union(again.where("_class is null").select("_row"))
    return alone.unionByName(back.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM words, range(1, greatest(len(w) - 3, 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT reach.doc_id, link.v FROM reach JOIN link ON link.u = reach.other)
SELECT doc_id, coalesce(max(n), 0)::bigint AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""
