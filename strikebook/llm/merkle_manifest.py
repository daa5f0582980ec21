"""A Merkle manifest of a dataset: places of leaves by ranks in bitmaps, trees reduced over keyed slot arrays.

1. *Leaves.* Every row's digest is written once as a thin row (tree, key, leaf). A tree is a group, here a language.
2. *Bitmaps.* The keys of a tree fall into containers of 65,536. Each task sends its keys as compressed containers
   (sorted 16-bit offsets, or a bit field where over 4,096 are set); those of one container are merged, and a popcount
   directory is kept before every 64 bits. Running sums over containers, taken in ranges of equal size,
   give how many leaves come before each.
3. *Ranks.* Leaves meet their container, and a rank query gives each its place in the tree. No leaf is sorted.
4. *Levels.* ``BLOCK`` consecutive places share a slot array, keyed by tree and block; a task reduces it by three
   levels of ``FAN`` and sends one digest on. Trees of any size take a logarithm of such steps. Subroots,
   ordered by tree, are reduced the same way.
5. *Proofs.* Going down again, every block gets the siblings above it; leaves get their whole path, which is
   hashed and folded in the task that holds the block.

Defined cases: a null value is ``-``; a null group is a tree of its own, first in order. Rows that share group and key
have places one after the other, ascending by leaf; rows without a key come after all others of their tree, ascending by
leaf. Such rows are numbered in ranges that split hot keys. A null key is not tampered with. An empty table
gives no rows. Columns not named are not read. Keys are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikebook.llm.decontaminate import Bits
from strikebook.llm.shared import integer_key, table, written

FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
CONTAINER_BITS = 16
CONTAINER = 1 << CONTAINER_BITS
#: Keys in a container up to which offsets are smaller than the bit field.
SPARSE = CONTAINER // 16
#: Keys a task holds before it sends its containers.
HELD = 2_000_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def written_value(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[written_value(v) for v in values]), 256)


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, key: str, group: str, text: str, columns: tuple[str, ...]) -> DataFrame:
    """Thin rows: tree (ordered as the groups are), key, leaf, and the leaf of the tampered row where there is one."""
    here = F.crc32(F.col(key).cast("string")) % 3 == 0
    changed = [tampered(F.col(c)) if c == text else F.col(c) for c in columns]
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).cast("long").alias("key"),
        leaf_of([F.col(c) for c in columns]).alias("leaf"),
        F.when(here, leaf_of(changed)).alias("changed"),
    )


def sums_before(df: DataFrame, keys: list[str], order: list[str], amount: Column, out: str) -> DataFrame:
    """The sum of ``amount`` over earlier rows of ``keys``; ``order`` must tell rows apart.

    Rows are dealt by ranges of (keys, order), so a hot key is split; per key only one row for each range is
    summed in one task.
    """
    ranged = df.withColumn("_amount", amount).repartitionByRange(*keys, *order)
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    each = ranged.withColumn("_inside", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    each = each.join(totals, [*keys, "_range"])
    return each.withColumn(out, F.col("_before") + F.col("_inside")).drop("_amount", "_range", "_before", "_inside")


def packed(offsets: np.ndarray) -> tuple[bool, bytes]:
    """Ascending distinct offsets as a compressed container."""
    if len(offsets) <= SPARSE:
        return False, offsets.astype(np.uint16).tobytes()
    bits = np.zeros(CONTAINER, np.uint8)
    bits[offsets] = 1
    return True, np.packbits(bits, bitorder="little").tobytes()


def unpacked(dense: bool, data: bytes) -> np.ndarray:
    if not dense:
        return np.frombuffer(data, np.uint16).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def containers(thin: DataFrame) -> DataFrame:
    """A row per tree and container: its keys compressed, offsets that occur again, and how many rows it stands for."""
    fields = "tree string, high long, dense boolean, bits binary, again binary, more binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for tree, parts in held.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                high = keys >> CONTAINER_BITS
                first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
                rows = []
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
                    offsets, more = keys[a:b] & (CONTAINER - 1), counts[a:b] - 1
                    dense, data = packed(offsets)
                    rows.append((int(high[a]), dense, data, offsets[more > 0].astype(np.uint16).tobytes(), more[more > 0].tobytes()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * len(rows)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()),
                        *[pa.array(c, pa.binary()) for c in columns[2:]],
                    ],
                    ["tree", "high", "dense", "bits", "again", "more"],
                )

        for batch in batches:
            trees = batch.column("tree").dictionary_encode()
            codes, keys = trees.indices.to_numpy(), batch.column("key").to_numpy()
            for code, tree in enumerate(trees.dictionary.to_pylist()):
                held.setdefault(tree, []).append(keys[codes == code])
            size += len(keys)
            if size >= HELD:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        counts = np.zeros(CONTAINER, np.int64)
        for part in parts.to_pylist():
            counts[unpacked(part["dense"], part["bits"])] += 1
            counts[np.frombuffer(part["again"], np.uint16)] += np.frombuffer(part["more"], np.int64)
        again = np.flatnonzero(counts > 1)
        dense, data = packed(np.flatnonzero(counts))
        return pa.table(
            {
                "tree": pa.array([key[0].as_py()]), "high": pa.array([key[1].as_py()], pa.int64()), "dense": pa.array([dense]),
                "bits": pa.array([data], pa.binary()), "again": pa.array([again.astype(np.uint16).tobytes()], pa.binary()),
                "more": pa.array([(counts[again] - 1).tobytes()], pa.binary()), "rows": pa.array([int(counts.sum())], pa.int64()),
            }
        )

    keyed = thin.where("key is not null").select("tree", "key")
    return keyed.mapInArrow(send, fields).groupBy("tree", "high").applyInArrow(merge, f"{fields}, rows long")


class Ranks:
    """Rank queries in a merged container; rows of repeated keys count as often as they occur."""

    def __init__(self, row: dict) -> None:
        self.start = row["before"]
        if row["dense"]:
            self.bits, self.offsets = Bits(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")), None
        else:
            self.offsets = unpacked(False, row["bits"])
        self.again = np.frombuffer(row["again"], np.uint16).astype(np.int64)
        self.more = np.concatenate([[0], np.cumsum(np.frombuffer(row["more"], np.int64))])

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = keys & (CONTAINER - 1)
        distinct = self.bits.ones(at) if self.offsets is None else np.searchsorted(self.offsets, at)
        return self.start + distinct + self.more[np.searchsorted(self.again, at)]


def placed(thin: DataFrame) -> DataFrame:
    """Thin rows with their place in the tree and the tree's number of leaves: tree, place, size, key, leaf, changed."""
    held = written(containers(thin), "containers")
    held = written(sums_before(held, ["tree"], ["high"], F.col("rows"), "before"), "containers")
    sizes = written(thin.groupBy("tree").agg(F.count("*").alias("size"), F.count("key").alias("keyed")), "trees")
    high = F.shiftright("key", CONTAINER_BITS).alias("high")
    once = thin.where("key is not null")
    ties = held.where("length(again) > 0")
    tied = ties.limit(1).count() > 0
    if tied:
        # a row per key that occurs again, with the place of its first row
        def first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ranks = Ranks(row)
                    keys = (row["high"] << CONTAINER_BITS) + ranks.again
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["tree"]] * len(keys)), pa.array(keys, pa.int64()), pa.array(ranks.of(keys), pa.int64())],
                        ["tree", "key", "first"],
                    )

        ties = written(ties.mapInArrow(first_places, "tree string, key long, first long"), "ties")
        once = once.join(ties, ["tree", "key"], "left_anti")

    def rank(key: tuple, rows: pa.Table, container: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["tree", "key", "leaf", "changed"]).append_column("place", pa.array([], pa.int64()))
        places = Ranks(container.to_pylist()[0]).of(rows.column("key").to_numpy())
        return rows.select(["tree", "key", "leaf", "changed"]).append_column("place", pa.array(places, pa.int64()))

    fields = "tree string, key long, leaf string, changed string, place long"
    found = (
        once.select("tree", "key", "leaf", "changed", high)
        .groupBy("tree", "high")
        .cogroup(held.groupBy("tree", "high"))
        .applyInArrow(rank, fields)
    )
    rest = thin.where("key is null").join(sizes.select("tree", F.col("keyed").alias("first")), "tree")
    if tied:
        rest = rest.unionByName(thin.join(ties, ["tree", "key"]))
    elif not thin.where("key is null").limit(1).count():
        rest = None
    if rest is not None:
        # equal leaves are told apart by where they are read from, once that is written
        rest = written(rest.withColumn("tag", F.monotonically_increasing_id()), "tied")
        rest = sums_before(rest, ["tree", "first"], ["leaf", "tag"], F.lit(1), "behind")
        found = found.unionByName(rest.select("tree", "key", "leaf", "changed", (F.col("first") + F.col("behind")).alias("place")))
    return found.join(sizes.select("tree", "size"), "tree")


def combined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(digests: list[str], size: int) -> list[list[str]]:
    """The digests of a block and of up to ``LEVELS`` levels above it; ``size`` nodes stand at its level in the tree."""
    levels = [digests]
    while size > 1 and len(levels) <= LEVELS:
        last = levels[-1]
        levels.append([combined(last[i : i + FAN]) for i in range(0, len(last), FAN)])
        size = -(-size // FAN)
    return levels


def path_in(levels: list[list[str]], slot: int) -> list[str]:
    """Left and right siblings, level by level."""
    path = []
    for level in levels[:-1]:
        first = slot - slot % FAN
        path += ["".join(level[first:slot]), "".join(level[slot + 1 : first + FAN])]
        slot //= FAN
    return path


def folded(digest: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = combined([left, digest, right])
    return digest


def slot_arrays(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, place, size, key, leaf, changed) as rows (tree, block, size, slots), written."""
    block = F.floor(F.col("place") / BLOCK).alias("block")
    slots = F.sort_array(F.collect_list(F.struct("place", "key", "leaf", "changed"))).alias("slots")
    return written(nodes.groupBy("tree", block).agg(F.max("size").alias("size"), slots), "slots")


def reduced(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of each step, from the leaves up, and the root of every tree: tree, root."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for slots, size in zip(batch.column("slots"), batch.column("size").to_pylist(), strict=True):
                tops.append(levels_of(pa.array(slots.values.field("leaf")).to_pylist(), size)[-1][0])
            size = -(-batch.column("size").to_numpy() // BLOCK)
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("block"), pa.array(size, pa.int64()), pa.array(tops, pa.string())], ["tree", "place", "size", "leaf"]
            )

    steps = [slot_arrays(nodes)]
    largest, roots = steps[0].agg(F.max("size")).first()[0] or 0, None
    while True:
        above = written(steps[-1].select("tree", "block", "size", "slots").mapInArrow(up, "tree string, place long, size long, leaf string"), "digests")
        done = above.where("size = 1").select("tree", F.col("leaf").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        if largest <= BLOCK:
            return steps, roots
        largest = -(-largest // BLOCK)
        more = above.where("size > 1").withColumn("key", F.lit(None).cast("string")).withColumn("changed", F.lit(None).cast("string"))
        steps.append(slot_arrays(more))


def descended(steps: list[DataFrame], tops: DataFrame, results) -> DataFrame:
    """From rows (tree, path, subroot, root) for whole trees down to rows of ``results`` for their leaves."""

    def down(fields: list[str], row_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    levels = levels_of([s["leaf"] for s in row["slots"]], row["size"])
                    out = [row_of(row, slot, path_in(levels, j) + row["path"]) for j, slot in enumerate(row["slots"])]
                    yield pa.RecordBatch.from_pylist(out, schema=fields)

        return run

    node = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])

    def as_parent(row: dict, slot: dict, path: list[str]) -> dict:
        return {"tree": row["tree"], "block": slot["place"], "path": path, "subroot": row["subroot"], "root": row["root"]}

    parents = None
    for i, step in reversed(list(enumerate(steps))):
        whole = step.where(F.col("size") <= BLOCK).join(tops, "tree")
        if parents is not None:
            whole = whole.unionByName(step.where(F.col("size") > BLOCK).join(parents, ["tree", "block"]))
        whole = whole.select("tree", "block", "size", "slots", "path", "subroot", "root")
        if i:
            parents = written(whole.mapInArrow(down(node, as_parent), "tree string, block long, path array<string>, subroot string, root string"), "paths")
        else:
            ddl, schema, row_of = results
            return whole.mapInArrow(down(schema, row_of), ddl)
    raise ValueError("no steps")


def _paths() -> tuple:
    """Results for subroots: their path to the root, as tops of the trees below."""
    fields = pa.schema([("tree", pa.string()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
    return (
        "tree string, path array<string>, subroot string, root string",
        fields,
        lambda row, slot, path: {"tree": slot["key"], "path": path, "subroot": slot["leaf"], "root": row["root"]},
    )


def _proofs(with_path: bool) -> tuple:
    """Results for leaves: the digest of the path, the root that the row as it is now leads to, and the path if asked for."""
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    fields = pa.schema([("key", pa.int64()), *[(n, pa.string()) for n in names]])
    ddl = "key long, " + ", ".join(f"{n} string" for n in names)
    if with_path:
        fields, ddl = fields.append(pa.field("path", pa.list_(pa.string()))), ddl + ", path array<string>"

    def row_of(row: dict, slot: dict, path: list[str]) -> dict:
        out = {
            "key": slot["key"], "leaf": slot["leaf"], "subroot": row["subroot"], "root": row["root"],
            "proof_sha256": combined(path), "folded_root": folded(slot["changed"] or slot["leaf"], path),
        }
        return out | {"path": path} if with_path else out

    return ddl, fields, row_of


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "lang", text: str = "text", columns: tuple[str, ...] = COLUMNS, with_path: bool = False
) -> DataFrame:
    """A row per document: key, leaf, subroot, root, the digest of its path, the root folded from the row as it is
    now (tampered or not), whether that equals the root, and the path itself (left and right siblings by level)."""
    integer_key(docs, key)
    thin = written(leaves(docs, key, group, text, columns), "leaves")
    steps, subroots = reduced(placed(thin))
    subroots = written(subroots.select(F.col("tree").alias("key"), F.col("root").alias("leaf")), "subroots")
    numbered = sums_before(subroots.withColumn("tree", F.lit("all")), ["tree"], ["key"], F.lit(1), "place")
    nodes = numbered.withColumn("size", F.lit(subroots.count()).cast("long")).withColumn("changed", F.lit(None).cast("string"))
    own_steps, root = reduced(nodes)
    top = root.select("tree", F.array().cast("array<string>").alias("path"), F.col("root").alias("subroot"), "root")
    tops = written(descended(own_steps, top, _paths()), "tops")
    rows = descended(steps, tops, _proofs(with_path))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def sql(levels: int = 8) -> str:
    """The trees level by level, for up to 8 ** ``levels`` leaves a language and as many languages."""
    value = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(value.format(text if c == 'text' else c) for c in COLUMNS)})"

    run = "PARTITION BY tree, place // 8 ORDER BY place"
    node = (
        f"SELECT tree, place, size, d, coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
        f"coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM"
    )

    def tree(name: str, start: str) -> list[str]:
        out = [f"{name}0 AS MATERIALIZED ({node} ({start}))"]
        for k in range(1, levels + 1):
            below = f"SELECT tree, place // 8 AS place, (size + 7) // 8 AS size, sha256(string_agg(d, '' ORDER BY place)) AS d FROM {name}{k - 1} WHERE size > 1 GROUP BY ALL"
            out.append(f"{name}{k} AS MATERIALIZED ({node} ({below}))")
        return out

    def climbed(name: str, start: str) -> list[str]:
        out, last = [], start
        for k in range(levels):
            up = f"CASE WHEN n.size > 1 THEN {{}} ELSE {{}} END"
            out.append(
                f"{name}_path{k} AS (SELECT f.* REPLACE (coalesce({up.format('f.path || n.l || n.r', 'f.path')}, f.path) AS path, "
                f"coalesce({up.format('sha256(n.l || f.now || n.r)', 'f.now')}, f.now) AS now) "
                f"FROM {last} f LEFT JOIN {name}{k} n ON n.tree = f.{name}_tree AND n.place = f.{name}_place // {8**k})"
            )
            last = f"{name}_path{k}"
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce(list_prepend(n::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), "
        "lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
    )
    union = " UNION ALL ".join(f"SELECT tree, d FROM leaf{k} WHERE size = 1" for k in range(levels + 1))
    top = " UNION ALL ".join(f"SELECT d FROM top{k} WHERE size = 1" for k in range(levels + 1))
    parts = [
        f"table_of AS MATERIALIZED (SELECT list_transform(range(256), lambda n: {step}) AS steps)",
        f"hashed AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS d, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} END AS t FROM documents, table_of)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM hashed)",
        *tree("leaf", "SELECT tree, place, size, d FROM placed"),
        f"subroots AS MATERIALIZED (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM ({union}))",
        *tree("top", "SELECT 'all' AS tree, place, size, d FROM subroots"),
        f"root AS ({top})",
        "start AS (SELECT p.doc_id, p.d AS leaf, s.d AS subroot, coalesce(p.t, p.d) AS now, '' AS path, p.tree AS leaf_tree, p.place AS leaf_place, "
        "'all' AS top_tree, s.place AS top_place FROM placed p JOIN subroots s USING (tree))",
        *climbed("leaf", "start"),
        *climbed("top", f"leaf_path{levels - 1}"),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root.d AS root, sha256(path) AS proof_sha256, now AS folded_root, now = root.d AS verified "
        f"FROM top_path{levels - 1}, root"
    )
