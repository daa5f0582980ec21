"""Exact deduplication against a persistent index of text digests.

The index is a bucketed table: a row per distinct text, with the SHA-256 of the text after every run of
white space (blank, 09-0D) became one blank, and the key of the row that stays. Its files are bucketed and
sorted by the digest and lie in a shared folder, so a later application opens the same index again.

New data is reduced to a thin row per document, written once, and to one row per digest (partial sums before
the shuffle). A sort-merge anti-join finds the digests that the index does not hold; the index is read by
bucket and never shuffled. They are appended, bucketed and sorted likewise. A failed append leaves no
files, and one run twice finds nothing new.

A text that the index holds keeps the row which came first, whatever later keys are; inside a batch the least key
stays. Digests that hold over a thousandth of all rows are at most a thousand; these are broadcast when
rows look up their group, so a hot text is never sent to one task.

Defined cases: a null text counts as empty, and empty texts equal each other. Rows without a key stay only if
no row of their group has one. Repeated rows with the same key and text are copies; one of them stays. Empty tables
give no rows and append nothing. Other columns are not read by ``decided`` and are carried by ``survivors``, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikebook.llm.shared import scratch, table, written

#: A digest is hot when more than one row in so many has it; there are fewer hot digests than that.
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """The index in ``folder``. Its number of buckets is part of the path: another number is another index."""

    def __init__(self, spark: SparkSession, folder: str, key_type: str = "bigint", buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{folder.rstrip('/')}/buckets-{self.buckets}"
        self.name = "digests_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep {key_type}, tag BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, reduced: DataFrame) -> DataFrame:
        """Rows (digest, ...) whose digest the index does not hold."""
        return reduced.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, thin: DataFrame) -> None:
        """Adds what rows (tag, key, digest) bring that is new, with the first row of each group."""
        first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tag")).alias("first")
        new = self.unknown(thin.groupBy("digest").agg(first))
        new = new.select("digest", F.col("first.key").alias("keep"), F.col("first.tag").alias("tag"))
        # dealt as the buckets are: each task writes the one file of its bucket
        new.repartition(self.buckets, "digest").write.insertInto(self.name)


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A written thin row per document: a tag that names the row, its key and digest."""
    tag = F.xxhash64(F.lit(uuid.uuid4().hex), F.monotonically_increasing_id())
    return written(docs.select(tag.alias("tag"), F.col(key).alias("key"), digest_of(F.col(text)).alias("digest")), "digests")


def decided(thin: DataFrame, index: DigestIndex) -> DataFrame:
    """A row per thin row: tag, key, digest, keep, n (rows of ``thin`` with this digest), kept."""
    sizes = thin.groupBy("digest").agg(F.count("*").alias("n"))
    held = index.rows().select("digest", "keep", F.col("tag").alias("first"))
    groups = written(sizes.join(held.hint("merge"), "digest"), "digest-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(groups.where(F.col("n") * HOT_SHARE > total))
    rest = thin.join(hot.select("digest"), "digest", "left_anti").join(groups, "digest")
    rows = rest.unionByName(thin.join(hot, "digest"))
    return rows.select("tag", "key", "digest", "keep", "n", (F.col("tag") == F.col("first")).alias("kept"))


def survivors(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose texts are new to the index, one of each group, with all their columns; the index then holds them."""
    thin = digests(docs, key, text)
    index.append(thin)
    kept = written(decided(thin, index).where("kept").select("key", "digest"), "kept")
    rows = docs.select(F.col(key).alias("_key"), digest_of(F.col(text)).alias("_digest"), F.struct(*docs.columns).alias("_row"))
    met = F.col("_key").eqNullSafe(F.col("key")) & (F.col("_digest") == F.col("digest"))
    # only rows that repeat key and text are told apart by their other columns
    twice = thin.groupBy("key", "digest").agg(F.count("*").alias("n")).where("n > 1").join(
        kept.withColumnRenamed("key", "_k"), ["digest"], "left_semi"
    )
    twice = written(twice.select("key", "digest"), "repeated")
    alone = rows.join(kept, met, "left_semi").join(twice, met, "left_anti")
    again = rows.join(twice, met, "left_semi").join(kept, met, "left_semi")
    one = again.groupBy("_key", "_digest").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return alone.select("_row").union(one.select("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index filled in two loads: documents up to the middle id, then the rest against what it holds."""
    thin = digests(table(spark, sf_dir, "documents"), "doc_id", "text")
    index = DigestIndex(spark, scratch(spark, "digest-index"))
    middle = thin.agg(F.percentile_approx("key", 0.5, 100)).first()[0]
    first = F.coalesce(F.col("key") <= F.lit(middle), F.lit(False))
    index.append(thin.where(first))
    index.append(thin.where(~first))
    rows = decided(thin, index)
    return rows.select(
        F.col("key").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, h AS text_sha256
FROM d WINDOW same AS (PARTITION BY h)"""
