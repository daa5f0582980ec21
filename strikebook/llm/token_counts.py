"""Token counts by map-side lookup in two tiers, without a shuffle of pre-tokens or texts.

First tier: the token counts of the most frequent pre-tokens, broadcast as one block of text and one of
numbers (at most ``FREQUENT`` entries of at most 64 characters, so a few megabytes at any input size).
Every task counts the pre-tokens of all its texts in a bounded summary; only summaries meet. Second tier:
a bounded cache in each Python worker, filled by the tokenizers library. Neither tier decides a result:
what is in no cache is encoded.

Defined cases: a null text counts as empty (0 bytes, 0 tokens). Repeated rows give repeated results.
Special strings inside texts count as the library's special tokens. Columns with the names of results are
replaced.

The frequent pre-tokens come from per-task summaries of all texts (``SUMMARY`` entries each), the only thing
that is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikebook.llm.pretokens import LONGEST_KEPT, Cached, Splitter, worker_cache
from strikebook.llm.shared import table

FREQUENT = 65_536
#: Entries of a task's summary, and how far it may grow before it is cut back to them.
SUMMARY, SLACK = 8_192, 8


def frequent_pre_tokens(docs: DataFrame, text: str, path: str, most: int = FREQUENT) -> list[str]:
    """The pre-tokens that lead the tasks' summaries of all texts; at most ``most`` reach the driver."""

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter, seen = Splitter(path), Counter()
        for batch in batches:
            for value in batch[text]:
                for words, _ in splitter.parts(value) if value else ():
                    seen.update(words)
            if len(seen) > SUMMARY * SLACK:
                seen = Counter(dict(seen.most_common(SUMMARY)))
        top = [(w, n) for w, n in seen.most_common(SUMMARY) if n > 1 and len(w) <= LONGEST_KEPT]
        yield pd.DataFrame(top, columns=["word", "n"])

    counts = docs.select(text).mapInPandas(summarize, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in top.select("word").collect()]


def broadcast_lengths(spark: SparkSession, words: list[str], path: str) -> Broadcast:
    """The first tier: words without separators, their ends, and their token counts."""
    splitter = Splitter(path)
    lengths = [len(e.ids) for e in splitter.library.encode_batch(words, add_special_tokens=False)]
    ends = np.cumsum([len(w) for w in words], dtype=np.uint32) if words else np.zeros(0, np.uint32)
    return spark.sparkContext.broadcast(("".join(words), ends, np.array(lengths, np.uint8)))


def _first_tier(cache: Cached, shared: Broadcast) -> None:
    """Load the broadcast counts into this worker's cache."""
    joined, ends, lengths = shared.value
    begin = 0
    for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
        cache[joined[begin:end]] = n
        begin = end


def with_counts(
    docs: DataFrame, text: str = "text", path: str | None = None, limit: int = 1024, most: int = FREQUENT
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens (long) and over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    shared = broadcast_lengths(spark, frequent_pre_tokens(docs, text, path, most), path)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = worker_cache(path, "lengths", len)
        if not cache:
            _first_tier(cache, shared)
        for batch in batches:
            yield pd.Series([sum(map(sum, cache.values_of(v))) if v else 0 for v in batch], dtype="int64")

    return docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"), "n_tokens": tokens(text)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
