"""License scans with ordered signature rules, as one projection per text.

A cheap pattern over the raw text admits the few texts that hold any license word. Only these are brought
to the form the rules are written for: words in lower case (A-Z), each behind its number, so that what a
rule matches carries its own place. Of the rules (``license_rules``) those whose keyword is in the text
run. Detections are sorted by start, longer first, then priority and rank; one that lies within an earlier
one of equal or higher priority is suppressed. Nothing is shuffled and no row leaves the JVM.

Defined cases: a null text is empty. Texts without words have n_words 0. Repeated rows are scanned each.
Columns with the names of results are replaced. ``score`` is the largest weight of the detections kept, 0
without any; base phrases that no rule kept still count in labels, with weight 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikebook.llm.license_rules import LicenseRule, rules
from strikebook.llm.shared import carried, table

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Every match of a rule or base phrase has one of these in the raw text.
GATE = (
    r"(?i)licen|copyright|reserved|public|warrant|permission|redistribut|proprietary|creative|unencumbered|spdx"
    r"|software|altered|(?:^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by|domain|(?:under|subject)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
)
BASE_WEIGHT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def numbered_pattern(words: str) -> str:
    """A rule's pattern for text in which words read ``  12:word ``: two spaces between words."""
    return r" (\d+):" + words.replace(" ", r"  \d+:") + " "


def _gated(body: Column) -> Column:
    return F.rlike(body, F.lit(GATE))


def _numbered(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), "  "), F.lit(" "))


def _rule_table(found: tuple[LicenseRule, ...]) -> Column:
    """Rules by keyword, as one constant."""
    by_keyword: dict[str, list[tuple[int, LicenseRule]]] = {}
    for rank, rule in enumerate(found):
        by_keyword.setdefault(rule.keyword, []).append((rank, rule))
    return F.array(
        *[
            F.struct(
                F.lit(keyword).alias("keyword"),
                F.array(
                    *[
                        F.struct(
                            F.lit(numbered_pattern(r.pattern)).alias("pattern"), F.lit(r.label).alias("label"),
                            F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.lit(rank).alias("rank"),
                        )
                        for rank, r in group
                    ]
                ).alias("rules"),
            )
            for keyword, group in by_keyword.items()
        ]
    )


def _detections(numbered: Column, plain: Column, table: Column) -> Column:
    """Sorted structs (start, minus end, minus priority, rank, label, weight) of all rules that match."""
    active = F.flatten(F.transform(F.filter(table, lambda k: F.contains(plain, k["keyword"])), lambda k: k["rules"]))
    one = lambda r: F.transform(
        F.regexp_extract_all(numbered, r["pattern"], F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, r"(\d+)", 1).cast("int").alias("start"),
            (-F.regexp_extract(m, r"(\d+):[^:]* $", 1).cast("int") - 1).alias("minus_end"),
            (-r["priority"]).alias("minus_priority"), r["rank"].alias("rank"), r["label"].alias("label"), r["weight"].alias("weight"),
        ),
    )
    return F.array_sort(F.flatten(F.transform(active, one)))


def _kept(found: Column) -> Column:
    """Labels, the best weight and the number of detections that no earlier interval of equal or higher priority holds."""
    zero = F.struct(
        *[F.lit(-1).alias(f"reach{p}") for p in (1, 2, 3)], F.array().cast("array<string>").alias("labels"),
        F.lit(0.0).alias("score"), F.lit(0).alias("n"),
    )

    def step(a: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        reach = F.when(priority == 1, F.greatest(a["reach1"], a["reach2"], a["reach3"])).when(priority == 2, F.greatest(a["reach2"], a["reach3"])).otherwise(a["reach3"])
        new = end > reach
        return F.struct(
            *[F.when(priority == p, F.greatest(a[f"reach{p}"], end)).otherwise(a[f"reach{p}"]).alias(f"reach{p}") for p in (1, 2, 3)],
            F.when(new, F.array_union(a["labels"], F.array(d["label"]))).otherwise(a["labels"]).alias("labels"),
            F.when(new, F.greatest(a["score"], d["weight"])).otherwise(a["score"]).alias("score"),
            F.when(new, a["n"] + 1).otherwise(a["n"]).alias("n"),
        )

    return F.aggregate(found, zero, step, lambda a: F.struct(a["labels"].alias("labels"), a["score"].alias("score"), a["n"].alias("n")))


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections", "n_suppressed")


def scan(docs: DataFrame, text: str = "text", found_rules: tuple[LicenseRule, ...] | None = None, with_detections: bool = False) -> DataFrame:
    """``docs`` with ``RESULTS``; ``with_detections`` adds all detections before suppression as an array."""
    own = carried(docs.columns, (*RESULTS, "detections"), (text,))
    docs = docs.select(F.struct(*own).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    body = F.col("_body")
    lines = F.filter(F.split(F.translate(body, UPPER, LOWER), BREAK), lambda w: w != "")
    df = docs.withColumn("_words", F.when(_gated(body), lines))
    df = df.withColumn("_plain", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    df = df.withColumn("_numbered", _numbered(F.col("_words")))
    starts = lambda words: F.transform(
        F.regexp_extract_all("_numbered", F.lit(numbered_pattern(words)), F.lit(1)), lambda m: m.cast("long")
    )
    for i, (_, words) in enumerate(BASE):
        df = df.withColumn(f"_base{i}", F.when(F.contains("_plain", F.lit(f" {words} ")), starts(words)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_places", F.concat(*[f"_base{i}" for i in range(len(BASE))]))
    df = df.withColumn("detections", F.when(F.col("_words").isNotNull(), _detections(F.col("_numbered"), F.col("_plain"), _rule_table(found_rules or rules()))))
    df = df.withColumn("_kept", F.when(F.size("detections") > 0, _kept(F.col("detections"))))
    base = F.array_compact(F.array(*[F.when(F.size(f"_base{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(BASE)]))
    none = F.array().cast("array<string>")
    df = df.withColumn("_base_labels", base)
    has_base = F.size("_base_labels") > 0
    every = F.array_union("_base_labels", F.coalesce(F.col("_kept.labels"), none))
    results = (
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(F.col("_places").isNotNull(), F.size("_places")).otherwise(0).cast("long").alias("n_base"),
        F.array_min("_places").alias("first_word"),
        F.array_max("_places").alias("last_word"),
        F.array_join(F.array_sort("_base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.greatest(F.coalesce("_kept.score", F.lit(0.0)), F.when(has_base, F.lit(BASE_WEIGHT)).otherwise(0.0)).alias("score"),
        F.coalesce("_kept.n", F.lit(0)).cast("long").alias("n_detections"),
        (F.greatest(F.size(F.coalesce("detections", F.array())), F.lit(0)) - F.coalesce("_kept.n", F.lit(0))).cast("long").alias("n_suppressed"),
    )
    extra = [F.col("detections")] if with_detections else []
    return df.select(*[F.col("_row")[c].alias(c) for c in own], *results, *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def sql() -> str:
    """The same rows in DuckDB: detections by joining texts with the rules, suppression by a self-join."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(
        f"({i}, {quoted(r.keyword)}, {quoted(numbered_pattern(r.pattern))}, {quoted(r.label)}, {r.priority}, {r.weight})"
        for i, r in enumerate(rules())
    )
    base = " UNION ALL ".join(
        f"SELECT row_key, '{label}' AS label, unnest(regexp_extract_all(numbered, '{numbered_pattern(words)}', 1))::bigint AS start FROM texts"
        for label, words in BASE
    )
    return f"""
WITH words AS (
  SELECT row_number() OVER () AS row_key, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
texts AS (
  SELECT row_key, ' ' || array_to_string(w, ' ') || ' ' AS plain,
    ' ' || array_to_string(list_transform(w, lambda x, i: (i - 1)::varchar || ':' || x), '  ') || ' ' AS numbered
  FROM words WHERE len(w) > 0),
signature(rank, keyword, pattern, label, priority, weight) AS (VALUES {values}),
matched AS (
  SELECT row_key, rank, label, priority, weight, unnest(regexp_extract_all(numbered, pattern)) AS m
  FROM texts JOIN signature ON contains(plain, keyword)),
found AS (
  SELECT row_key, rank, label, priority, weight, regexp_extract(m, '([0-9]+)', 1)::int AS s, regexp_extract(m, '([0-9]+):[^:]* $', 1)::int + 1 AS e FROM matched),
kept AS (
  SELECT * FROM found d WHERE NOT EXISTS (
    SELECT 1 FROM found o WHERE o.row_key = d.row_key AND o.rank <> d.rank AND o.priority >= d.priority AND o.s <= d.s AND o.e >= d.e
      AND (o.s < d.s OR o.e > d.e OR o.priority > d.priority OR o.rank < d.rank))),
base AS ({base}),
base_of AS (
  SELECT row_key, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY row_key),
labels_of AS (
  SELECT row_key, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row_key, label FROM base UNION ALL SELECT row_key, label FROM kept) GROUP BY row_key),
kept_of AS (SELECT row_key, max(weight)::double AS score, count(*) AS n FROM kept GROUP BY row_key),
found_of AS (SELECT row_key, count(*) AS n FROM found GROUP BY row_key)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, greatest(coalesce(score, 0.0), CASE WHEN n_base > 0 THEN {BASE_WEIGHT} ELSE 0.0 END)::double AS score,
  coalesce(kept_of.n, 0)::bigint AS n_detections, (coalesce(found_of.n, 0) - coalesce(kept_of.n, 0))::bigint AS n_suppressed
FROM words LEFT JOIN base_of USING (row_key) LEFT JOIN labels_of USING (row_key) LEFT JOIN kept_of USING (row_key) LEFT JOIN found_of USING (row_key)"""
