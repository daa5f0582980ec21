"""Quality rules whose cutoffs come from labelled documents with a guarantee on false rejections.

For each stratum (by default the language) and rule, every cutoff of a fixed grid is a hypothesis "the
rule rejects more than a share ``alpha`` of clean documents". All labelled documents of the stratum are
the holdout: the grid does not depend on them. The exact binomial tail P(Bin(n, alpha) <= k) of the k
clean documents rejected among n is its p-value; cutoffs with a p-value up to ``delta`` divided by the
number of all hypotheses (strata x rules x cutoffs, Bonferroni) are proven, and the strictest proven one
is used. With probability 1 - delta no stratum loses more than ``risk`` of its clean documents, where
alpha = risk / number of rules. A stratum with too few labels proves nothing and rejects nothing.

Defined cases: a null text has no words. A null stratum is a stratum of its own. Repeated rows are judged
one by one. A document labelled more than once is clean only if all its labels say so; labels with a null
id or quality are left out. Without labels only the base rule decides.

Only DataFrame functions run here; there is no shuffle of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikebook.llm.shared import small_or_plain, table, written

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Rejects where 1000 * numerator > cutoff * denominator; cutoffs from lenient to strict."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (500, 300, 200, 150, 100, 75, 50, 30, 20, 10)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", (900, 700, 500, 400, 300, 250, 200, 150, 100, 50)),
    Rule("repeated_words", "n_repeat_words", "n_words", (450, 400, 350, 300, 250, 200, 150, 100, 75, 50)),
    Rule("long_words", "word_chars", "n_words", (20000, 15000, 12000, 11000, 10000, 9000, 8500, 8000, 7500, 7000)),
    Rule("short_words", "n_words", "word_chars", (800, 600, 500, 450, 400, 350, 330, 300, 280, 260)),
)
RISK, DELTA = 0.02, 0.05
#: Terms of the tail summed one by one; what is left is bounded by a geometric series, on the safe side.
TERMS = 4096


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) to each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", F.filter(F.split(body, SPACE), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn(
        "_windows",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - 3),
                lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    df = df.withColumn("_starts", F.when(F.col("_repeats"), _repeated_starts(F.col("_windows"))))
    figures = F.struct(
        "n_words",
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # a generator keeps later filters from being rewritten in terms of the texts, again and again
    return df.select(*docs.columns, F.inline(F.array(figures)))


def _repeated_starts(windows: Column) -> Column:
    """Ascending places of the values that occur twice or more: sorted by value, equal to a neighbour."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    blank = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i")))
    before = F.concat(blank, F.slice(pairs, 1, F.size(windows) - 1))
    after = F.concat(F.slice(pairs, 2, F.size(windows)), blank)
    zipped = F.arrays_zip(pairs.alias("x"), before.alias("b"), after.alias("a"))
    same = F.filter(zipped, lambda z: F.coalesce(z["x"]["h"] == z["b"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["a"]["h"], F.lit(False)))
    return F.array_sort(F.transform(same, lambda z: z["x"]["i"]))


def _covered(starts: Column) -> Column:
    """Words in the union of the three-word windows at ascending starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fires(rule: Rule, cutoff: Column | int) -> Column:
    return 1000 * F.col(rule.numerator) > cutoff * F.col(rule.denominator)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series ten places further on."""
    y = x + 10.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return series - sum((F.log(x + float(i)) for i in range(1, 10)), F.log(x))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) where k < n p, else 1: summed downwards from k, so no term underflows early."""
    kd, nd = k.cast("double"), n.cast("double")
    top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1)
    top = top + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    odds = p / (1 - p)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(TERMS)).cast("int"))
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * (kd - i) / ((nd - kd + i + 1) * odds)).alias("term"), (a["sum"] + a["term"]).alias("sum")
        ),
        # later ratios are smaller than the first one
        lambda a: a["sum"] + F.when(k > TERMS, a["term"] / (1 - kd / ((nd - kd + 1) * odds))).otherwise(0.0),
    )
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def _stratum(name: str) -> Column:
    return F.struct(F.col(name).alias("value"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``_key``, ``_stratum`` and the features of every row, without texts."""
    thin = docs.select(F.col(key).alias("_key"), _stratum(stratum).alias("_stratum"), F.col(text).alias("_text"))
    return features(thin, "_text").drop("_text")


def cutoffs(
    figures: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """From measured rows: a row per stratum with, per rule, its strictest proven cutoff or null."""
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("_key"))
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where((F.col("q") == 1) & (F.col("t") == 0))
        .select("_key")
    )
    counts = (
        figures.join(clean, "_key", "left_semi")
        .groupBy("_stratum")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(_fires(r, c).cast("long")).alias(f"{r.name}_{c}") for r in rules for c in r.cutoffs],
        )
    )
    counts = written(counts, "quality-counts")
    tests = max(1, counts.count()) * sum(len(r.cutoffs) for r in rules)
    each = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r.name}_{c}").alias("k"))
        for r in rules
        for c in r.cutoffs
    ]
    proven = counts.select("_stratum", "n", F.inline(F.array(*each))).where(
        binomial_tail(F.col("k"), F.col("n"), risk / len(rules)) <= delta / tests
    )
    best = [F.min(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"_cut_{r.name}") for r in rules]
    return written(proven.groupBy("_stratum").agg(*best), "quality-cutoffs")


def judged(figures: DataFrame, cut: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows with ``_stratum`` and features, plus ``base_failed``, ``rules_fired`` (rule names) and ``kept``."""
    df = figures.join(small_or_plain(cut).withColumnRenamed("_stratum", "_of"), F.col("_stratum").eqNullSafe(F.col("_of")), "left")
    fired = F.array_compact(F.array(*[F.when(_fires(r, F.col(f"_cut_{r.name}")), F.lit(r.name)) for r in rules]))
    df = df.withColumn("base_failed", base_failed()).withColumn("rules_fired", fired)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("rules_fired") == 0))
    return df.drop("_of", *[f"_cut_{r.name}" for r in rules])


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that no rule rejects. Texts are read twice, never shuffled."""
    cut = cutoffs(measured(docs, key, text, stratum), labels)
    whole = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), _stratum(stratum).alias("_stratum"))
    return judged(features(whole, "_text"), cut).where("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    figures = written(measured(table(spark, sf_dir, "documents")), "quality-features")
    rows = judged(figures, cutoffs(figures, table(spark, sf_dir, "labels")))
    return rows.select(
        F.col("_key").alias("doc_id"),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
        F.array_join("rules_fired", ",").alias("rules_fired"),
    )


def sql() -> str:
    """The same rows in DuckDB: windows by grouping, tails by lgamma over all terms."""
    fires = lambda r, c: f"1000 * {r.numerator} > {c} * {r.denominator}"
    counts = ", ".join(f"sum(({fires(r, c)})::int)::bigint AS {r.name}_{c}" for r in RULES for c in r.cutoffs)
    alpha = RISK / len(RULES)
    tests = f"((SELECT count(*) FROM counts) * {sum(len(r.cutoffs) for r in RULES)})"
    tail = lambda k: (
        f"(CASE WHEN {k} >= n * {alpha} THEN 1 ELSE list_sum(list_transform(range(0, {k} + 1), lambda j: exp(lgamma(n + 1)"
        f" - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln({1 - alpha})))) END)"
    )
    cuts = ", ".join(
        "coalesce(" + ", ".join(f"CASE WHEN {tail(f'{r.name}_{c}')} <= {DELTA} / {tests} THEN {c} END" for c in reversed(r.cutoffs)) + f") AS cut_{r.name}"
        for r in RULES
    )
    verdict = " AND ".join(f"NOT coalesce({fires(r, f'cut_{r.name}')}, false)" for r in RULES)
    fired = ", ".join(f"CASE WHEN {fires(r, f'cut_{r.name}')} THEN '{r.name}' END" for r in RULES)
    return f"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, range(1, len(w) - 1) AS t(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams),
covered AS (
  SELECT doc_id, count(DISTINCT i + d)::bigint AS n FROM twice, range(0, 3) AS t(d) WHERE c >= 2 GROUP BY doc_id),
lined AS (
  SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM words),
feats AS (
  SELECT words.doc_id, lang, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]'))::bigint AS n_symbols, len(ls)::bigint AS n_lines,
    (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(covered.n, 0)::bigint AS n_repeat_words
  FROM words JOIN lined USING (doc_id) LEFT JOIN covered USING (doc_id)),
clean AS (
  SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(coalesce(toxic, 0)) = 0),
counts AS (SELECT lang, count(*) AS n, {counts} FROM feats JOIN clean USING (doc_id) GROUP BY lang),
cuts AS (SELECT lang, {cuts} FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {verdict} AS kept,
  coalesce(array_to_string(list_filter([{fired}], lambda x: x IS NOT NULL), ','), '') AS rules_fired
FROM feats LEFT JOIN cuts ON feats.lang IS NOT DISTINCT FROM cuts.lang"""
