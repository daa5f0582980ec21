"""The book of notes: live filter, search, paging, projection, defaults, conflicts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikebook.functions import values
from strikebook.functions.dedupe import first_wins, last_wins


def live_on(book: DataFrame, day: dt.date) -> DataFrame:
    """Notes whose life includes ``day``; both ends count. Two range filters reach the scan."""
    return book.filter((F.col("issue_date") <= F.lit(day)) & (F.col("maturity_date") >= F.lit(day)))


def book_filter(book: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality on the given columns; a blank value is no filter at all."""
    for column, value in wanted.items():
        if value is not None and value.strip():
            book = book.filter(F.col(column) == value)
    return book


def free_text(book: DataFrame, q: str | None) -> DataFrame:
    """Case-insensitive ``%q%`` over name, instrument code and ISIN."""
    if q is None or not q.strip():
        return book
    pattern = f"%{q.strip()}%"
    return book.filter(
        F.col("commercial_name").ilike(pattern)
        | F.col("instrument_code").ilike(pattern)
        | F.col("isin").ilike(pattern)
    )


GRID = [
    "note_id", "figure_code", "instrument_code", "isin", "commercial_name", "issue_date",
    "maturity_date", "modality", "asset", "quantity", "notional", "status", "updated_on",
]


def grid(book: DataFrame) -> DataFrame:
    """The listing columns; a document column is never read."""
    return book.select(*[c for c in GRID if c in book.columns])


# Attributes the listing carries out of a document.
PROJECTED = (
    "common struct<commercialName:string, instrumentCode:string, isin:string, issuerAccount:string, "
    "issueDate:string, maturityDate:string, modality:string, quantity:decimal(38,18), "
    "unitIssuePrice:decimal(38,18), notional:decimal(38,18)>, underlying struct<assetClass:string, asset:string>"
)


def project_book(docs: DataFrame, today: dt.date) -> DataFrame:
    """Typed columns out of the JSON documents, with the booking defaults for what is absent."""
    # The one-element explode keeps the parse apart, so that it runs once per document.
    parsed = docs.select("note_id", "figure_code", F.explode(F.array(F.from_json("doc", PROJECTED))).alias("_d"))
    issue = F.coalesce(values.as_date(F.col("_d.common.issueDate")), F.lit(today))
    maturity = F.coalesce(values.as_date(F.col("_d.common.maturityDate")), F.add_months(F.lit(today), 12))
    name = F.coalesce(values.present(F.col("_d.common.commercialName")), F.lit("(sem nome)"))
    return parsed.select(
        "note_id",
        "figure_code",
        name.alias("commercial_name"),
        values.present(F.col("_d.common.instrumentCode")).alias("instrument_code"),
        values.present(F.col("_d.common.isin")).alias("isin"),
        F.col("_d.common.issuerAccount").alias("issuer_account"),
        issue.alias("issue_date"),
        maturity.alias("maturity_date"),
        F.col("_d.common.modality").alias("modality"),
        F.col("_d.underlying.assetClass").alias("underlying_class"),
        F.col("_d.underlying.asset").alias("underlying"),
        # Dropped, not rounded: a fractional quantity registers its whole part.
        F.col("_d.common.quantity").try_cast("bigint").alias("quantity"),
        F.col("_d.common.unitIssuePrice").try_cast("decimal(28,8)").alias("unit_issue_price"),
        F.col("_d.common.notional").try_cast("decimal(28,8)").alias("notional"),
        F.lit("Validated").alias("status"),
    )


def apply_computed(df: DataFrame, formulas: list[tuple[str, str]]) -> DataFrame:
    """Derive columns one after another, overwriting whatever the payload said."""
    for column, formula in formulas:
        df = df.withColumn(column, F.expr(formula))
    return df


def compute_rows(df: DataFrame, section: str, key: str, formula) -> DataFrame:
    """Derive ``key`` inside every row of an array-of-struct section, in place."""
    return df.withColumn(section, F.transform(section, lambda row: row.withField(key, formula(row))))


def seed_defaults(notes: DataFrame, attributes: DataFrame, fields: DataFrame) -> DataFrame:
    """Every field of a note's template with the note's value, else the field's default.

    ``fields`` is one row per (figure_code, path), so the first join multiplies a note by its
    template only. ``attributes`` is long and keyed by (note_id, path).
    """
    wanted = notes.select("note_id", "figure_code").join(fields, "figure_code")
    filled = wanted.join(attributes.select("note_id", "path", "value"), ["note_id", "path"], "left")
    value = values.present(F.col("value"))
    return filled.select(
        "note_id", "path", F.coalesce(value, F.col("default_value")).alias("value"),
        value.isNull().alias("defaulted"),
    )


def applicable_attributes(attributes: DataFrame, section_guard: str | None, guards: dict[str, str]) -> DataFrame:
    """Attributes a pass may speak about: section and field both visible.

    No guard means visible; a guard that cannot be decided means hidden.
    """
    visible: Column = F.lit(True)
    for path, predicate in guards.items():
        visible = F.when(F.col("path") == path, F.coalesce(F.expr(predicate), F.lit(False))).otherwise(visible)
    if section_guard is not None:
        visible = visible & F.coalesce(F.expr(section_guard), F.lit(False))
    return attributes.filter(visible)


def with_figure_name(book: DataFrame, figures: DataFrame) -> DataFrame:
    """Left lookup; the side is broadcast when Spark measures it small."""
    return book.join(figures.select("figure_code", "figure_name"), "figure_code", "left")


#: Rows a page may skip by sorting them; beyond that their keys are narrowed first. Parts a day is cut into for it.
MOST_SKIPPED, PARTS = 10_000, 1000


def _narrowed(rows: DataFrame, key: Column, groups: list, skip: int, size: int) -> tuple[DataFrame, int]:
    """The rows of the groups that hold places ``skip`` to ``skip + size``, and how many of these come before.

    ``groups`` are (value of ``key``, rows) in order.
    """
    kept, before, at = [], 0, 0
    for value, n in groups:
        if at + n <= skip:
            before += n
        elif at < skip + size:
            kept.append(value)
        at += n
    known = [v for v in kept if v is not None]
    wanted = key.isin(known) if known else F.lit(False)
    return rows.where(wanted | key.isNull() if None in kept else wanted), skip - before


def page_with_total(book: DataFrame, figures: DataFrame, page: int, size: int, most_skipped: int = MOST_SKIPPED) -> DataFrame:
    """One page, newest update first, with the unpaged total on each row.

    Rows are counted per day of update, so only the days that hold the page are read again, with their dates pushed into
    the scan. Where a day holds more rows before the page than may be skipped, it is cut into parts by the quantiles of its ids
    first. The rest is a take-ordered limit. Names are joined to the page, not to the book.
    """
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and hold 1 to 500 notes")
    # one row a day
    days = book.groupBy("updated_on").agg(F.count("*").alias("n")).orderBy(F.col("updated_on").desc_nulls_last()).collect()
    rows, skip = _narrowed(book, F.col("updated_on"), days, (page - 1) * size, size)
    if skip > most_skipped:
        cuts = rows.groupBy("updated_on").agg(F.percentile_approx("note_id", [i / PARTS for i in range(1, PARTS)], 10 * PARTS).alias("_cuts"))
        met = F.col("updated_on").eqNullSafe(F.col("_day"))
        rows = rows.join(F.broadcast(cuts.withColumnRenamed("updated_on", "_day")), met)
        part = F.concat_ws(":", "updated_on", F.lpad(F.size(F.filter("_cuts", lambda c: c < F.col("note_id"))).cast("string"), 4, "0"))
        rows = rows.withColumn("_part", part)
        # at most a page's number of days, in a bounded number of parts each
        sizes = rows.groupBy("updated_on", "_part").agg(F.count("*").alias("n"))
        sizes = sizes.orderBy(F.col("updated_on").desc_nulls_last(), "_part").select("_part", "n").collect()
        rows, skip = _narrowed(rows, F.col("_part"), sizes, skip, size)
        rows = rows.drop("_day", "_cuts", "_part")
    cut = rows.orderBy(F.col("updated_on").desc_nulls_last(), F.col("note_id")).offset(skip).limit(size)
    return with_figure_name(cut, figures).withColumn("total", F.lit(sum(d.n for d in days)).cast("long"))


def eligible_underlyings(master: DataFrame) -> DataFrame:
    """Rows of the master that notes may use, first row per (class, code, index)."""
    code = F.trim("code")
    eligible = (
        master.filter((F.col("instrument_type") == "COE") & (code != ""))
        .withColumn("valuation_index", F.coalesce(F.nullif(F.trim("valuation_index"), F.lit("")), F.col("code")))
    )
    return first_wins(eligible, ["asset_class", "code", "valuation_index"], ["pos"])


def underlying_picker(eligible: DataFrame) -> DataFrame:
    """Variants of one underlying collapsed to the smallest valuation index."""
    return eligible.groupBy("asset_class", "code").agg(F.min("valuation_index").alias("valuation_index"))


def underlying_registered(notes: DataFrame, eligible: DataFrame) -> DataFrame:
    """Whether each note's underlying exists; a note without a class accepts any class."""
    by_class = eligible.select("asset_class", "code").distinct().withColumn("_in_class", F.lit(True))
    by_code = eligible.select("code").distinct().withColumn("_any", F.lit(True))
    found = F.when(F.col("asset_class").isNull(), F.col("_any")).otherwise(F.col("_in_class"))
    return (
        notes.join(by_class, ["asset_class", "code"], "left")
        .join(by_code, "code", "left")
        .withColumn("registered", F.coalesce(found, F.lit(False)))
        .drop("_in_class", "_any")
    )


def instrument_code_taken(book: DataFrame) -> DataFrame:
    """Whether another note carries the same instrument code.

    Smallest and largest id per code decide it: they differ exactly when a second note exists.
    Both combine on the map side, unlike a self-join or a window over a shared code.
    """
    owners = (
        book.filter(F.col("instrument_code").isNotNull())
        .groupBy("instrument_code")
        .agg((F.min("note_id") != F.max("note_id")).alias("taken"))
    )
    return book.join(owners, "instrument_code", "left").withColumn(
        "taken", F.coalesce("taken", F.lit(False))
    )


def template_as_booked(book: DataFrame, templates: DataFrame) -> DataFrame:
    """The template version a note was booked against, else the figure's active one."""
    exact = templates.select(
        "figure_code", F.col("version").alias("template_version"), F.col("published_on").alias("_exact_on")
    )
    active = templates.filter("is_active").select(
        "figure_code", F.col("version").alias("_active"), F.col("published_on").alias("_active_on")
    )
    return (
        book.join(exact, ["figure_code", "template_version"], "left")
        .join(active, "figure_code", "left")
        .select(
            "note_id",
            "figure_code",
            F.col("template_version").alias("booked_version"),
            F.when(F.col("_exact_on").isNotNull(), F.col("template_version"))
            .otherwise(F.col("_active"))
            .alias("used_version"),
            F.coalesce("_exact_on", "_active_on").alias("published_on"),
        )
    )


def detect_conflicts(edits: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome of each edit: refused when its base version is not the stored one."""
    stored = current.select("note_id", F.col("row_version").alias("_stored"))
    outcome = (
        F.when(F.col("_stored").isNull(), "missing")
        .when(F.col("_stored") != F.col("base_version"), "conflict")
        .otherwise("saved")
    )
    return edits.join(stored, "note_id", "left").withColumn("outcome", outcome).drop("_stored")


def save_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Update-else-insert: for each key the newest change, else the stored row."""
    ranked = target.withColumn("_source", F.lit(0)).unionByName(changes.withColumn("_source", F.lit(1)))
    return last_wins(ranked, keys, ["_source", order]).drop("_source")


def insert_only(target: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Append the keys the target does not have yet; existing rows are never touched."""
    new = first_wins(changes.join(target.select(*keys), keys, "left_anti"), keys, [order])
    return target.unionByName(new.select(*target.columns))
