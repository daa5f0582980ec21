"""Queries over the book of notes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strikebook.operators import book as ops
from strikebook.plans.frames import frame, query, spread
from strikebook.plans.registry import Registry

registry = Registry()
DAY = dt.date(1998, 6, 15)
TODAY = dt.date(2024, 1, 31)
LIVE = "issue_date <= DATE '1998-06-15' AND maturity_date >= DATE '1998-06-15'"


@registry.add("B1_live_on", "SELECT note_id, issue_date, maturity_date FROM {book} b WHERE " + LIVE)
def live_on(spark, sf):
    return ops.live_on(frame(spark, sf, "book"), DAY).select("note_id", "issue_date", "maturity_date")


@registry.add(
    "B2_book_filter",
    "SELECT note_id, figure_code, modality, status FROM {book} b "
    "WHERE figure_code = 'COE001005' AND modality = 'VNP' AND status = 'Registered'",
)
def book_filter(spark, sf):
    book = frame(spark, sf, "book")
    chosen = ops.book_filter(book, figure_code="COE001005", modality="VNP", status="Registered", underlying_class=" ")
    return chosen.select("note_id", "figure_code", "modality", "status")


@registry.add(
    "B3_free_text",
    "SELECT note_id, commercial_name, instrument_code, isin FROM {book} b WHERE commercial_name ILIKE '%0012%' "
    "OR instrument_code ILIKE '%0012%' OR isin ILIKE '%0012%'",
)
def free_text(spark, sf):
    return ops.free_text(frame(spark, sf, "book"), " 0012 ").select(
        "note_id", "commercial_name", "instrument_code", "isin"
    )


@registry.add(
    "B4_project_book",
    """
SELECT note_id, figure_code,
 coalesce(nullif(json_extract_string(doc, '$.common.commercialName'), ''), '(sem nome)') AS commercial_name,
 nullif(json_extract_string(doc, '$.common.instrumentCode'), '') AS instrument_code,
 nullif(json_extract_string(doc, '$.common.isin'), '') AS isin,
 json_extract_string(doc, '$.common.issuerAccount') AS issuer_account,
 coalesce(TRY_CAST(json_extract_string(doc, '$.common.issueDate') AS DATE), DATE '2024-01-31') AS issue_date,
 coalesce(TRY_CAST(json_extract_string(doc, '$.common.maturityDate') AS DATE), DATE '2025-01-31') AS maturity_date,
 json_extract_string(doc, '$.common.modality') AS modality,
 json_extract_string(doc, '$.underlying.assetClass') AS underlying_class,
 json_extract_string(doc, '$.underlying.asset') AS underlying,
 CAST(floor(CAST(json_extract_string(doc, '$.common.quantity') AS DECIMAL(18,4))) AS BIGINT) AS quantity,
 CAST(json_extract_string(doc, '$.common.unitIssuePrice') AS DECIMAL(28,8)) AS unit_issue_price,
 CAST(json_extract_string(doc, '$.common.notional') AS DECIMAL(28,8)) AS notional,
 'Validated' AS status
FROM {note_docs} d""",
)
def project_book(spark, sf):
    return ops.project_book(spread(spark, sf, "orders", frame(spark, sf, "note_docs")), TODAY)


@registry.add(
    "B5_grid",
    "SELECT note_id, figure_code, instrument_code, isin, commercial_name, issue_date, maturity_date, modality, "
    "asset, quantity, notional, status, updated_on FROM {book} b",
)
def grid(spark, sf):
    return ops.grid(frame(spark, sf, "book"))


@registry.add(
    "B6_apply_computed",
    "SELECT note_id, CAST(quantity * unit_issue_price AS DECIMAL(28,8)) AS notional, "
    "CAST(quantity * unit_issue_price * 2 AS DECIMAL(28,8)) AS doubled FROM {book} b",
)
def apply_computed(spark, sf):
    derived = ops.apply_computed(
        frame(spark, sf, "book"),
        [
            ("notional", "cast(quantity * unit_issue_price as decimal(28,8))"),
            ("doubled", "cast(notional * 2 as decimal(28,8))"),
        ],
    )
    return derived.select("note_id", "notional", "doubled")


@registry.add(
    "B7_seed_defaults",
    """
SELECT b.note_id, f.path, coalesce(nullif(a.value, ''), f.default_value) AS value,
       nullif(a.value, '') IS NULL AS defaulted
FROM {book} b JOIN {tpl_field} f ON b.figure_code = f.figure_code
LEFT JOIN {note_attr} a ON a.note_id = b.note_id AND a.path = f.path""",
)
def seed_defaults(spark, sf):
    return ops.seed_defaults(frame(spark, sf, "book"), frame(spark, sf, "note_attr"), frame(spark, sf, "tpl_field"))


@registry.add(
    "B9_eligible_underlyings",
    """
SELECT asset_class, code, valuation_index, pos, instrument_type, price FROM (
 SELECT asset_class, code, coalesce(nullif(trim(valuation_index), ''), code) AS valuation_index, pos,
        instrument_type, price,
        row_number() OVER (PARTITION BY asset_class, code, coalesce(nullif(trim(valuation_index), ''), code)
                           ORDER BY pos) AS rn
 FROM {underlyings} u WHERE instrument_type = 'COE' AND trim(code) <> '') r WHERE rn = 1""",
)
def eligible_underlyings(spark, sf):
    return ops.eligible_underlyings(frame(spark, sf, "underlyings"))


@registry.add(
    "B11_applicable_attributes",
    """
SELECT a.note_id, a.path, a.value FROM {note_attr} a JOIN {book} b ON a.note_id = b.note_id
WHERE coalesce(b.instrument_code > 'IF000500', false)
  AND (a.path <> 'payoff.a1' OR b.modality = 'VNP') AND (a.path <> 'payoff.a2' OR b.quantity > 250)""",
)
def applicable_attributes(spark, sf):
    facts = frame(spark, sf, "book").select("note_id", "instrument_code", "modality", "quantity")
    attributes = frame(spark, sf, "note_attr").join(facts, "note_id")
    guards = {"payoff.a1": "modality = 'VNP'", "payoff.a2": "quantity > 250"}
    shown = ops.applicable_attributes(attributes, "instrument_code > 'IF000500'", guards)
    return shown.select("note_id", "path", "value")


@registry.add(
    "C1_with_figure_name",
    "SELECT b.note_id, b.figure_code, f.figure_name FROM {book} b "
    "LEFT JOIN {figures_published} f ON b.figure_code = f.figure_code",
)
def with_figure_name(spark, sf):
    named = ops.with_figure_name(frame(spark, sf, "book"), frame(spark, sf, "figures_published"))
    return named.select("note_id", "figure_code", "figure_name")


@registry.add(
    "C3_underlying_registered",
    """
WITH e AS (SELECT DISTINCT asset_class, code FROM {underlyings} u
           WHERE instrument_type = 'COE' AND trim(code) <> ''),
n AS (SELECT l_orderkey AS note_id, l_linenumber AS row_no, p_brand AS code,
             CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'NONE' ELSE p_type END AS asset_class
      FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT note_id, row_no, code, asset_class,
       CASE WHEN asset_class IS NULL THEN code IN (SELECT code FROM e)
            ELSE EXISTS (SELECT 1 FROM e WHERE e.code = n.code AND e.asset_class = n.asset_class) END AS registered
FROM n""",
)
def underlying_registered(spark, sf):
    notes = query(
        spark,
        sf,
        "SELECT l_orderkey AS note_id, l_linenumber AS row_no, p_brand AS code, "
        "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'NONE' ELSE p_type END AS asset_class "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    )
    return ops.underlying_registered(notes, ops.eligible_underlyings(frame(spark, sf, "underlyings")))


@registry.add(
    "C4_instrument_code_taken",
    "SELECT b.note_id, b.instrument_code, EXISTS (SELECT 1 FROM {book} o WHERE o.instrument_code = b.instrument_code "
    "AND o.note_id <> b.note_id) AS taken FROM {book} b",
)
def instrument_code_taken(spark, sf):
    return ops.instrument_code_taken(frame(spark, sf, "book")).select("note_id", "instrument_code", "taken")


@registry.add(
    "C10_template_as_booked",
    """
SELECT b.note_id, b.figure_code, b.template_version AS booked_version,
       CASE WHEN t.version IS NOT NULL THEN b.template_version ELSE a.version END AS used_version,
       coalesce(t.published_on, a.published_on) AS published_on
FROM {book} b LEFT JOIN {templates} t ON t.figure_code = b.figure_code AND t.version = b.template_version
LEFT JOIN {templates} a ON a.figure_code = b.figure_code AND a.is_active""",
)
def template_as_booked(spark, sf):
    return ops.template_as_booked(frame(spark, sf, "book"), frame(spark, sf, "templates"))


@registry.add(
    "D2_underlying_picker",
    "SELECT asset_class, code, min(coalesce(nullif(trim(valuation_index), ''), code)) AS valuation_index "
    "FROM {underlyings} u WHERE instrument_type = 'COE' AND trim(code) <> '' GROUP BY 1, 2",
)
def underlying_picker(spark, sf):
    return ops.underlying_picker(ops.eligible_underlyings(frame(spark, sf, "underlyings")))


@registry.add(
    "E1_page_with_total",
    """
WITH live AS (SELECT * FROM {book} b WHERE """
    + LIVE
    + """)
SELECT l.note_id, l.figure_code, l.commercial_name, l.updated_on, f.figure_name, (SELECT count(*) FROM live) AS total
FROM (SELECT * FROM live ORDER BY updated_on DESC, note_id LIMIT 50 OFFSET 50) l
LEFT JOIN {figures_published} f ON l.figure_code = f.figure_code""",
)
def page_with_total(spark, sf):
    live = ops.live_on(frame(spark, sf, "book"), DAY)
    page = ops.page_with_total(live, frame(spark, sf, "figures_published"), page=2, size=50)
    return page.select("note_id", "figure_code", "commercial_name", "updated_on", "figure_name", "total")


CONFLICT_SQL = """
SELECT e.edit_id, e.note_id, e.base_version,
       CASE WHEN b.row_version IS NULL THEN 'missing' WHEN b.row_version <> e.base_version THEN 'conflict'
            ELSE 'saved' END AS outcome
FROM {edits} e LEFT JOIN {book} b ON b.note_id = e.note_id"""


@registry.add("G16_detect_conflicts", CONFLICT_SQL)
def detect_conflicts(spark, sf):
    edits = frame(spark, sf, "edits").select("edit_id", "note_id", "base_version")
    return ops.detect_conflicts(edits, frame(spark, sf, "book"))


@registry.add("D10_save_outcomes", f"SELECT outcome, count(*) AS n FROM ({CONFLICT_SQL}) c GROUP BY 1")
def save_outcomes(spark, sf):
    return ops.save_outcomes(detect_conflicts(spark, sf))


UPSERT_FRAMES = """
t AS (SELECT note_id, issue_date AS changed_on, notional FROM {book} b WHERE status <> 'Draft'),
c AS (SELECT CASE WHEN note_id % 2 = 0 THEN note_id ELSE -note_id END AS note_id, min(payment_date) AS changed_on, CAST(sum(amount) AS DECIMAL(28,8)) AS notional
      FROM {note_rows} r GROUP BY note_id, row_no)"""


def _stored_and_changes(spark, sf):
    def side(name):
        return query(spark, sf, f"WITH {UPSERT_FRAMES} SELECT * FROM {name}")

    return side("t"), side("c")


@registry.add(
    "A9_upsert",
    f"""
WITH {UPSERT_FRAMES}, u AS (SELECT *, 0 AS src FROM t UNION ALL SELECT *, 1 FROM c)
SELECT note_id, changed_on, notional FROM (
 SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY src DESC, changed_on DESC, notional DESC) AS rn FROM u) r
WHERE rn = 1""",
)
def upsert(spark, sf):
    target, changes = _stored_and_changes(spark, sf)
    # The amount breaks ties between changes of one day.
    keyed = [d.withColumn("_at", F.struct("changed_on", "notional")) for d in (target, changes)]
    return ops.upsert(*keyed, ["note_id"], "_at").drop("_at")


@registry.add(
    "A9_insert_only",
    f"""
WITH {UPSERT_FRAMES}, n AS (
 SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY changed_on, notional) AS rn
 FROM c WHERE note_id NOT IN (SELECT note_id FROM t))
SELECT note_id, changed_on, notional FROM t UNION ALL SELECT note_id, changed_on, notional FROM n WHERE rn = 1""",
)
def insert_only(spark, sf):
    target, changes = _stored_and_changes(spark, sf)
    keyed = [d.withColumn("_at", F.struct("changed_on", "notional")) for d in (target, changes)]
    return ops.insert_only(*keyed, ["note_id"], "_at").drop("_at")
