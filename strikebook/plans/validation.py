"""Queries over bulk validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikebook.operators import book as book_ops
from strikebook.operators import validation as v
from strikebook.plans.frames import frame, query, spread
from strikebook.plans.market import brazil
from strikebook.plans.registry import Registry

registry = Registry()
FIELDS, RULES = v.load_fields(), v.load_rules()


def documents(spark, sf):
    docs = frame(spark, sf, "note_docs").select("note_id", "figure_code", "template_version", "doc")
    return spread(spark, sf, "orders", docs)


def checks(spark, sf):
    codes = frame(spark, sf, "book").select("note_id", "instrument_code")
    return v.standard_checks(brazil(spark), codes)


def findings(spark, sf, fields=FIELDS, rules=RULES, scope="submit", **more):
    found = v.validate(documents(spark, sf), fields, rules, checks(spark, sf), scope, **more)
    return found.withColumn("finding", F.coalesce("rule_id", "check"))


SHOWN = ["note_id", "path", "finding", "severity"]

# The comparison side: the typed attributes of every document, then one condition per finding.


def _text(path):
    return f"nullif(json_extract_string(doc, '$.{path}'), '')"


def _num(path):
    return f"TRY_CAST(json_extract_string(doc, '$.{path}') AS DECIMAL(38,18))"


def _date(path):
    raw = f"json_extract_string(doc, '$.{path}')"
    return f"CASE WHEN regexp_full_match({raw}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({raw} AS DATE) END"


TYPED = f"""
SELECT note_id, figure_code, doc, {_text('common.commercialName')} AS name, {_text('common.instrumentCode')} AS code,
 {_text('common.isin')} AS isin, {_date('common.issueDate')} AS issue, {_text('common.maturityDate')} AS maturity_raw,
 {_date('common.maturityDate')} AS maturity, {_num('common.quantity')} AS quantity, {_text('common.modality')} AS modality,
 {_num('common.guaranteedCapital')} AS capital, {_text('underlying.assetClass')} AS asset_class,
 {_text('underlying.asset')} AS asset, {_text('underlying.hasLookback')} AS lookback, {_num('payoff.strike')} AS strike,
 {_text('payoff.participation')} AS participation_raw, {_num('payoff.participation')} AS participation,
 {_num('payoff.cap')} AS cap, {_num('payoff.barrierLevel')} AS barrier, {_num('payoff.rebate')} AS rebate,
 {_num('payoff.leverage')} AS leverage, {_num('payoff.digitalCoupon')} AS digital_coupon
FROM {{note_docs}} d"""
ROWS = """
SELECT note_id, i, issue, maturity,
  CAST(json_extract_string(doc, '$.observations[' || i || '].observationDate') AS DATE) AS observed,
  CAST(json_extract_string(doc, '$.observations[' || i || '].triggerLevel') AS DECIMAL(18,4)) AS trig,
  CAST(json_extract_string(doc, '$.observations[' || i || '].couponBarrier') AS DECIMAL(18,4)) AS barrier,
  CAST(json_extract_string(doc, '$.observations[' || i || '].observationCoupon') AS DECIMAL(18,4)) AS coupon
FROM (SELECT *, unnest(range(CAST(json_array_length(doc, '$.observations') AS BIGINT))) AS i FROM typed) s"""

NUMBERS = [
    ("common.quantity", "integer", "error", "quantity <> floor(quantity)"),
    ("common.quantity", "max", "error", "quantity > 450"),
    ("payoff.participation", "number", "error", "participation_raw IS NOT NULL AND participation IS NULL"),
    ("payoff.participation", "max", "error", "participation > 220"),
    ("payoff.cap", "decimals", "warning", "note_id % 17 <> 0 AND note_id % 5 = 0"),
]
NUMBER_ROWS = [("triggerLevel", "max", "error", "trig > 105")]
DATES = [
    ("common.maturityDate", "date", "error", "maturity_raw IS NOT NULL AND maturity IS NULL"),
    ("underlying.hasLookback", "boolean", "error", "lookback NOT IN ('true', 'false')"),
]
OPTIONS = [("underlying.assetClass", "option", "error", "asset_class NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')")]
LENGTHS = [("common.commercialName", "length", "error", "length(name) > 17")]
REQUIRED = [
    ("common.commercialName", "required", "error", "name IS NULL"),
    ("common.guaranteedCapital", "required", "error", "capital IS NULL AND modality = 'VNR'"),
    ("payoff.cap", "required", "error", "cap IS NULL"),
]
FIG = "figure_code = '{0}' AND "
CALL, KO, CS, DG, BO = (FIG.format(x) for x in ("COE001001", "COE001003", "COE001005", "COE001011", "COE001073"))
ALWAYS = [
    ("common.maturityDate", "common.maturity-after-issue", "error", "maturity <= issue"),
    ("common.maturityDate", "common.short-tenor", "warning", "maturity - issue < 90"),
    ("common.guaranteedCapital", "common.vnp-guaranteed-capital", "error", "modality = 'VNP' AND capital < 100"),
    ("common.guaranteedCapital", "common.vnr-guaranteed-capital", "error", "modality = 'VNR' AND NOT coalesce(capital >= 0 AND capital < 100, false)"),
    ("common.isin", "common.isin-length", "error", "isin IS NOT NULL AND length(isin) <> 12"),
]
SUBMIT = [("common.externalIdentifier", "common.identifier-recommended", "warning", "code IS NULL")]
FIGURES = [
    ("common.modality", "call.modality", "error", CALL + "modality <> 'VNP'"),
    ("payoff.participation", "call.participation-positive", "error", CALL + "participation <= 0"),
    ("payoff.participation", "call.high-participation", "warning", CALL + "participation > 200"),
    ("payoff.strike", "call.strike-away-from-atm", "info", CALL + "strike <> 100"),
    ("common.modality", "sharkfin.modality", "error", KO + "modality <> 'VNP'"),
    ("payoff.barrierLevel", "sharkfin.barrier-above-strike", "error", KO + "barrier <= strike"),
    ("payoff.rebate", "sharkfin.rebate-below-max-payoff", "warning", KO + "rebate * 100 > CAST(participation AS DOUBLE) * (barrier - strike)"),
    ("payoff.barrierLevel", "sharkfin.tight-barrier", "warning", KO + "barrier - strike < 10"),
    ("common.modality", "callspread.modality", "error", CS + "modality <> 'VNP'"),
    ("payoff.cap", "callspread.cap-positive", "error", CS + "cap <= 0"),
    ("payoff.participation", "callspread.participation-positive", "error", CS + "participation <= 0"),
    ("payoff.cap", "callspread.max-redemption", "warning", CS + "CAST(participation AS DOUBLE) * CAST(cap AS DOUBLE) > 10000"),
    ("payoff.cap", "callspread.narrow-spread", "warning", CS + "cap < 5"),
    ("common.modality", "digital.modality", "error", DG + "modality <> 'VNP'"),
    ("payoff.digitalCoupon", "digital.coupon-positive", "error", DG + "digital_coupon <= 0"),
    ("payoff.digitalCoupon", "digital.large-coupon", "warning", DG + "digital_coupon > 50"),
    ("payoff.alternativeIndexer", "digital.dual-indexer-consistency", "warning", DG + "true"),
    ("common.modality", "booster.modality", "error", BO + "modality <> 'VNR'"),
    ("payoff.leverage", "booster.leverage-above-one", "error", BO + "leverage <= 1"),
    ("payoff.cap", "booster.cap-positive", "error", BO + "cap <= 0"),
    ("payoff.cap", "booster.max-upside", "warning", BO + "CAST(leverage AS DOUBLE) * CAST(cap AS DOUBLE) > 100"),
    ("common.guaranteedCapital", "booster.downside-not-protected", "error", BO + "capital IS DISTINCT FROM 0"),
]
PER_ROW = [
    ("observationDate", "observations.within-tenor", "error", "NOT coalesce(observed > issue AND observed <= maturity, false)"),
    ("couponBarrier", "observations.coupon-needs-barrier", "error", "coupon > 0 AND barrier IS NULL"),
    ("couponBarrier", "observations.coupon-barrier-below-trigger", "warning", "barrier > trig"),
]
CAL = "(SELECT is_business_day FROM {d_calendar} c WHERE c.day = "
SERVER = [
    ("common.issueDate", "common.issue-date-business-day", "error", f"NOT {CAL}issue)"),
    ("common.maturityDate", "common.maturity-date-business-day", "error", f"NOT {CAL}maturity)"),
]
UNIQUE = [("common.instrumentCode", "common.instrument-code-unique", "error", "code IN (SELECT instrument_code FROM {book} k GROUP BY 1 HAVING count(*) > 1)")]
# A positive participation is a premise of the protected base rule, which the documents never state.


def expected(single=(), rows=(), extra=lambda path, finding, row: "true") -> str:
    """SQL of the findings whose conditions hold, one branch per condition."""
    parts = [
        f"SELECT note_id, figure_code, '{path}' AS path, '{finding}' AS finding, '{severity}' AS severity FROM typed "
        f"WHERE ({condition}) AND {extra(path, finding, False)}"
        for path, finding, severity, condition in single
    ] + [
        f"SELECT r.note_id, figure_code, 'observations[' || r.i || '].{key}' AS path, '{finding}' AS finding, "
        f"'{severity}' AS severity FROM obs r "
        f"JOIN typed t ON t.note_id = r.note_id WHERE ({condition.replace('issue', 'r.issue').replace('maturity', 'r.maturity').replace('barrier', 'r.barrier')}) "
        f"AND {extra('observations[].' + key, finding, True)}"
        for key, finding, severity, condition in rows
    ]
    return " UNION ALL ".join(parts)


def shown(single=(), rows=(), columns="note_id, path, finding, severity") -> str:
    return f"WITH typed AS ({TYPED}), obs AS ({ROWS}) SELECT {columns} FROM ({expected(single, rows)}) e"


def _fields(*kinds):
    return [f for f in FIELDS if f["type"] in kinds]


@registry.add("G1_check_numbers", shown(NUMBERS, NUMBER_ROWS))
def check_numbers(spark, sf):
    found = findings(spark, sf, _fields(*v.NUMERIC, "enum"), [])
    return found.filter(F.col("finding").isin("number", "integer", "min", "max", "decimals")).select(SHOWN)


@registry.add("G2_check_dates_booleans", shown(DATES))
def check_dates(spark, sf):
    found = findings(spark, sf, _fields("date", "boolean"), [])
    return found.filter(F.col("finding").isin("date", "boolean")).select(SHOWN)


@registry.add(
    "G3_check_options",
    f"WITH typed AS ({TYPED}) SELECT note_id, 'underlying.assetClass' AS path, 'option' AS finding, asset_class AS detail "
    f"FROM typed WHERE {OPTIONS[0][3]}",
)
def check_options(spark, sf):
    found = findings(spark, sf, _fields("enum"), [], scope="form")
    return found.select("note_id", "path", "finding", "detail")


@registry.add("G4_check_length", shown(LENGTHS))
def check_length(spark, sf):
    return findings(spark, sf, _fields("string"), [], scope="form").select(SHOWN)


@registry.add("G5_check_required", shown(REQUIRED))
def check_required(spark, sf):
    return findings(spark, sf).filter(F.col("finding") == "required").select(SHOWN)


@registry.add("G6_check_rules", shown(ALWAYS + SUBMIT + FIGURES))
def check_rules(spark, sf):
    rules = [r for r in RULES if "check" not in r and "each" not in r]
    return findings(spark, sf, rules=rules).filter(F.col("rule_id").isNotNull()).select(SHOWN)


@registry.add("G7_check_row_rules", shown(rows=PER_ROW))
def check_row_rules(spark, sf):
    rules = [r for r in RULES if "each" in r]
    return findings(spark, sf, rules=rules).filter(F.col("rule_id").isNotNull()).select(SHOWN)


@registry.add(
    "G7_row_rule_over_rows",
    """
SELECT DISTINCT r.note_id, concat('cashflows[', CAST(r.row_no AS STRING), '].paymentDate') AS path
FROM {note_rows} r JOIN {book} b ON b.note_id = r.note_id
WHERE r.weight > 1 AND NOT (r.payment_date > b.issue_date AND r.payment_date <= b.maturity_date)""",
)
def row_rule(spark, sf):
    holds = "coalesce(payment_date > issue_date, false) AND coalesce(payment_date <= maturity_date, false)"
    return v.row_rule(
        frame(spark, sf, "note_rows"), frame(spark, sf, "book"), "cashflows", "paymentDate", "weight > 1", holds
    )


@registry.add("G8_check_business_day", shown(SERVER))
def check_business_day(spark, sf):
    rules = [r for r in RULES if r.get("check") == "businessDay"]
    return findings(spark, sf, [f for f in FIELDS if f["path"].startswith("common.")], rules).filter(F.col("rule_id").isNotNull()).select(SHOWN)


def _custom(rule_id, check, args, target):
    return {"id": rule_id, "targets": [target], "check": check, "args": args, "severity": "error", "trigger": "both",
            "depends_on": [], "pt": rule_id, "en": rule_id}


def _distance(days: str) -> str:
    return (
        f"WITH typed AS ({TYPED}), counted AS (SELECT t.*, y.bd_index - x.bd_index AS du FROM typed t "
        "JOIN {d_calendar} x ON x.day = t.issue JOIN {d_calendar} y ON y.day = t.maturity) "
        f"SELECT note_id, du_path AS path FROM (SELECT *, '{{path}}' AS du_path FROM counted) c WHERE {days}"
    )


@registry.add(
    "G9_check_business_days_before",
    _distance("NOT (du BETWEEN 20 AND 500)").replace("{path}", "common.issueDate"),
)
def check_business_days_before(spark, sf):
    args = {"path": "common.issueDate", "referencePath": "common.maturityDate", "minimum": 20, "maximum": 500}
    rule = _custom("issue-before-maturity", "businessDaysBefore", args, "common.issueDate")
    return findings(spark, sf, [f for f in FIELDS if f["path"].startswith("common.")], [rule]).filter(
        F.col("rule_id").isNotNull()
    ).select("note_id", "path")


@registry.add(
    "G10_check_observation_count",
    _distance("du <> 0 AND abs(quantity - du) > greatest(1, du * 0.05)").replace("{path}", "common.quantity"),
)
def check_observation_count(spark, sf):
    args = {"countPath": "common.quantity", "startPath": "common.issueDate", "endPath": "common.maturityDate"}
    rule = _custom("count", "observationCountMatchesCalendar", args, "common.quantity")
    return findings(spark, sf, [f for f in FIELDS if f["path"].startswith("common.")], [rule]).filter(
        F.col("rule_id").isNotNull()
    ).select("note_id", "path")


@registry.add(
    "G11_check_unique_code_and_underlying",
    f"""
WITH typed AS ({TYPED}), e AS (SELECT DISTINCT asset_class AS class, code AS known FROM {{underlyings}} u
  WHERE instrument_type = 'COE' AND trim(code) <> '')
SELECT note_id, 'common.instrumentCode' AS path FROM typed WHERE {UNIQUE[0][3]}
UNION ALL
SELECT note_id, 'underlying.asset' FROM typed t WHERE CASE WHEN quantity % 2 = 0
  THEN NOT EXISTS (SELECT 1 FROM e WHERE known = 'Brand#' || asset AND class = 'ECONOMY')
  ELSE NOT EXISTS (SELECT 1 FROM e WHERE known = 'Brand#' || asset) END""",
)
def check_unique_code(spark, sf):
    eligible = book_ops.eligible_underlyings(frame(spark, sf, "underlyings"))
    known = v.standard_checks(brazil(spark), frame(spark, sf, "book").select("note_id", "instrument_code"), eligible)
    args = {
        "path": "concat('Brand#', underlying.asset)",
        "classPath": "CASE WHEN common.quantity % 2 = 0 THEN 'ECONOMY' END",
    }
    rules = [r for r in RULES if r.get("check") == "uniqueInstrumentCode"]
    rules.append(_custom("registered", "underlyingRegistered", args, "underlying.asset"))
    fields = [f for f in FIELDS if f["path"].split(".")[0] in ("common", "underlying")]
    found = v.validate(documents(spark, sf), fields, rules, known)
    return found.filter(F.col("rule_id").isNotNull()).select("note_id", "path")


EVERY = NUMBERS + DATES + OPTIONS + LENGTHS + REQUIRED + ALWAYS + SUBMIT + FIGURES + SERVER + UNIQUE
EVERY_ROW = NUMBER_ROWS + PER_ROW


@registry.add("G0_validate", shown(EVERY, EVERY_ROW))
def validate(spark, sf):
    return findings(spark, sf).select(SHOWN)


@registry.add("G12_scope_form", shown(NUMBERS + DATES + OPTIONS + LENGTHS + ALWAYS + FIGURES + SERVER, EVERY_ROW))
def scope_form(spark, sf):
    return findings(spark, sf, scope="form").select(SHOWN)


CHANGED = """
SELECT note_id, list(DISTINCT path) AS exact, list(DISTINCT regexp_replace(path, '\\[[0-9]+\\]', '[]')) AS general,
       list(DISTINCT regexp_extract(path, '^[a-z]+')) AS sections
FROM {edits} e GROUP BY 1"""


def _reached(path, finding, row):
    rule = next((r for r in RULES if r["id"] == finding), None)
    if rule is None:
        if row:
            return "list_contains(exact, 'observations[' || r.i || '].' || '" + path.split(".")[1] + "')"
        needs = [path] + (["common.modality"] if path == "common.guaranteedCapital" else [])
        return f"list_has_any(general, {needs})"
    needs = rule["depends_on"]
    sections = [d for d in needs if "." not in d]
    reached = [f"list_has_any(general, {needs + rule['targets']})"] if needs else [f"list_has_any(general, {rule['targets']})"]
    if sections:
        reached.append(f"list_has_any(sections, {sections})")
    return "(" + " OR ".join(reached) + ")"


def _edited_notes(spark, sf):
    # A note has at most as many distinct paths as its template.
    paths = frame(spark, sf, "edits").groupBy("note_id").agg(F.collect_set("path").alias("changed"))
    return documents(spark, sf).join(paths, "note_id")


@registry.add(
    "G12_scope_field",
    f"""
WITH changed AS ({CHANGED}), typed AS (SELECT t.*, c.exact, c.general, c.sections FROM ({TYPED}) t JOIN changed c ON c.note_id = t.note_id),
obs AS ({ROWS})
SELECT note_id, path, finding, severity FROM ({expected(
    NUMBERS + DATES + OPTIONS + LENGTHS + REQUIRED + ALWAYS + FIGURES + SERVER, EVERY_ROW, _reached)}) e""",
)
def scope_field(spark, sf):
    found = v.validate(_edited_notes(spark, sf), FIELDS, RULES, checks(spark, sf), "field", changed="changed")
    return found.withColumn("finding", F.coalesce("rule_id", "check")).select(SHOWN)


@registry.add(
    "G13_dedupe_findings",
    shown(ALWAYS, columns="note_id, path, finding"),
)
def dedupe_findings(spark, sf):
    rules = [r for r in RULES if r["id"] in {x[1] for x in ALWAYS}]
    found = v.localise(findings(spark, sf, [f for f in FIELDS if f["path"].startswith("common.")], rules), "pt-BR")
    twice = found.filter(F.col("rule_id").isNotNull())
    twice = twice.unionByName(twice)
    return v.dedupe_findings(twice).select("note_id", "path", F.col("rule_id").alias("finding"))


@registry.add(
    "G14_evaluated_paths",
    f"""
WITH changed AS ({CHANGED}),
d AS (SELECT n.note_id, n.figure_code, n.modality_known, c.general, c.sections, c.exact, n.rows_n FROM (
  SELECT note_id, figure_code, true AS modality_known, CAST(json_array_length(doc, '$.observations') AS BIGINT) AS rows_n FROM {{note_docs}} x) n
  JOIN changed c ON c.note_id = n.note_id)
SELECT DISTINCT note_id, path FROM (
 {' UNION ALL '.join(
   f"SELECT note_id, '{t}' AS path FROM d WHERE "
   + (f"figure_code IN ({', '.join(repr(x) for x in r['figures'])}) AND " if r.get('figures') else '')
   + _reached(t, r['id'], False)
   for r in RULES if not r.get('each') and r['trigger'] != 'submit' for t in r['targets'])}
 UNION ALL
 {' UNION ALL '.join(f"SELECT note_id, '{f['path']}' FROM d WHERE {_reached(f['path'], None, False)}" for f in FIELDS if '[]' not in f['path'])}
 UNION ALL
 {' UNION ALL '.join(
   f"SELECT note_id, 'observations[' || i || '].{k}' FROM (SELECT *, unnest(range(rows_n)) AS i FROM d) z WHERE {_reached('observations[].' + k, i_d, False)}"
   for k, i_d in [(r['targets'][0].split('.')[1], r['id']) for r in RULES if r.get('each') == 'observations']
   + [(f['path'].split('.')[1], None) for f in FIELDS if f['path'].startswith('observations[]')])}
) p""",
)
def evaluated_paths(spark, sf):
    return v.evaluated_paths(_edited_notes(spark, sf), FIELDS, RULES, checks(spark, sf), "field", "changed")


DECISIONS = f"""
WITH typed AS ({TYPED}), obs AS ({ROWS}), found AS ({expected(EVERY, EVERY_ROW)}),
counts AS (SELECT note_id, count(*) FILTER (severity = 'error') AS errors,
                  count(*) FILTER (severity = 'warning') AS warnings FROM found GROUP BY 1)
SELECT b.note_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
  CASE WHEN b.status = 'Draft' AND b.figure_code = 'COE001011' THEN 'figure not enabled'
       WHEN coalesce(errors, 0) > 0 THEN 'rejected'
       WHEN coalesce(warnings, 0) > 0 AND b.row_version % 2 <> 0 THEN 'needs acceptance' ELSE 'saved' END AS decision
FROM {{book}} b LEFT JOIN counts c ON c.note_id = b.note_id"""


@registry.add("G15_booking_decision", DECISIONS)
def booking_decision(spark, sf):
    notes = frame(spark, sf, "book").select(
        "note_id",
        (F.col("status") == "Draft").alias("is_new"),
        (F.col("row_version") % 2 == 0).alias("accepts_warnings"),
        (F.col("figure_code") != "COE001011").alias("figure_enabled"),
    )
    return v.booking_decision(notes, findings(spark, sf)).select("note_id", "errors", "warnings", "decision")


@registry.add(
    "G17_localise",
    f"""
WITH typed AS ({TYPED})
SELECT note_id, 'underlying.assetClass' AS path, 'Asset class: ''' || asset_class || ''' is no option.' AS message
FROM typed WHERE {OPTIONS[0][3]}
UNION ALL SELECT note_id, 'common.modality', 'Modality: fill in this field.' FROM typed WHERE modality IS NULL
UNION ALL SELECT note_id, 'common.maturityDate', 'The tenor is under 90 days.' FROM typed WHERE maturity - issue < 90""",
)
def localise(spark, sf):
    rules = [r for r in RULES if r["id"] == "common.short-tenor"]
    fields = _fields("enum") + [{**f, "required": False} for f in FIELDS if f["path"] in ("common.issueDate", "common.maturityDate")]
    found = findings(spark, sf, fields, rules).filter(F.coalesce(F.col("check") != "date", F.lit(True)))
    return v.localise(found, "en-US").select("note_id", "path", "message")


@registry.add(
    "D9_findings_summary",
    f"WITH typed AS ({TYPED}), obs AS ({ROWS}) SELECT figure_code, severity, "
    "CASE WHEN finding NOT LIKE '%.%' THEN 'field' WHEN finding LIKE '%business-day' OR finding LIKE '%code-unique' "
    f"THEN 'server' ELSE 'rule' END AS origin, count(*) AS n FROM ({expected(EVERY, EVERY_ROW)}) e GROUP BY 1, 2, 3",
)
def findings_summary(spark, sf):
    return v.findings_summary(findings(spark, sf))


# Rows as tables

@registry.add(
    "D4_row_aggregates",
    """
SELECT note_id, count(*) AS n_rows, CAST(sum(amount) AS DECIMAL(28,8)) AS total, bool_or(amount > 90000) AS any_above,
       bool_and(amount > 90000) AS all_above, count(DISTINCT payment_date) = count(*) AS is_distinct
FROM {note_rows} r GROUP BY 1""",
)
def row_aggregates(spark, sf):
    rows = v.row_aggregates(frame(spark, sf, "note_rows"), "amount", 90000, "payment_date")
    return rows.withColumn("total", F.col("total").cast("decimal(28,8)"))


@registry.add(
    "D4_array_aggregates",
    f"""
WITH typed AS ({TYPED}), obs AS ({ROWS})
SELECT t.note_id, CAST(count(r.i) AS INT) AS n_rows, CAST(coalesce(sum(r.trig), 0) AS DECIMAL(28,8)) AS total,
       coalesce(bool_or(r.trig > 100), false) AS any_above, coalesce(bool_and(r.trig > 100), true) AS all_above,
       count(DISTINCT r.observed) = count(r.i) AS is_distinct
FROM typed t LEFT JOIN obs r ON r.note_id = t.note_id GROUP BY 1""",
)
def array_aggregates(spark, sf):
    notes = v.read_notes(documents(spark, sf), FIELDS)
    result = v.array_aggregates(notes, "observations", "triggerLevel", 100, "observationDate")
    return result.withColumn("total", F.col("total").cast("decimal(28,8)"))


@registry.add(
    "D5_row_count_bounds",
    """
SELECT note_id, n_rows, CASE WHEN n_rows < 2 THEN 'min_rows' ELSE 'max_rows' END AS "check" FROM (
 SELECT b.note_id, count(r.note_id) AS n_rows FROM {book} b LEFT JOIN {note_rows} r ON r.note_id = b.note_id GROUP BY 1) c
WHERE n_rows < 2 OR n_rows > 6""",
)
def row_count_bounds(spark, sf):
    return v.row_count_bounds(frame(spark, sf, "book"), frame(spark, sf, "note_rows"), 2, 6)


def _pairs(kind: str) -> str:
    listed = [(r["id"], x) for r in RULES for x in r["depends_on" if kind == "dependency" else "targets"]]
    return f"(VALUES {', '.join(str(p) for p in listed)}) AS {kind}_list(rule_id, {kind})"


@registry.add(
    "C16_impacted_rules",
    f"""
WITH e AS (SELECT edit_id, path, regexp_replace(path, '\\[[0-9]+\\]', '[]') AS general,
                  regexp_extract(path, '^[a-z]+') AS section FROM {{edits}} x)
SELECT DISTINCT edit_id, rule_id FROM (
 SELECT edit_id, rule_id FROM e JOIN {_pairs('dependency')} ON dependency = general
 UNION ALL SELECT edit_id, rule_id FROM e JOIN {_pairs('dependency')} ON dependency = section
 UNION ALL SELECT edit_id, rule_id FROM e JOIN {_pairs('target')} ON target = path) i""",
)
def impacted_rules(spark, sf):
    dependencies = spark.sql(f"SELECT * FROM {_pairs('dependency')}")
    targets = spark.sql(f"SELECT * FROM {_pairs('target')}")
    return v.impacted_rules(frame(spark, sf, "edits").select("edit_id", "path"), dependencies, targets)


RULE_TABLE = """
SELECT p_partkey AS pos, concat(p_name, CAST(p_partkey % 900 AS STRING)) AS rule_id,
       CASE WHEN p_size % 5 = 0 THEN '' ELSE 'x > 0' END AS assert, CASE WHEN p_size % 4 = 0 THEN 'c' END AS check_name,
       CASE WHEN p_size % 11 = 0 THEN '' ELSE p_type END AS message, CASE WHEN p_size % 13 = 0 THEN NULL ELSE 'a.b' END AS target,
       p_brand AS section
FROM {part}"""
# Sections of every part; a third of the names is not used by rules.
SECTION_TABLE = "SELECT DISTINCT CASE WHEN p_brand LIKE '%3' THEN concat(p_brand, ' old') ELSE p_brand END AS section FROM {part}"


@registry.add(
    "G18_rule_lint",
    f"""
WITH r AS ({RULE_TABLE}), s AS ({SECTION_TABLE}),
f AS (SELECT *, nullif(assert, '') IS NOT NULL AS a, nullif(check_name, '') IS NOT NULL AS k FROM r)
SELECT rule_id, pos, 'both assert and check' AS problem FROM f WHERE a AND k
UNION ALL SELECT rule_id, pos, 'neither assert nor check' FROM f WHERE NOT a AND NOT k
UNION ALL SELECT rule_id, pos, 'no message' FROM f WHERE message = ''
UNION ALL SELECT rule_id, pos, 'no target' FROM f WHERE target IS NULL
UNION ALL SELECT rule_id, pos, 'unknown section' FROM f WHERE section NOT IN (SELECT section FROM s)
UNION ALL SELECT rule_id, pos, 'repeated id' FROM f WHERE rule_id IN (SELECT rule_id FROM f GROUP BY 1 HAVING count(*) > 1)""",
)
def rule_lint(spark, sf):
    rules = query(spark, sf, RULE_TABLE).withColumnRenamed("check_name", "check")
    return v.rule_lint(rules, query(spark, sf, SECTION_TABLE))
