"""Bulk validation of notes against fields and rules held as data.

A pass is one projection per note: every check that fails puts a small (rule number, row, value)
entry in an array, and only those entries are exploded. Notes are not shuffled, so a figure
that holds most of the book is no hot key. What an entry means (path, text, severity) is looked
up afterwards in a table as long as the rule list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikebook.functions import values
from strikebook.functions.dedupe import first_wins
from strikebook.functions.truth import decided
from strikebook.operators.book import instrument_code_taken, underlying_registered
from strikebook.operators.calendar import Calendar, business_days_between, is_business_day

NUMERIC = ("integer", "decimal", "percent", "money")
SECTIONS = "common|underlying|remuneration|terms|deposit|payoff|barriers|autocall|observations|cashflows|basket"
HIT = "array<struct<code:int,row:int,value:string>>"

# Wording of the field checks; {0} is the label, {1} the limit or the value.
TEXTS = {
    "required": ("{0}: preencha este campo.", "{0}: fill in this field."),
    "number": ("{0}: informe um número.", "{0}: give a number."),
    "integer": ("{0}: informe um número inteiro.", "{0}: give a whole number."),
    "min": ("{0}: o mínimo é {1}.", "{0}: the minimum is {1}."),
    "max": ("{0}: o máximo é {1}.", "{0}: the maximum is {1}."),
    "decimals": ("{0}: são {1} casas decimais.", "{0}: {1} decimal places are kept."),
    "date": ("{0}: informe uma data.", "{0}: give a date."),
    "boolean": ("{0}: informe sim ou não.", "{0}: give yes or no."),
    "option": ("{0}: '{1}' não é opção.", "{0}: '{1}' is no option."),
    "length": ("{0}: no máximo {1} caracteres.", "{0}: at most {1} characters."),
    "min_rows": ("{0}: pelo menos {1} linhas.", "{0}: at least {1} rows."),
    "max_rows": ("{0}: no máximo {1} linhas.", "{0}: at most {1} rows."),
}


def load_fields() -> list[dict]:
    return json.loads(files("strikebook").joinpath("data/fields.json").read_text("utf-8"))


def load_rules() -> list[dict]:
    rules = json.loads(files("strikebook").joinpath("data/rules.json").read_text("utf-8"))
    for rule in rules:
        rule.setdefault("depends_on", _dependencies(rule))
    return rules


def _dependencies(rule: dict) -> list[str]:
    """Attributes and sections a rule reads, from the names its predicates spell out."""
    text = f"{rule.get('when') or ''} {rule.get('assert') or ''}"
    found = {f"{s}.{k}" for s, k in re.findall(rf"\b({SECTIONS})\.(\w+)", text)}
    found |= set(re.findall(rf"[(,]\s*({SECTIONS})\s*[,)]", text))
    if rule.get("each"):
        found |= {f"{rule['each']}[].{k}" for k in re.findall(r"\br\.(\w+)", text)}
    found |= {v for k, v in (rule.get("args") or {}).items() if k.lower().endswith("path")}
    return sorted(found)


# Typed notes

def _by_section(fields: list[dict]) -> dict[str, list[tuple[str, dict]]]:
    sections: dict[str, list[tuple[str, dict]]] = {}
    for f in fields:
        section, key = f["path"].split(".", 1)
        sections.setdefault(section, []).append((key, f))
    return sections


def _schema(sections: dict[str, list[tuple[str, dict]]], numbers_only: bool) -> str:
    parts = []
    for section, members in sections.items():
        kept = [(k, f) for k, f in members if not numbers_only or f["type"] in NUMERIC]
        if not kept:
            continue
        inner = ",".join(f"`{k}`:{values.NUMBER if numbers_only else 'string'}" for k, _ in kept)
        struct = f"struct<{inner}>"
        parts.append(f"`{section[:-2]}` array<{struct}>" if section.endswith("[]") else f"`{section}` {struct}")
    return ", ".join(parts)


def _typed_sql(data_type: str, raw: str, number: str) -> str:
    """SQL of a typed attribute from its text and, for numbers, its exact parse."""
    if data_type in NUMERIC:
        return number
    if data_type == "date":
        return f"CASE WHEN {raw} RLIKE '{values.DATE_FORM_SQL}' THEN try_cast({raw} AS DATE) END"
    if data_type == "boolean":
        return (
            f"CASE WHEN lower({raw}) = 'true' THEN true WHEN lower({raw}) = 'false' THEN false "
            f"ELSE try_cast({raw} AS DECIMAL(38,18)) <> 0 END"
        )
    return raw


def _computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later expressions read as values, not as copies of their formula.

    Catalyst merges neighbouring projections, which would parse a document again for every
    attribute a rule reads. A one-element explode keeps the two projections apart; it only passes on what
    the projection below it made, as a formula inside a generator is interpreted row by row.
    """
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    made = df.select("*", packed.alias("_made"))
    return made.select(*df.columns, F.explode(F.array("_made")).alias("_once")).select(*df.columns, "_once.*")


def read_notes(notes: DataFrame, fields: list[dict]) -> DataFrame:
    """One struct column per section with typed attributes, and ``raw_<section>`` with their texts.

    Expects the JSON text in ``doc``. It is parsed with a declared schema: once as texts, once with
    the numbers as exact decimals (a text would pass them through a double). A value of the wrong
    kind is null in the typed column and kept in the raw one. Repeating sections become arrays.
    """
    sections = _by_section(fields)
    parses = {"_raw": F.from_json("doc", _schema(sections, False))}
    numbers = _schema(sections, True)
    if numbers:
        parses["_num"] = F.from_json("doc", numbers)
    parsed = _computed_once(notes, parses)
    columns = {}
    for section, members in sections.items():
        has_numbers = any(f["type"] in NUMERIC for _, f in members)
        name = section.removesuffix("[]")
        columns[f"raw_{name}"] = F.col(f"_raw.{name}")
        if section.endswith("[]"):
            built = ", ".join(f"'{k}', {_typed_sql(f['type'], f'a.{k}', f'b.{k}')}" for k, f in members)
            other = f"_num.{name}" if has_numbers else f"_raw.{name}"
            columns[name] = F.expr(f"zip_with(_raw.{name}, {other}, (a, b) -> named_struct({built}))")
        else:
            built = ", ".join(
                f"'{k}', {_typed_sql(f['type'], f'_raw.{name}.{k}', f'_num.{name}.{k}')}" for k, f in members
            )
            columns[name] = F.expr(f"named_struct({built})")
    return _computed_once(parsed, columns).drop("_raw", "_num")


def with_section_texts(notes: DataFrame, fields: list[dict]) -> DataFrame:
    """The text of the flat sections that limit decimals: only there do written zeros survive."""
    sections = sorted({f["path"].split(".")[0] for f in fields if "decimals" in f and "[]" not in f["path"]})
    if not sections:
        return notes
    # An object of scalars, whose quoted texts may hold braces; possessive, so it never backtracks.
    flat_object = r'\{(?:[^{}"]++|"(?:[^"\\]++|\\.)*+")*+\}'
    return _computed_once(
        notes, {f"text_{s}": F.regexp_extract("doc", rf'"{s}"\s*:\s*({flat_object})', 1) for s in sections}
    )


# What a finding number means

@dataclass
class Meanings:
    """Finding numbers handed out while a pass is put together; bounded by the rule list."""

    rows: list[tuple] = field(default_factory=list)

    def code(self, path, rule_id, check, severity, origin, pt, en, label_pt=None, label_en=None, limit=None) -> int:
        self.rows.append((len(self.rows), path, rule_id, check, severity, origin, pt, en, label_pt, label_en, limit))
        return len(self.rows) - 1

    def field(self, f: dict, check: str, severity: str = "error", limit=None) -> int:
        pt, en = TEXTS[check]
        limit = None if limit is None else str(limit)
        return self.code(f["path"], None, check, severity, "field", pt, en, f["pt"], f["en"], limit)

    def table(self, spark: SparkSession) -> DataFrame:
        schema = (
            "code int, path string, rule_id string, check string, severity string, origin string, "
            "pt string, en string, label_pt string, label_en string, limit string"
        )
        return F.broadcast(spark.createDataFrame(self.rows, schema))


def _hit(code: int, row: str = "NULL", value: str = "NULL") -> str:
    return f"named_struct('code', {code}, 'row', CAST({row} AS INT), 'value', CAST({value} AS STRING))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NO_HITS = f"CAST(array() AS {HIT})"


# Field checks. Conditions are SQL texts: a pass has hundreds, and parsing one text per group is
# much cheaper than building them as column objects.

def value_checks(f: dict, raw: str, typed: str, m: Meanings) -> list[tuple[str, int, bool]]:
    """(failed, code, quotes its value) of every check on a value that is present."""
    kind, found = f["type"], []
    if kind in NUMERIC:
        found.append((f"{typed} IS NULL", m.field(f, "number"), False))
        if kind == "integer":
            found.append((f"{typed} <> floor({typed})", m.field(f, "integer"), False))
        if "min" in f:
            found.append((f"{typed} < {f['min']}", m.field(f, "min", limit=f["min"]), False))
        if "max" in f:
            found.append((f"{typed} > {f['max']}", m.field(f, "max", limit=f["max"]), False))
        if "decimals" in f and "[]" not in f["path"]:
            section, key = f["path"].split(".")
            extra = f"{typed} IS NOT NULL AND {values.written_scale(f'text_{section}', key)} > {f['decimals']}"
            found.append((extra, m.field(f, "decimals", "warning", f["decimals"]), False))
    elif kind == "date":
        found.append((f"{typed} IS NULL", m.field(f, "date"), False))
    elif kind == "boolean":
        found.append((f"{typed} IS NULL", m.field(f, "boolean"), False))
    elif kind == "enum" and f.get("options"):
        listed = ", ".join(_quoted(o) for o in f["options"])
        found.append((f"{raw} NOT IN ({listed})", m.field(f, "option"), True))
    elif kind in ("string", "text") and "max_length" in f:
        found.append((f"char_length({raw}) > {f['max_length']}", m.field(f, "length", limit=f["max_length"]), False))
    return found


def _members_hits(f: dict, raw: str, m: Meanings, row: str = "NULL") -> str:
    """One entry per member of an enum set that is no option."""
    listed = ", ".join(_quoted(o) for o in f["options"])
    wrong = f"array_except(from_json({raw}, 'array<string>'), array({listed}))"
    return f"coalesce(transform({wrong}, y -> {_hit(m.field(f, 'option'), row, 'y')}), {NO_HITS})"


def _present(f: dict, raw: str) -> str:
    """An empty text is absent, and so is a set without members."""
    given = f"nullif({raw}, '') IS NOT NULL"
    return f"{given} AND replace({raw}, ' ', '') <> '[]'" if f["type"] == "enumset" else given


def _in_row(condition: str) -> str:
    """A condition that reads its own row as ``r``, inside the pass over rows."""
    return re.sub(r"\br\.(\w+)", r"x.typed.\1", condition)


def field_hits(fields: list[dict], m: Meanings, scope: str, narrow: bool) -> tuple[list[str], list[str]]:
    """Entries of the failed field checks of single and of repeating sections."""
    single, arrays = [], []
    for f in fields:
        section, key = f["path"].split(".", 1)
        ask = f"coalesce({field_touched(f)}, false)" if narrow else "true"
        if f.get("visible_when"):
            ask += f" AND coalesce({f['visible_when']}, false)"
        required = scope != "form" and (f.get("required") or f.get("required_when"))
        if not section.endswith("[]"):
            raw, typed = f"raw_{section}.{key}", f"{section}.{key}"
            present = _present(f, raw)
            if f["type"] == "enumset" and f.get("options"):
                arrays.append(f"CASE WHEN {ask} AND {present} THEN {_members_hits(f, raw, m)} ELSE {NO_HITS} END")
            for failed, code, quoted in value_checks(f, raw, typed, m):
                if quoted:
                    entry = f"array({_hit(code, value=raw)})"
                    arrays.append(f"CASE WHEN {ask} AND {present} AND ({failed}) THEN {entry} ELSE {NO_HITS} END")
                else:
                    single.append(f"CASE WHEN {ask} AND {present} AND ({failed}) THEN {code} END")
            if required:
                needed = "true" if f.get("required") else f"coalesce({f['required_when']}, false)"
                code = m.field(f, "required")
                single.append(f"CASE WHEN {ask} AND NOT ({present}) AND {needed} THEN {code} END")
            continue
        name = section[:-2]
        present, edited = _present(f, f"x.raw.{key}"), "true"
        if narrow:
            # As-you-type, only the row that was edited is spoken about.
            edited = f"array_contains(_exact, concat('{name}[', CAST(i AS STRING), '].{key}'))"
        entries = [
            f"CASE WHEN {edited} AND {present} AND ({failed}) THEN "
            f"{_hit(code, 'i', f'x.raw.{key}' if quoted else 'NULL')} END"
            for failed, code, quoted in value_checks(f, f"x.raw.{key}", f"x.typed.{key}", m)
        ]
        if required:
            needed = "true" if f.get("required") else f"coalesce({_in_row(f['required_when'])}, false)"
            entries.append(f"CASE WHEN {edited} AND NOT ({present}) AND {needed} THEN {_hit(m.field(f, 'required'), 'i')} END")
        pairs = f"zip_with(raw_{name}, {name}, (a, b) -> named_struct('raw', a, 'typed', b))"
        if f["type"] == "enumset" and f.get("options"):
            members = f"CASE WHEN {edited} AND {present} THEN {_members_hits(f, f'x.raw.{key}', m, 'i')} ELSE {NO_HITS} END"
            arrays.append(f"CASE WHEN {ask} THEN coalesce(flatten(transform({pairs}, (x, i) -> {members})), {NO_HITS}) ELSE {NO_HITS} END")
        if entries:
            rows = f"flatten(transform({pairs}, (x, i) -> array_compact(array({', '.join(entries)}))))"
            arrays.append(f"CASE WHEN {ask} THEN coalesce({rows}, {NO_HITS}) ELSE {NO_HITS} END")
    return single, arrays


# Rules

def _row_path(target: str, row: Column) -> Column:
    return F.replace(F.lit(target), F.lit("[]"), F.concat(F.lit("["), row.cast("string"), F.lit("]")))


def in_scope(rules: list[dict], scope: str, known_checks: set[str]) -> list[dict]:
    """Rules a pass runs: no client-only ones, no unknown check, and submit-only ones on submit."""
    return [
        r
        for r in rules
        if r.get("execution") != "client"
        and (scope == "submit" or r["trigger"] in ("change", "both"))
        and ("check" not in r or r["check"] in known_checks)
    ]


def rule_hits(
    rules: list[dict], m: Meanings, facts: dict[str, str], narrow: bool
) -> dict[tuple, tuple[list[str], list[str]]]:
    """Entries of rules that are decided false under a true guard, by figure."""
    groups: dict[tuple, tuple[list, list]] = {}
    for r in rules:
        single, arrays = groups.setdefault(tuple(r.get("figures") or ()), ([], []))
        origin = "server" if "check" in r else "rule"
        codes = [
            m.code(t, r["id"], None, r["severity"], origin, r.get("pt"), r.get("en") or r.get("pt"))
            for t in r["targets"] or [""]
        ]
        asked = f"coalesce({rule_touched(r)}, false)" if narrow else "true"
        guard = f"coalesce({r['when']}, false)" if r.get("when") else "true"
        holds = facts[r["id"]] if "check" in r else r["assert"]
        fails = f"{asked} AND {guard} AND NOT ({holds})"
        entries = [f"CASE WHEN {fails} THEN {_hit(c, 'i') if r.get('each') else c} END" for c in codes]
        if r.get("each"):
            rows = f"flatten(transform({r['each']}, (r, i) -> array_compact(array({', '.join(entries)}))))"
            arrays.append(f"coalesce({rows}, {NO_HITS})")
        else:
            single += entries
    return groups


def _joined(single: list[str], arrays: list[str]) -> tuple[str, str]:
    """SQL of the finding numbers of single checks (nulls where they pass) and of the row entries."""
    codes = f"array({', '.join(single)})" if single else "CAST(array() AS array<int>)"
    return codes, (f"concat({', '.join(arrays)})" if arrays else NO_HITS)


# Named checks

Check = Callable[[DataFrame, dict, str], DataFrame]


class Checks:
    """Reference-data checks by name: each adds one true/false/null column through joins.

    What a check joins by the note alone, it may join ``early``: before documents are parsed, when rows are short.
    """

    def __init__(self) -> None:
        self.known: dict[str, Check] = {}
        self.early: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, check: Check, early: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.known[name] = check
        self.early.pop(name, None)
        if early is not None:
            self.early[name] = early


def standard_checks(calendar: Calendar, book: DataFrame | None = None, eligible: DataFrame | None = None) -> Checks:
    checks = Checks()

    def business_day(notes, args, out):
        return is_business_day(notes.withColumn("_d", F.expr(args["path"])), "_d", calendar, out).drop("_d")

    def days_before(notes, args, out):
        dated = notes.withColumn("_a", F.expr(args["path"])).withColumn("_b", F.expr(args["referencePath"]))
        counted = business_days_between(dated, "_a", "_b", calendar, "_n")
        low, high = int(args.get("minimum", 0)), int(args.get("maximum", 2**31 - 1))
        return counted.withColumn(out, F.col("_n").between(low, high)).drop("_a", "_b", "_n")

    def observation_count(notes, args, out):
        dated = notes.withColumn("_a", F.expr(args["startPath"])).withColumn("_b", F.expr(args["endPath"]))
        counted = business_days_between(dated, "_a", "_b", calendar, "_n")
        # Fixed value: the count may differ by five per cent, and by one at least.
        allowed = F.greatest(F.lit(1).cast("decimal(20,4)"), F.col("_n") * F.lit("0.05").cast("decimal(3,2)"))
        near = F.abs(F.expr(args["countPath"]) - F.col("_n")) <= allowed
        return counted.withColumn(out, F.when(F.col("_n") != 0, near)).drop("_a", "_b", "_n")

    checks.register("businessDay", business_day)
    checks.register("businessDaysBefore", days_before)
    checks.register("observationCountMatchesCalendar", observation_count)
    if book is not None:

        def taken_codes(notes):
            taken = instrument_code_taken(book).select("note_id", F.col("taken").alias("_taken"))
            return notes.join(taken, "note_id", "left")

        def unique_code(notes, args, out):
            return notes.withColumn(out, F.when(values.present(F.expr(args["path"])).isNotNull(), ~F.col("_taken")))

        checks.register("uniqueInstrumentCode", unique_code, taken_codes)
    if eligible is not None:

        def registered(notes, args, out):
            keyed = notes.withColumn("code", F.expr(args["path"])).withColumn("asset_class", F.expr(args["classPath"]))
            found = underlying_registered(keyed, eligible)
            known = F.when(values.present(F.col("code")).isNotNull(), F.col("registered"))
            return found.withColumn(out, known).drop("code", "asset_class", "registered")

        checks.register("underlyingRegistered", registered)
    return checks


def with_early_joins(notes: DataFrame, rules: list[dict], checks: Checks) -> DataFrame:
    """Join once what the named checks look up by the note alone."""
    for name in dict.fromkeys(r["check"] for r in rules if "check" in r):
        if name in checks.early:
            notes = checks.early[name](notes)
    return notes


def with_facts(notes: DataFrame, rules: list[dict], checks: Checks) -> tuple[DataFrame, dict[str, str]]:
    """Join every check the rules name once per distinct (check, arguments); early joins have been made."""
    columns: dict[tuple, str] = {}
    facts: dict[str, str] = {}
    for r in rules:
        if "check" not in r:
            continue
        key = (r["check"], json.dumps(r.get("args") or {}, sort_keys=True))
        if key not in columns:
            columns[key] = f"_fact_{len(columns)}"
            notes = checks.known[r["check"]](notes, r.get("args") or {}, columns[key])
        facts[r["id"]] = columns[key]
    return notes, facts


# Changed attributes

def with_changes(notes: DataFrame, changed: str) -> DataFrame:
    """Prepare an array of changed paths: as written, with row numbers dropped, and the sections."""
    return notes.withColumns(
        {
            "_exact": F.col(changed),
            "_general": F.transform(changed, lambda p: F.regexp_replace(p, r"\[\d+\]", "[]")),
            "_sections": F.transform(changed, lambda p: F.regexp_extract(p, r"^\w+", 0)),
        }
    )


def _overlaps(column: str, wanted: list[str]) -> str:
    return f"arrays_overlap({column}, array({', '.join(_quoted(w) for w in wanted)}))" if wanted else "false"


def rule_touched(rule: dict) -> str:
    """SQL: a change meets what the rule reads, or one of its targets was itself changed."""
    needs = rule["depends_on"]
    sections = [d for d in needs if "." not in d]
    target = "_general" if rule.get("each") else "_exact"
    return f"({_overlaps('_general', needs)} OR {_overlaps('_sections', sections)} OR {_overlaps(target, rule['targets'])})"


def field_touched(f: dict) -> str:
    """SQL: a field was changed itself, or something its conditions read was."""
    path = f["path"]
    inner = f"exists(_general, p -> startswith(p, '{path}.') OR startswith(p, '{path}['))"
    needs = _dependencies({"when": f.get("visible_when"), "assert": f.get("required_when")})
    return f"({_overlaps('_general', [path, *needs])} OR {inner})"


# The pass

def validate(
    notes: DataFrame, fields: list[dict], rules: list[dict], checks: Checks, scope: str = "submit",
    changed: str | None = None, bounds: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Findings of one pass: (note_id, figure_code, path, rule_id, check, severity, origin, texts).

    ``scope`` is submit, form (nothing is "required" yet, no submit-only rule) or field (only what
    the paths in column ``changed`` reach). A rule speaks only when it is decided false.
    ``bounds`` gives the least and most rows of repeating sections.
    """
    m = Meanings()
    running = in_scope(rules, scope, set(checks.known))
    joined = with_early_joins(notes, running, checks)
    typed, facts = with_facts(with_section_texts(read_notes(joined, fields), fields), running, checks)
    narrow = scope == "field"
    if narrow:
        typed = with_changes(typed, changed)
    single, arrays = field_hits(fields, m, scope, narrow)
    for section, (least, most) in (bounds or {}).items():
        f = {"path": section, "pt": section, "en": section}
        rows = f"coalesce(size({section}), 0)"
        asked = f"array_contains(_sections, '{section}')" if narrow else "true"
        single.append(f"CASE WHEN {asked} AND {rows} < {least} THEN {m.field(f, 'min_rows', limit=least)} END")
        single.append(f"CASE WHEN {asked} AND {rows} > {most} THEN {m.field(f, 'max_rows', limit=most)} END")
    codes, hits = ([part] for part in _joined(single, arrays))
    for figures, (one, many) in rule_hits(running, m, facts, narrow).items():
        numbers, entries = _joined(one, many)
        if figures:
            own = f"figure_code IN ({', '.join(_quoted(x) for x in figures)})"
            numbers = f"CASE WHEN {own} THEN {numbers} ELSE CAST(array() AS array<int>) END"
            entries = f"CASE WHEN {own} THEN {entries} ELSE {NO_HITS} END" if many else NO_HITS
        codes.append(numbers)
        hits += [entries] if many else []
    # The arrays are a projection of their own, so that their expressions are compiled: below a
    # lambda or inside a generator they would be interpreted row by row.
    listed = typed.select(
        "note_id", "figure_code", F.expr(f"concat({', '.join(codes)})").alias("_codes"),
        F.expr(f"concat({', '.join(hits)})").alias("_entries"),
    )
    # Numbers are told once a note, so taking the nulls away as a set loses none.
    numbered = f"transform(array_except(_codes, array(CAST(NULL AS INT))), c -> {_hit('c')})"
    found = listed.select(
        "note_id", "figure_code", F.explode(F.expr(f"concat(CAST({numbered} AS {HIT}), _entries)")).alias("_hit")
    )
    described = found.withColumn("code", F.col("_hit.code")).join(m.table(notes.sparkSession), "code")
    general = F.col("path")
    path = F.when(F.col("_hit.row").isNotNull(), F.replace(general, F.lit("[]"), F.concat(F.lit("["), F.col("_hit.row").cast("string"), F.lit("]")))).otherwise(general)
    return described.select(
        "note_id", "figure_code", path.alias("path"), "rule_id", "check", "severity", "origin", "pt", "en",
        "label_pt", "label_en", F.coalesce("_hit.value", "limit").alias("detail"),
    )


def localise(findings: DataFrame, culture: str) -> DataFrame:
    """Message text in the culture's language with label and limit filled in; Portuguese by default."""
    english = culture.lower().startswith("en")
    text = F.coalesce("en", "pt") if english else F.col("pt")
    label = F.coalesce("label_en", "label_pt") if english else F.col("label_pt")
    filled = F.replace(text, F.lit("{0}"), F.coalesce(label, F.lit("")))
    filled = F.replace(filled, F.lit("{1}"), F.coalesce("detail", F.lit("")))
    return findings.withColumn("message", filled).drop("pt", "en", "label_pt", "label_en")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per (note, path, rule, message)."""
    return first_wins(findings, ["note_id", "path", "rule_id", "message"], ["severity", "origin"])


def evaluated_paths(
    notes: DataFrame, fields: list[dict], rules: list[dict], checks: Checks, scope: str, changed: str | None = None
) -> DataFrame:
    """Every path a pass speaks for, with or without a finding, so stale findings can be cleared."""
    running = in_scope(rules, scope, set(checks.known))
    typed = read_notes(notes, fields)
    narrow = scope == "field"
    if narrow:
        typed = with_changes(typed, changed)
    spoken: list[Column] = []
    empty = F.array().cast("array<string>")

    def add(paths: list[str], each: str | None, asked: Column) -> None:
        section = each or (paths[0].split("[]")[0] if "[]" in paths[0] else None)
        if section:
            rows = F.sequence(F.lit(0), F.size(section) - 1)
            listed = F.flatten(F.transform(rows, lambda i: F.array(*[_row_path(p, i) for p in paths])))
            listed = F.when(F.coalesce(F.size(section), F.lit(0)) > 0, listed)
        else:
            listed = F.array(*[F.lit(p) for p in paths])
        spoken.append(F.when(decided(asked), F.coalesce(listed, empty)).otherwise(empty))

    for f in fields:
        add([f["path"]], None, F.expr(field_touched(f)) if narrow else F.lit(True))
    for r in running:
        own = F.col("figure_code").isin(r["figures"]) if r.get("figures") else F.lit(True)
        add(r["targets"], r.get("each"), own & (F.expr(rule_touched(r)) if narrow else F.lit(True)))
    paths = F.array_distinct(F.concat(*spoken))
    return typed.select("note_id", F.explode(paths).alias("path"))


def booking_decision(notes: DataFrame, findings: DataFrame) -> DataFrame:
    """Save or reject: errors reject, warnings reject unless accepted, infos never do.

    A figure that is not enabled blocks new notes only. ``notes`` carries ``is_new``,
    ``accepts_warnings`` and ``figure_enabled``.
    """
    counts = findings.groupBy("note_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    zero = F.lit(0).cast("long")
    judged = notes.join(counts, "note_id", "left").withColumns(
        {"errors": F.coalesce("errors", zero), "warnings": F.coalesce("warnings", zero)}
    )
    decision = (
        F.when(F.col("is_new") & ~F.col("figure_enabled"), "figure not enabled")
        .when(F.col("errors") > 0, "rejected")
        .when((F.col("warnings") > 0) & ~F.col("accepts_warnings"), "needs acceptance")
        .otherwise("saved")
    )
    kept = F.when(decision == "saved", F.col("warnings")).otherwise(zero)
    return judged.withColumn("decision", decision).withColumn("kept_warnings", kept)


def findings_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("figure_code", "severity", "origin").agg(F.count("*").alias("n"))


# Rows of repeating sections held as a table

def row_aggregates(rows: DataFrame, value: str, limit: float, key: str) -> DataFrame:
    """Per note: row count, sum (non-numeric as zero), any and all above ``limit``, distinct keys.

    Nulls count as one key. Everything combines on the map side; the distinct count is two-phased.
    """
    number = F.col(value).try_cast("decimal(18,8)")
    above = decided(number > limit)
    return rows.groupBy("note_id").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.coalesce(number, F.lit(0).cast("decimal(18,8)"))).alias("total"),
        F.bool_or(above).alias("any_above"),
        F.bool_and(above).alias("all_above"),
        (F.count_distinct(key) + F.max(F.col(key).isNull().cast("long")) == F.count("*")).alias("is_distinct"),
    )


def array_aggregates(notes: DataFrame, section: str, value: str, limit: float, key: str) -> DataFrame:
    """The same over an array column; an absent section counts as empty (any false, all true)."""
    rows = F.coalesce(F.col(section), F.array().cast(notes.schema[section].dataType))
    total = F.aggregate(
        rows,
        F.lit(0).cast("decimal(38,18)"),
        lambda a, r: (a + F.coalesce(r[value], F.lit(0))).cast("decimal(38,18)"),
    )
    return notes.select(
        "note_id",
        F.size(rows).alias("n_rows"),
        total.alias("total"),
        F.exists(rows, lambda r: decided(r[value] > limit)).alias("any_above"),
        F.forall(rows, lambda r: decided(r[value] > limit)).alias("all_above"),
        (F.size(F.array_distinct(F.transform(rows, lambda r: r[key]))) == F.size(rows)).alias("is_distinct"),
    )


def row_rule(rows: DataFrame, notes: DataFrame, section: str, key: str, guard: str | None, holds: str) -> DataFrame:
    """A per-row rule over a row table: the note's attributes join in, the row's shadow them."""
    shared = [c for c in notes.columns if c == "note_id" or c not in rows.columns]
    joined = rows.join(notes.select(*shared), "note_id")
    asked = decided(F.expr(guard)) if guard else F.lit(True)
    path = F.concat(F.lit(f"{section}["), F.col("row_no").cast("string"), F.lit(f"].{key}"))
    return joined.filter(asked & ~F.expr(holds)).select("note_id", path.alias("path")).distinct()


def row_count_bounds(notes: DataFrame, rows: DataFrame, least: int, most: int) -> DataFrame:
    """Notes whose repeating section has too few or too many rows; none counts as zero."""
    counts = rows.groupBy("note_id").agg(F.count("*").alias("n_rows"))
    n = F.coalesce("n_rows", F.lit(0).cast("long"))
    judged = notes.select("note_id").join(counts, "note_id", "left").withColumn("n_rows", n)
    check = F.when(F.col("n_rows") < least, "min_rows").when(F.col("n_rows") > most, "max_rows")
    return judged.withColumn("check", check).filter(F.col("check").isNotNull())


def impacted_rules(changes: DataFrame, dependencies: DataFrame, targets: DataFrame) -> DataFrame:
    """Rules to run again for each edit, found by equi-joins on path, section and target.

    ``changes`` holds (edit_id, path); the two others (rule_id, dependency) and (rule_id, target).
    """
    general = F.regexp_replace("path", r"\[\d+\]", "[]")
    keyed = changes.select("edit_id", "path", general.alias("_general"), F.regexp_extract("path", r"^\w+", 0).alias("_section"))
    sections = dependencies.filter(~F.col("dependency").contains("."))
    by_path = keyed.join(dependencies, F.col("_general") == F.col("dependency")).select("edit_id", "rule_id")
    by_section = keyed.join(sections, F.col("_section") == F.col("dependency")).select("edit_id", "rule_id")
    by_target = keyed.join(targets, F.col("path") == F.col("target")).select("edit_id", "rule_id")
    return by_path.unionByName(by_section).unionByName(by_target).distinct()


def rule_lint(rules: DataFrame, sections: DataFrame) -> DataFrame:
    """What is wrong with the rule table: one row per rule and problem."""
    repeats = rules.groupBy("rule_id").agg((F.count("*") > 1).alias("_repeated"))
    known = sections.select("section").distinct().withColumn("_known", F.lit(True))
    has_assert, has_check = values.present(F.col("assert")).isNotNull(), values.present(F.col("check")).isNotNull()
    problems = [
        (has_assert & has_check, "both assert and check"),
        (~has_assert & ~has_check, "neither assert nor check"),
        (values.present(F.col("message")).isNull(), "no message"),
        (values.present(F.col("target")).isNull(), "no target"),
        (F.col("section").isNotNull() & F.col("_known").isNull(), "unknown section"),
        (F.col("_repeated"), "repeated id"),
    ]
    joined = rules.join(repeats, "rule_id").join(known, "section", "left")
    listed = F.array_compact(F.array(*[F.when(decided(bad), F.lit(text)) for bad, text in problems]))
    return joined.select("rule_id", "pos", F.explode(listed).alias("problem"))
