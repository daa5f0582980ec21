"""What plans do once for each note: short rows move, formulas are compiled, padded lines are written last."""

import contextlib
import io

from strikebook.functions import values
from strikebook.operators import payoffs
from strikebook.operators import validation as v
from strikebook.operators.calendar import Calendar


def explained(df) -> list[str]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].splitlines()


def depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def notes_and_checks(spark):
    notes = spark.createDataFrame(
        [(1, "COE001001", '{"common":{"instrumentCode":"A"}}'), (2, "COE001001", '{"common":{"instrumentCode":"A"}}'), (3, "COE001001", "{}")],
        "note_id long, figure_code string, doc string",
    )
    book = spark.createDataFrame([(1, "A"), (2, "A"), (3, None)], "note_id long, instrument_code string")
    return notes, v.standard_checks(Calendar(()), book)


def test_codes_are_joined_before_documents_are_parsed(spark):
    notes, checks = notes_and_checks(spark)
    fields = [f for f in v.load_fields() if f["path"].startswith("common.")]
    rules = [r for r in v.load_rules() if r.get("check") == "uniqueInstrumentCode"]
    found = v.validate(notes, fields, rules, checks).filter("rule_id is not null")
    assert sorted(r.note_id for r in found.collect()) == [1, 2]
    plan = explained(found)
    parsed = next(i for i, line in enumerate(plan) if "from_json" in line)
    joins = [i for i, line in enumerate(plan) if "Join LeftOuter" in line]
    assert joins and all(parsed < i and depth(plan[parsed]) < depth(plan[i]) for i in joins)


def test_generators_pass_on_what_projections_made(spark):
    notes, checks = notes_and_checks(spark)
    plan = explained(v.validate(notes, v.load_fields(), v.load_rules(), checks))
    generators = [line for line in plan if "Generate " in line]
    assert generators and not any("from_json" in line or "regexp_extract" in line or "filter(" in line for line in generators)


def test_an_exponent_that_is_not_written_is_not_cast(spark):
    rows = spark.createDataFrame([('{"cap":1.250}',), ('{"cap":1.5e-3}',), ('{"cap":12e1}',), ('{"cap":7}',)], "t string")
    scale = values.written_scale("t", "cap")
    assert [r[0] for r in rows.selectExpr(scale).collect()] == [3, 4, 0, 0]
    # the cast sees null for an absent exponent, so no error is built and dropped for each note
    assert "try_cast(nullif(" in scale


def test_lifecycle_events_read_observations_once(spark):
    day = "DATE '2024-01-02'"
    obs = spark.range(6).selectExpr(
        "id % 3 AS note_id", f"date_add({day}, CAST(id AS INT)) AS obs_date", "CAST(id DIV 3 + 1 AS INT) AS obs_no", "2L AS n_obs",
        "CAST(60 + 25 * id AS DECIMAL(18,8)) AS price", "'fixed' AS state", "CAST(100 AS DECIMAL(18,8)) AS s0", "CAST(100 AS DECIMAL(9,4)) AS trigger_pct",
        "CAST(70 AS DECIMAL(9,4)) AS coupon_pct", "CAST(70 AS DECIMAL(9,4)) AS lower_pct", "CAST(4 AS DECIMAL(9,4)) AS coupon", "CAST(1000 AS DECIMAL(18,2)) AS vn",
    )
    # note 1 is booked twice, note 2 not at all
    notes = spark.createDataFrame([(0, "trigger"), (1, "maturity"), (1, "trigger")], "note_id long, settles string").selectExpr(
        "note_id", f"{day} AS start_date", "DATE '2024-12-31' AS end_date", "CAST(1000 AS DECIMAL(18,2)) AS vn", "settles"
    )
    events = payoffs.lifecycle_events(notes, obs)
    flows = payoffs.phoenix(obs).join(notes, "note_id").count()
    kinds = [r.kind for r in events.collect()]
    assert kinds.count("issue") == 3 and kinds.count("observation") == payoffs.first_trigger(obs).count()
    assert len(kinds) - kinds.count("issue") - kinds.count("observation") == flows > 3
    assert sum("Range (0, 6" in line for line in explained(events)) == 1
