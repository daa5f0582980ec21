"""Worked examples with published results, and cases the tables cannot show."""

import datetime as dt
import json
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from strikebook.functions import text, truth
from strikebook.functions.layouts import LAYOUTS, cells
from strikebook.functions.numbering import numbered
from strikebook.operators import accrual, book, calendar, clearing, payoffs, validation
from strikebook.sources import single_byte


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def d(x):
    return F.lit(str(x)).cast("decimal(20,16)")


def VN():
    return F.lit(1000).cast("decimal(18,2)")


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: payoffs.call_participation(VN(), d(0.40), F.lit(70)), "1280.00"),
        (lambda: payoffs.call_participation(VN(), d(0.15), F.lit(70)), "1105.00"),
        (lambda: payoffs.call_participation(VN(), d(-0.30), F.lit(70)), "1000.00"),
        (lambda: payoffs.call_spread(VN(), d(0.40), F.lit(100), F.lit(25)), "1250.00"),
        (lambda: payoffs.call_spread(VN(), d(0.18), F.lit(100), F.lit(25)), "1180.00"),
        (lambda: payoffs.put_spread(VN(), d(-0.40), F.lit(100), F.lit(25)), "1250.00"),
        (lambda: payoffs.put_spread(VN(), d(-0.12), F.lit(100), F.lit(25)), "1120.00"),
        (lambda: payoffs.put_spread(VN(), d(0.20), F.lit(100), F.lit(25)), "1000.00"),
        (lambda: payoffs.digital(VN(), F.lit(True), F.lit(15), d(1)), "1150.00"),
        (lambda: payoffs.shark_fin(VN(), d(0.29), F.lit(False), F.lit(100), F.lit(3)), "1290.00"),
        (lambda: payoffs.shark_fin(VN(), d(0.35), F.lit(True), F.lit(100), F.lit(3)), "1030.00"),
        (lambda: payoffs.shark_fin(VN(), d(-0.20), F.lit(False), F.lit(100), F.lit(3)), "1000.00"),
        (lambda: payoffs.range_accrual(VN(), F.lit(12), F.lit(189), F.lit(252)), "1090.00"),
        (lambda: payoffs.range_accrual(VN(), F.lit(12), F.lit(0), F.lit(252)), "1000.00"),
        (lambda: payoffs.booster(VN(), d(0.40), F.lit(2), F.lit(25)), "1500.00"),
        (lambda: payoffs.booster(VN(), d(0.15), F.lit(2), F.lit(25)), "1300.00"),
        (lambda: payoffs.booster(VN(), d(-0.30), F.lit(2), F.lit(25)), "700.00"),
        (lambda: payoffs.reverse_convertible(VN(), d(-0.25), F.lit(False), F.lit(18)), "1180.00"),
        (lambda: payoffs.reverse_convertible(VN(), d(-0.45), F.lit(True), F.lit(18)), "730.00"),
        (lambda: payoffs.twin_win(VN(), d(0.35), F.lit(False), F.lit(100), F.lit(100)), "1350.00"),
        (lambda: payoffs.twin_win(VN(), d(-0.30), F.lit(False), F.lit(100), F.lit(100)), "1300.00"),
        (lambda: payoffs.twin_win(VN(), d(-0.50), F.lit(True), F.lit(100), F.lit(100)), "500.00"),
        (lambda: 1175 - payoffs.withholding_tax(F.lit(1175).cast("decimal(18,2)"), VN(), F.lit(721)), "1148.75"),
    ],
)
def test_redemption(spark, column, expected):
    assert one(spark, x=column())["x"] == Decimal(expected)


def _observed(spark, levels, **terms):
    rows = [
        (1, dt.date(2024, 1, 1 + i), Decimal(str(level)), Decimal(100), Decimal(terms["coupon"]), Decimal(1000), terms.get("modality", "VNR"))
        for i, level in enumerate(levels)
    ]
    schema = "note_id long, obs_date date, price decimal(18,8), s0 decimal(18,8), coupon decimal(9,4), vn decimal(18,2), modality string"
    return spark.createDataFrame(rows, schema).withColumns(
        {"trigger_pct": F.lit(100).cast("decimal(9,4)"), "lower_pct": F.lit(70).cast("decimal(9,4)")}
    )


@pytest.mark.parametrize(
    "levels, expected",
    [([101, 90, 90, 90], 1100), ([90, 90, 101, 90], 1300), ([90, 90, 90, 80], 1000), ([90, 90, 90, 60], 600)],
)
def test_athena(spark, levels, expected):
    assert payoffs.athena(_observed(spark, levels, coupon=10)).first()["redemption"] == expected


def test_open_observations(spark):
    """A note in mid-life stays open; a missing fixing counts as a missed coupon."""
    day = dt.date(2024, 1, 1)
    notes = spark.createDataFrame(
        [(1, "A", day, day + dt.timedelta(6), Decimal(100), Decimal(4), Decimal(1000), "VNP", Decimal(100), Decimal(70))],
        "note_id long, asset string, start_date date, end_date date, s0 decimal(18,8), coupon decimal(9,4), vn decimal(18,2), "
        "modality string, trigger_pct decimal(9,4), lower_pct decimal(9,4)",
    )
    fixed = spark.createDataFrame([("A", day + dt.timedelta(3), Decimal(80))], "asset string, fixing_date date, close decimal(18,8)")
    obs = payoffs.observations(notes, fixed, "start_date", "end_date", 3)
    assert [(o.obs_no, o.n_obs, o.price) for o in obs.orderBy("obs_no").collect()] == [(1, 3, None), (2, 3, Decimal(80)), (3, 3, None)]
    assert payoffs.athena(obs).first()["redemption"] is None
    assert [(f.obs_no, f.kind, int(f.amount)) for f in payoffs.phoenix(obs).collect()] == [(2, "coupon", 80)]


def test_schedule_rolls_steps_down_and_names_gaps(spark):
    """Saturday 6 January rolls to Monday; triggers fall by 5 a date; a past date without a fixing ends the note's story."""
    day = dt.date(2024, 1, 3)
    columns = "note_id long, asset string, start_date date, end_date date, s0 decimal(18,8), coupon decimal(9,4), vn decimal(18,2), modality string, trigger_pct decimal(9,4), step_down decimal(9,4), coupon_pct decimal(9,4), lower_pct decimal(9,4)"
    terms = (day, day + dt.timedelta(9), Decimal(100), Decimal(4), Decimal(1000), "VNR", Decimal(100), Decimal(5), Decimal(90), Decimal(70))
    notes = spark.createDataFrame([(1, "A", *terms), (2, "B", *terms), (3, "C", *terms)], columns)
    days = {3: [80, 80, 95], 8: [94, None, 80], 9: [96, 99, 80], 12: [1, 1, 86]}
    fixed = spark.createDataFrame(
        [(a, dt.date(2024, 1, d), Decimal(p)) for d, prices in days.items() for a, p in zip("ABC", prices, strict=True) if p is not None],
        "asset string, fixing_date date, close decimal(18,8)",
    )
    obs = payoffs.observations(notes, fixed, "start_date", "end_date", 3, calendar.national_calendar(2024, 2024), F.lit(dt.date(2024, 1, 12)))
    dates = [(r.obs_date.day, int(r.trigger_pct)) for r in obs.where("note_id = 1").orderBy("obs_no").collect()]
    assert dates == [(3, 100), (8, 95), (9, 90), (12, 85)]
    got = {r.note_id: (r.obs_no, r.redemption, r.reason) for r in payoffs.athena(obs).collect()}
    assert got == {1: (3, Decimal(1120), None), 2: (2, None, "unresolved"), 3: (4, Decimal(1160), None)}
    flows = sorted((r.note_id, r.obs_no, r.kind, r.amount and int(r.amount)) for r in payoffs.phoenix(obs).collect())
    assert flows == [
        (1, 2, "coupon", 80), (1, 3, "coupon", 40), (1, 3, "early redemption", 1000), (2, 2, "unresolved", None),
        (3, 1, "coupon", 40), (3, 4, "maturity", 1000),
    ]
    # the same dates before they have passed are open
    early = payoffs.observed(obs.drop("price", "state"), fixed.where("false"), F.lit(dt.date(2024, 1, 1)))
    assert {r.reason for r in payoffs.athena(early).collect()} == {"open"} and payoffs.phoenix(early).count() == 0


def test_registered_schedule(spark):
    rows = [(1, dt.date(2024, 1, 6)), (1, dt.date(2024, 1, 3)), (2, dt.date(2024, 1, 1))]
    dated = payoffs.registered_schedule(spark.createDataFrame(rows, "note_id long, scheduled_on date"), calendar.national_calendar(2024, 2024))
    assert sorted((r.note_id, r.obs_no, r.n_obs, r.obs_date.day) for r in dated.collect()) == [(1, 1, 2, 3), (1, 2, 2, 8), (2, 1, 1, 2)]


def test_phoenix_memory(spark):
    flows = payoffs.phoenix(_observed(spark, [65, 75, 55], coupon=4)).orderBy("obs_no", "kind").collect()
    assert [(f.obs_no, f.kind, int(f.amount)) for f in flows] == [(2, "coupon", 80), (3, "maturity", 550)]
    called = payoffs.phoenix(_observed(spark, [95, 102, 50], coupon=4)).orderBy("obs_no", "kind").collect()
    assert [(f.obs_no, f.kind, int(f.amount)) for f in called] == [
        (1, "coupon", 40), (2, "coupon", 40), (2, "early redemption", 1000),
    ]


def test_accrual_examples(spark):
    notes = spark.sql("SELECT DATE '2024-01-02' AS a, DATE '2024-01-04' AS b, 90.0 AS p")
    rates = spark.sql("SELECT * FROM VALUES (DATE '2024-01-02', 15.0D), (DATE '2024-01-03', 15.0D) AS r(rate_date, rate)")
    free = accrual.di_factor(notes, rates, "a", "b", "p", "f").first()["f"]
    assert round(free, 8) == 1.00099883
    book_rounded = accrual.di_factor(notes, rates, "a", "b", "p", "f", "handbook").first()["f"]
    assert book_rounded == Decimal("1.00099881")
    assert round(one(spark, x=accrual.pre_factor(F.lit(12), F.lit(378)))["x"], 4) == 1.1853


def test_di_factor_over_all_windows(spark):
    days = [dt.date(2024, 1, 2) + dt.timedelta(days=i) for i in range(40) if i % 7 < 5]
    annual = {d: 10 + i % 4 for i, d in enumerate(days)}
    rates = spark.createDataFrame([(d, float(r)) for d, r in annual.items()], "rate_date date, rate double")
    ends = [None, *[dt.date(2023, 12, 20) + dt.timedelta(days=3 * i) for i in range(22)]]
    windows = [(a, b, p) for a in ends for b in ends for p in (Decimal("90"), Decimal("110.5"), None)]
    notes = spark.createDataFrame(windows, "a date, b date, p decimal(9,4)")
    free = {(r.a, r.b, r.p): r.f for r in accrual.di_factor(notes, rates, "a", "b", "p", "f").collect()}
    cut = {(r.a, r.b, r.p): r.f for r in accrual.di_factor(notes, rates, "a", "b", "p", "f", "handbook").collect()}
    eight = Decimal("1e-8")
    for a, b, p in windows:
        f, g = 1.0, Decimal(1)
        for d in days if a and b and p is not None else []:
            if a <= d < b:
                tdi = (1 + annual[d] / 100) ** (1 / 252) - 1
                f *= 1 + tdi * float(p) / 100
                step = 1 + Decimal(tdi).quantize(eight, ROUND_HALF_UP) * p / 100
                g = (g * step.quantize(Decimal("1e-14"), ROUND_HALF_UP)).quantize(eight, ROUND_HALF_UP)
        key = (a, b, None if p is None else p.quantize(Decimal("1e-4")))
        assert abs(free[key] - f) < 1e-13 and cut[key] == g
    none = accrual.di_factor(notes, rates.where("false"), "a", "b", "p", "f", "handbook")
    assert {r.f for r in none.collect()} == {Decimal(1)}


def test_truth_regimes(spark):
    missing = F.lit(None).cast("int")
    row = one(
        spark,
        bare=missing > 0,
        joined=truth.both(missing > 0, F.lit(True)),
        equal=truth.same(missing, missing),
        denied=truth.negated(missing > 0),
        least=truth.smallest(F.lit(1), missing),
        inside=truth.inside(F.lit(50), F.lit(1), F.lit(10)),
    )
    assert (row.bare, row.joined, row.equal, row.denied, row.least, row.inside) == (None, False, True, True, None, False)


def test_holidays_match_the_national_list():
    listed = ["2026-02-16", "2026-02-17", "2026-04-03", "2026-06-04", "2027-02-08", "2027-02-09", "2027-03-26", "2027-05-27"]
    assert {dt.date.fromisoformat(x) for x in listed} <= set(calendar.national_days(2026, 2027))
    assert len(calendar.national_days(2026, 2027)) == 26


def test_match_keys(spark):
    rows = one(
        spark,
        a=text.normalise(F.lit("Participação cenário de alta (%)")),
        b=text.normalise(F.lit("Strike 1(%)")),
        c=text.normalise(F.lit(None).cast("string")),
        n=text.number_of(text.normalise(F.lit("Amortização 1 (%)"))),
        s=text.signature(text.normalise(F.lit("Datas de Observação"))),
        t=text.signature(text.normalise(F.lit("observacao da data"))),
    )
    assert (rows.a, rows.b, rows.c, rows.n) == ("participacao cenario de alta", "strike 1", "", 1)
    assert rows.s == rows.t


def test_cells(spark):
    df = spark.sql("SELECT 'AB' AS t, 42 AS n, 1.5BD AS a, 100.00005BD AS b, CAST(NULL AS INT) AS z, -1 AS neg")
    line = clearing.render(df, "5 text t\n5 number n\n20 amount.8 a\n7 amount.4 b\n3 number z").first()
    assert line["line"] == "AB   00042" + "00000000000150000000" + "1000001" + "   "
    assert clearing.render(df, "2 number neg").first()["problem"] == "neg"
    assert clearing.render(df, "1 text t").first()["problem"] == "t"


def test_layouts_have_their_declared_length(spark):
    for records in LAYOUTS.values():
        for length, spec in records.values():
            assert sum(c.width for c in cells(spec)) == length
    assert clearing.layout_lint(clearing.layout_table(spark)).count() == 0


def test_registration_positions(spark):
    note = spark.sql(
        "SELECT 1 AS file_id, 'DESK' AS participant, DATE '2026-09-01' AS stamp, '40001' AS issuer_account, '05' AS figure_ordinal, "
        "DATE '2026-09-01' AS issue_date, 1000 AS quantity, 1000BD AS unit_issue_price, 1000000BD AS notional, '01' AS modality_code, "
        "100BD AS guaranteed_capital, 'S' AS cvm_resolution_8, 'C' AS issuer_position, 'PETR4' AS asset, 'D' AS custody_regime"
    )
    rows = spark.sql("SELECT 1 AS file_id, 1 AS row_no, DATE '2026-09-01' AS stamp, 'C0000109' AS field_code, '110.00000000' AS field_value")
    lines, rejects = clearing.export_layout("Y1_registration", note, rows)
    head, fixed, variable = [r["line"] for r in lines.orderBy("line_no").collect()]
    assert (len(head), len(fixed), len(variable), rejects.count()) == (38, 1103, 326, 0)
    at = {18: "05", 120: "20260901", 136: "000000001000", 148: "00000000100000000000", 168: "000000000100000000", 206: "01",
          208: "1000000", 222: "S", 225: "C", 256: "PETR4     ", 623: "001", 726: "D"}
    assert all(fixed[i : i + len(v)] == v for i, v in at.items())


def test_single_byte():
    assert single_byte.encode("COE – ç") == bytes.fromhex("434F45209620E7")
    assert single_byte.decode(b"\x96\x81") == "–\x81"
    assert single_byte.encode("ā€中") == b"a\x80?"


def _variable_rows(spark, sizes):
    texts = [f"SELECT {f} AS file_id, CAST(id AS INT) AS field_value, date_add(DATE'2020-01-01', CAST(id * 97 % 1200 AS INT)) AS payment_date FROM range({n})" for f, n in sizes]
    return spark.sql(" UNION ALL ".join([*texts, "SELECT NULL, 1, DATE'2020-01-01'", "SELECT 1, 2, NULL"])).withColumns({"stamp": F.lit("2026-09-01").cast("date"), "field_code": F.lit("C1")})


def test_only_large_files_are_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(clearing, "MANY_ROWS", 10)
    rows = _variable_rows(spark, [(1, 10), (2, 300), (3, 1)])
    got = clearing.number_rows(rows, ["payment_date", "field_value"], F.year("payment_date")).collect()
    places = {f: [r.row_no for r in sorted(got, key=lambda r: (r.payment_date, r.field_value)) if r.file_id == f] for f in (1, 2, 3)}
    # a row without a date comes first and is left out; it makes file 1 one of many rows
    assert places == {1: [*range(2, 12)], 2: [*range(1, 301)], 3: [1]}
    assert len(got) == 311


def test_rows_of_small_files_are_numbered_once(spark):
    rows = _variable_rows(spark, [(1, 3), (2, 5), (4, 1)])
    notes = spark.sql("SELECT id AS file_id, DATE'2026-09-01' AS stamp, CASE WHEN id = 2 THEN -1 ELSE 7 END AS quantity FROM range(1, 4)")
    numbered_rows = clearing.number_rows(rows, ["payment_date", "field_value"], F.year("payment_date"))
    lines, rejects = clearing.export_layout("Y1_registration", notes, numbered_rows, rows.dropna(subset=["file_id", "payment_date"]))
    assert sorted((r.file_id, r.line_no) for r in lines.collect()) == [(1, 1), (1, 2), (1, 4), (1, 5), (1, 6), (3, 1), (3, 2), (4, 3)]
    assert [tuple(r) for r in rejects.collect()] == [(2, "quantity")]
    plan = lines._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Window [") == 1


def test_numbering_equals_row_number(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 5003).alias("v"))
    split = numbered(df, ["k"], ["v"], F.floor(F.col("v") / 100), "n")
    whole = df.selectExpr("k", "v", "cast(row_number() over (partition by k order by v) as long) as n")
    assert split.exceptAll(whole).count() == 0 and split.count() == 5000


def test_business_days_reversed(spark):
    cal = calendar.national_calendar(2026, 2026)
    df = spark.sql("SELECT DATE '2026-04-01' AS a, DATE '2026-04-06' AS b")
    assert calendar.business_days_between(df, "a", "b", cal, "n").first()["n"] == 2
    assert calendar.business_days_between(df, "b", "a", cal, "n").first()["n"] == -2


def _calendars():
    long_pause = tuple(dt.date(2024, 12, 20) + dt.timedelta(days=i) for i in range(25))
    return {"national": calendar.national_calendar(1900, 2300), "none": calendar.Calendar(()), "pause": calendar.Calendar((*long_pause, dt.date(2026, 5, 30)))}


def test_calendar_over_any_date(spark):
    starts = [dt.date(1, 3, 1), dt.date(1582, 10, 1), dt.date(1899, 12, 15), dt.date(1900, 2, 20), dt.date(2024, 12, 1), dt.date(2100, 2, 25), dt.date(2300, 12, 1), dt.date(2301, 1, 1), dt.date(9998, 12, 1)]
    days = [d + dt.timedelta(days=i) for d in starts for i in range(60)]
    df = spark.createDataFrame([(d,) for d in sorted(set(days))], "d date")
    for cal in _calendars().values():
        listed = set(cal.holidays)

        def is_open(d, listed=listed):
            return d.weekday() < 5 and d not in listed

        day = F.col("d")
        columns = [cal.index(day).alias("i"), cal.is_open(day).alias("o"), cal.next_open(day).alias("n")]
        rows = {r.d: r for r in df.select("d", *columns).collect()}
        windows = {}
        for r in calendar.fixing_window(df.selectExpr("d", "3 AS n", "5 AS lag"), "d", "n", "lag", cal, "day").collect():
            windows.setdefault(r.d, []).append(r.day)
        for first in starts:
            base = rows[first].i - is_open(first)
            seen = []
            for i in range(60):
                d = first + dt.timedelta(days=i)
                seen += [d] if is_open(d) else []
                r = rows[d]
                assert (r.o, r.i) == (is_open(d), base + len(seen)), d
                following = d
                while not is_open(following):
                    following += dt.timedelta(days=1)
                assert r.n == following
                if len(seen) > 8:
                    assert windows[d] == seen[-8:-5]


def test_calendar_of_nulls(spark):
    cal = _calendars()["national"]
    row = spark.sql("SELECT CAST(NULL AS DATE) AS d, 2 AS n, 0 AS lag").withColumn("a", cal.index(F.col("d"))).withColumn("o", cal.is_open(F.col("d")))
    assert row.first()[-2:] == (None, None)
    assert calendar.fixing_window(row, "d", "n", "lag", cal, "day").select("day").collect() == [(None,), (None,)]
    assert calendar.is_business_day(row, "d", cal, "x").first().x is None


def _call_spread(**changes):
    doc = {
        "common": {"issuerAccount": "40001", "commercialName": "A note", "issueDate": "2026-09-01", "maturityDate": "2028-09-01",
                   "quantity": 100, "unitIssuePrice": 1000, "modality": "VNP", "guaranteedCapital": 100, "externalIdentifier": "X"},
        "underlying": {"asset": "IBOV"}, "terms": {"baseApplication": 100},
        "payoff": {"strike": 100, "participation": 100, "cap": 25},
    }
    for path, value in changes.items():
        section, key = path.split("__")
        doc[section][key] = value
    return json.dumps(doc)


MUTATIONS = [
    ({}, set()),
    ({"common__issueDate": "2028-09-01", "common__maturityDate": "2026-09-01"}, {"common.maturity-after-issue", "common.short-tenor"}),
    ({"common__guaranteedCapital": 90}, {"common.vnp-guaranteed-capital"}),
    ({"payoff__cap": 0}, {"callspread.cap-positive", "callspread.narrow-spread"}),
    ({"payoff__cap": None}, {"required"}),
    ({"payoff__cap": 300}, {"callspread.max-redemption"}),
    ({"payoff__cap": "x"}, {"number"}),
]


def test_validation_mutations(spark):
    rows = [(i, "COE001005", _call_spread(**m)) for i, (m, _) in enumerate(MUTATIONS)]
    notes = spark.createDataFrame(rows, "note_id long, figure_code string, doc string")
    found = validation.validate(notes, validation.load_fields(), validation.load_rules(), validation.Checks())
    got = {i: set() for i in range(len(MUTATIONS))}
    for r in found.collect():
        got[r.note_id].add(r.rule_id or r.check)
    assert [got[i] for i in got] == [expected for _, expected in MUTATIONS]


def test_written_scale_keeps_zeros(spark):
    rows = [(1, "COE001005", _call_spread().replace('"cap": 25', '"cap": 25.10000'))]
    notes = spark.createDataFrame(rows, "note_id long, figure_code string, doc string")
    found = validation.validate(notes, validation.load_fields(), [], validation.Checks()).collect()
    assert [(r.path, r.check, r.severity) for r in found] == [("payoff.cap", "decimals", "warning")]


def test_live_on_includes_both_ends(spark):
    df = spark.sql("SELECT DATE '2026-09-01' AS issue_date, DATE '2028-09-01' AS maturity_date")
    days = {"2026-08-31": 0, "2026-09-01": 1, "2028-09-01": 1, "2028-09-02": 0}
    assert {x: book.live_on(df, dt.date.fromisoformat(x)).count() for x in days} == days


def test_sets_and_conditions_in_rows(spark):
    base = {"pt": "x", "en": "x"}
    fields = [
        {"path": "payoff.kinds", "type": "enumset", "options": ["A", "B"], "required": True, **base},
        {"path": "observations[].kind", "type": "string", **base},
        {"path": "observations[].days", "type": "enumset", "options": ["MON", "TUE"], "required_when": "r.kind = 'weekly'", **base},
    ]
    docs = [
        {"payoff": {"kinds": []}, "observations": []},
        {"payoff": {"kinds": ["A", "C"]}, "observations": [{"kind": "weekly"}, {"kind": "daily"}, {"kind": "weekly", "days": []}]},
        {"payoff": {"kinds": ["B"]}, "observations": [{"kind": "weekly", "days": ["MON", "SUN"]}, {"days": ["SAT"]}]},
    ]
    notes = spark.createDataFrame([(i, "F", json.dumps(d)) for i, d in enumerate(docs)], "note_id long, figure_code string, doc string")
    found = validation.validate(notes, fields, [], validation.Checks())
    assert sorted((r.note_id, r.path, r.check) for r in found.collect()) == [
        (0, "payoff.kinds", "required"), (1, "observations[0].days", "required"), (1, "observations[2].days", "required"), (1, "payoff.kinds", "option"),
        (2, "observations[0].days", "option"), (2, "observations[1].days", "option"),
    ]


def test_deep_pages(spark):
    """A day with most of the rows, one without a date, ties of the day; pages in any depth are those of one sort."""
    rows = [(i, "F", None if i % 50 == 3 else dt.date(2024, 1, 1 + (0 if i % 3 else i % 20))) for i in range(3000)]
    book_rows = spark.createDataFrame(rows, "note_id long, figure_code string, updated_on date").repartition(6)
    figures = spark.createDataFrame([("F", "a figure")], "figure_code string, figure_name string")
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or dt.date(1, 1, 1)).toordinal(), r[0]))
    for page, size in ((1, 50), (2, 7), (20, 100), (429, 7), (30, 100), (31, 100)):
        for skipped in (10_000, 5):
            got = book.page_with_total(book_rows, figures, page, size, most_skipped=skipped).collect()
            assert [r.note_id for r in got] == [r[0] for r in order[(page - 1) * size : page * size]], (page, size, skipped)
            assert all(r.total == 3000 and r.figure_name == "a figure" for r in got)
