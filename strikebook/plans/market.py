"""Queries over calendars, accrual factors, fixings and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikebook.operators import accrual, calendar, fixings
from strikebook.operators.asof import asof
from strikebook.plans.frames import FIRST_DAY, LAST_DAY, exact_change, frame, query
from strikebook.plans.registry import Registry

registry = Registry()
#: Years whose national holidays are listed.
NATIONAL_YEARS = (1900, 2300)
FIRST, LAST = FIRST_DAY, LAST_DAY


def holidays(spark):
    return calendar.national_holidays(spark, FIRST.year, LAST.year)


def brazil(spark) -> calendar.Calendar:
    return calendar.national_calendar(*NATIONAL_YEARS)


def daily(spark, sf):
    return fixings.daily_fixings(frame(spark, sf, "ticks"))


def rounded(column: str, decimals: int = 8):
    """A double as a decimal that both sides write alike."""
    return F.round(F.col(column).cast("decimal(38,18)"), decimals).cast(f"decimal(18,{decimals})").alias(column)


def sql_rounded(text: str, decimals: int = 8) -> str:
    return f"CAST(round({text}, {decimals}) AS DECIMAL(18,{decimals}))"


# Calendar

SPAN = "SELECT 'BRASIL' AS calendar_code, min(issue_date) AS lo, max(maturity_date) AS hi FROM {book} b"


@registry.add(
    "K1_build_calendar",
    f"""
WITH span AS ({SPAN}), days AS (
 SELECT calendar_code, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
flagged AS (SELECT *, isodow(day) < 6 AND day NOT IN (SELECT holiday_date FROM {{d_holidays}} h) AS is_business_day
            FROM days)
SELECT calendar_code, day, is_business_day,
       CAST(sum(CAST(is_business_day AS INT)) OVER (ORDER BY day) AS BIGINT) AS bd_index,
       min(CASE WHEN is_business_day THEN day END)
         OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_bd
FROM flagged""",
)
def build_calendar(spark, sf):
    return calendar.build_calendar(holidays(spark), query(spark, sf, SPAN))


@registry.add(
    "E4_business_day_index",
    "SELECT t.tick_id, t.fixing_date, c.bd_index FROM {ticks} t LEFT JOIN {d_calendar} c ON c.day = t.fixing_date",
)
def business_day_index(spark, sf):
    ticks = frame(spark, sf, "ticks").select("tick_id", "fixing_date")
    return calendar.business_day_index(ticks, "fixing_date", brazil(spark), FIRST, "bd_index")


@registry.add(
    "K2_is_business_day",
    "SELECT b.note_id, b.issue_date, c.is_business_day AS on_business_day FROM {book} b "
    "LEFT JOIN {d_calendar} c ON c.day = b.issue_date",
)
def is_business_day(spark, sf):
    notes = frame(spark, sf, "book").select("note_id", "issue_date")
    return calendar.is_business_day(notes, "issue_date", brazil(spark), "on_business_day")


BETWEEN = """
SELECT n.note_id, n.a, n.b, y.bd_index - x.bd_index AS du
FROM (SELECT note_id, CASE WHEN note_id % 3 = 0 THEN maturity_date ELSE issue_date END AS a,
             CASE WHEN note_id % 3 = 0 THEN issue_date ELSE maturity_date END AS b FROM {book} b) n
JOIN {d_calendar} x ON x.day = n.a JOIN {d_calendar} y ON y.day = n.b"""


@registry.add("K3_business_days_between", BETWEEN)
def business_days_between(spark, sf):
    swapped = F.col("note_id") % 3 == 0
    notes = frame(spark, sf, "book").select(
        "note_id",
        F.when(swapped, F.col("maturity_date")).otherwise(F.col("issue_date")).alias("a"),
        F.when(swapped, F.col("issue_date")).otherwise(F.col("maturity_date")).alias("b"),
    )
    return calendar.business_days_between(notes, "a", "b", brazil(spark), "du")


@registry.add(
    "K4_roll_following",
    "SELECT b.note_id, b.maturity_date, c.next_bd AS paid_on FROM {book} b "
    "LEFT JOIN {d_calendar} c ON c.day = b.maturity_date",
)
def roll_following(spark, sf):
    notes = frame(spark, sf, "book").select("note_id", "maturity_date")
    return calendar.roll_following(notes, "maturity_date", brazil(spark), "paid_on")


@registry.add(
    "K5_expand_schedule",
    "SELECT t.note_id, c.day AS observed_on FROM {terms} t "
    "JOIN {d_calendar} c ON c.is_business_day AND c.day BETWEEN t.start_date AND t.end_date",
)
def expand_schedule(spark, sf):
    notes = frame(spark, sf, "terms").select("note_id", "start_date", "end_date")
    days = calendar.expand_schedule(notes, "start_date", "end_date", brazil(spark), "observed_on")
    return days.select("note_id", "observed_on")


@registry.add(
    "K6_fixing_window",
    """
SELECT t.note_id, d.day AS fixing_on
FROM {terms} t JOIN {d_calendar} m ON m.day = t.end_date
JOIN {d_calendar} d ON d.is_business_day
 AND d.bd_index BETWEEN m.bd_index - t.note_id % 6 - t.note_id % 5 AND m.bd_index - t.note_id % 6""",
)
def fixing_window(spark, sf):
    notes = frame(spark, sf, "terms").select(
        "note_id",
        "end_date",
        (1 + F.col("note_id") % 5).cast("int").alias("n"),
        (F.col("note_id") % 6).cast("int").alias("lag"),
    )
    days = calendar.fixing_window(notes, "end_date", "n", "lag", brazil(spark), "fixing_on")
    return days.select("note_id", "fixing_on")


@registry.add(
    "K7_calendar_gap_audit",
    """
SELECT year(maturity_date) AS year, count(*) AS n_dates FROM {book} b
WHERE year(maturity_date) NOT IN (SELECT year(holiday_date) FROM {d_holidays} h WHERE year(holiday_date) <= 2001)
GROUP BY 1""",
)
def calendar_gap_audit(spark, sf):
    loaded = calendar.national_holidays(spark, FIRST.year, 2001)
    return calendar.calendar_gap_audit(frame(spark, sf, "book"), "maturity_date", loaded)


# As-of

@registry.add(
    "C17_asof",
    """
SELECT t.note_id, t.asset, t.start_date,
       (SELECT max_by(f.close, f.fixing_date) FROM {d_fixings} f
        WHERE f.asset = t.asset AND f.fixing_date <= t.start_date) AS last_close
FROM {terms} t""",
)
def asof_quotes(spark, sf):
    notes = frame(spark, sf, "terms").select("note_id", "asset", "start_date")
    series = daily(spark, sf).select("asset", F.col("fixing_date").alias("start_date"), "close")
    return asof(notes, series, ["asset"], "start_date", "close", "last_close")


# Accrual

DI_ROWS = """
SELECT t.note_id, r.rate_date, t.di_pct, power(CAST(r.rate AS DOUBLE) / 100 + 1, 1.0 / 252) - 1 AS tdi
FROM {terms} t LEFT JOIN {rates} r ON r.rate_date >= t.start_date AND r.rate_date < t.end_date"""
# Whole numbers throughout: the factor in units of 1e-8, each day's step in units of 1e-14. A half
# at the ninth decimal is common (half of a daily rate), and a double would round it either way.
DI_HANDBOOK = f"""
SELECT note_id, CAST(CAST(list_reduce(list_prepend(CAST(100000000 AS HUGEINT),
         list(CAST(100000000000000 AS HUGEINT) + coalesce(CAST(round(tdi * 100000000) AS HUGEINT), 0)
              * CAST(di_pct * 10000 AS HUGEINT) ORDER BY rate_date)),
         lambda a, b: (a * b + 50000000000000) // 100000000000000) AS DECIMAL(18,0))
       * CAST(0.00000001 AS DECIMAL(9,8)) AS DECIMAL(18,8)) AS di
FROM ({DI_ROWS}) d GROUP BY note_id"""


def _di(spark, sf, rounding):
    return accrual.di_factor(
        frame(spark, sf, "terms"), frame(spark, sf, "rates"), "start_date", "end_date", "di_pct", "di", rounding
    )


@registry.add(
    "L1_di_factor",
    f"SELECT note_id, {sql_rounded('product(1 + coalesce(tdi, 0) * CAST(di_pct AS DOUBLE) / 100)')} AS di "
    f"FROM ({DI_ROWS}) d GROUP BY note_id",
)
def di_factor(spark, sf):
    return _di(spark, sf, "none").select("note_id", rounded("di"))


@registry.add("L1_di_factor_handbook", f"SELECT note_id, di FROM ({DI_HANDBOOK}) h")
def di_factor_handbook(spark, sf):
    return _di(spark, sf, "handbook").select("note_id", "di")


DU = """
SELECT b.note_id, y.bd_index - x.bd_index AS du, CAST(5 + b.note_id % 10 AS DOUBLE) AS rate
FROM {book} b JOIN {d_calendar} x ON x.day = b.issue_date JOIN {d_calendar} y ON y.day = b.maturity_date"""


def _with_du(spark, sf):
    notes = frame(spark, sf, "book").select(
        "note_id", "issue_date", "maturity_date", (5 + F.col("note_id") % 10).alias("rate")
    )
    return calendar.business_days_between(notes, "issue_date", "maturity_date", brazil(spark), "du")


@registry.add(
    "L2_pre_factor", f"SELECT note_id, du, {sql_rounded('power(1 + rate / 100, du / 252.0)')} AS pre FROM ({DU}) d"
)
def pre_factor(spark, sf):
    notes = _with_du(spark, sf).withColumn("pre", accrual.pre_factor(F.col("rate"), F.col("du")))
    return notes.select("note_id", "du", rounded("pre"))


@registry.add(
    "L3_ipca_factor",
    f"""
WITH known AS (
 SELECT d, (SELECT max_by(ni, month) FROM {{ipca_index}} i WHERE i.published_on < d) AS ni
 FROM (SELECT issue_date AS d FROM {{book}} b UNION SELECT maturity_date FROM {{book}} c) s)
SELECT b.note_id, {sql_rounded('1 + (CAST(n.ni AS DOUBLE) / CAST(z.ni AS DOUBLE) - 1) * (90 + b.note_id % 20) / 100')} AS ipca
FROM {{book}} b JOIN known z ON z.d = b.issue_date JOIN known n ON n.d = b.maturity_date""",
)
def ipca_factor(spark, sf):
    notes = frame(spark, sf, "book").select(
        "note_id", "issue_date", "maturity_date", (90 + F.col("note_id") % 20).alias("pct")
    )
    index = frame(spark, sf, "ipca_index")
    factors = accrual.ipca_factor(notes, index, "issue_date", "maturity_date", "pct", "ipca")
    return factors.select("note_id", rounded("ipca"))


SPREAD = """
SELECT b.note_id, CASE CAST(b.note_id % 3 AS INT)
  WHEN 0 THEN power(1 + (1 + b.note_id % 12) / 100, (y.bd_index - x.bd_index) / 252.0)
  WHEN 1 THEN power(1 + (1 + b.note_id % 12) / 100, (b.maturity_date - b.issue_date) / 360.0)
  ELSE 1 + (1 + b.note_id % 12) / 100 * (b.maturity_date - b.issue_date) / 360.0 END AS spread
FROM {book} b JOIN {d_calendar} x ON x.day = b.issue_date JOIN {d_calendar} y ON y.day = b.maturity_date"""


def _spread(spark, sf):
    basis = F.element_at(F.array(*[F.lit(x) for x in ("252 exp", "360 exp", "360 lin")]), (F.col("note_id") % 3 + 1).cast("int"))
    notes = frame(spark, sf, "book").select(
        "note_id", "issue_date", "maturity_date", (1 + F.col("note_id") % 12).alias("rate"), basis.alias("basis")
    )
    return accrual.spread_factor(notes, "rate", "basis", "issue_date", "maturity_date", brazil(spark), "spread")


@registry.add("L4_spread_factor", f"SELECT note_id, {sql_rounded('spread', 9)} AS spread FROM ({SPREAD}) s")
def spread_factor(spark, sf):
    return _spread(spark, sf).select("note_id", "spread")


@registry.add(
    "L5_interest_factor",
    "SELECT s.note_id, CAST(CAST(h.di AS DECIMAL(18,8)) * CAST(round(s.spread, 9) AS DECIMAL(18,9)) AS DECIMAL(18,9)) AS interest "
    f"FROM ({SPREAD}) s JOIN ({DI_HANDBOOK}) h ON h.note_id = s.note_id",
)
def interest_factor(spark, sf):
    joined = _spread(spark, sf).select("note_id", "spread").join(_di(spark, sf, "handbook").select("note_id", "di"), "note_id")
    return joined.select("note_id", accrual.interest_factor(F.col("di"), F.col("spread")).alias("interest"))


@registry.add(
    "L6_issue_budget",
    f"""
SELECT note_id, {sql_rounded('z')} AS zero_coupon, {sql_rounded('1 - z')} AS budget,
       {sql_rounded('(1 - z - 0.01) / (0.2 + (note_id % 10) / 100)')} AS participation
FROM (SELECT note_id, 1 / power(1 + rate / 100, du / 252.0) AS z FROM ({DU}) d) p""",
)
def issue_budget(spark, sf):
    notes = _with_du(spark, sf).withColumns(
        {"margin": F.lit(0.01), "option_price": 0.2 + (F.col("note_id") % 10) / 100}
    )
    priced = accrual.issue_budget(notes, "rate", "du", "margin", "option_price")
    return priced.select("note_id", rounded("zero_coupon"), rounded("budget"), rounded("participation"))


# Fixings and performance

@registry.add("M1_daily_fixings", "SELECT * FROM {d_fixings} f")
def daily_fixings(spark, sf):
    return daily(spark, sf)


@registry.add(
    "M2_attach_fixings",
    """
SELECT t.note_id, c.next_bd AS fixing_date,
       CASE t.quote_type WHEN 'close' THEN f.close WHEN 'avg' THEN f.avg WHEN 'high' THEN f.high ELSE f.low END AS price
FROM {terms} t LEFT JOIN {d_calendar} c ON c.day = t.end_date
LEFT JOIN {d_fixings} f ON f.asset = t.asset AND f.fixing_date = c.next_bd""",
)
def attach_fixings(spark, sf):
    schedule = frame(spark, sf, "terms").select("note_id", "asset", "end_date", "quote_type")
    fixed = fixings.attach_fixings(schedule, daily(spark, sf), "end_date", "quote_type", brazil(spark))
    return fixed.select("note_id", "fixing_date", "price")


def initial(spark, sf):
    return fixings.window_value(
        frame(spark, sf, "windows"), daily(spark, sf), "start_date", "start_until", "quote_type", "criterion", "n",
        "s0", from_end=False,
    )


def final(spark, sf, notes=None):
    notes = frame(spark, sf, "windows") if notes is None else notes
    return fixings.window_value(
        notes, daily(spark, sf), "end_from", "end_date", "quote_type", "criterion", "n", "st", from_end=True
    )


def performance(spark, sf):
    return fixings.note_performance(final(spark, sf, initial(spark, sf)))


@registry.add(
    "M3_initial_value",
    "SELECT w.note_id, i.s0 FROM {windows} w LEFT JOIN {d_initial} i ON i.note_id = w.note_id",
)
def initial_value(spark, sf):
    return initial(spark, sf).select("note_id", "s0")


@registry.add(
    "M4_final_value", "SELECT w.note_id, f.st FROM {windows} w LEFT JOIN {d_final} f ON f.note_id = w.note_id"
)
def final_value(spark, sf):
    return final(spark, sf).select("note_id", "st")


@registry.add("M5_note_performance", f"SELECT note_id, s0, st, {exact_change('st', 's0')} AS perf FROM {{d_perf}} p")
def note_performance(spark, sf):
    return performance(spark, sf).select("note_id", "s0", "st", rounded("perf"))


@registry.add(
    "M6_fx_performance",
    f"""
WITH f AS (SELECT * FROM {{fx}} x)
SELECT w.note_id, {sql_rounded('''CASE WHEN w.quanto THEN CAST(p.st AS DOUBLE) / CAST(p.s0 AS DOUBLE) - 1 ELSE
  (CAST(p.st AS DOUBLE) * (SELECT CAST(max_by(rate, quoted_on) AS DOUBLE) FROM f WHERE f.currency = w.currency AND quoted_on <= w.end_date))
  / (CAST(p.s0 AS DOUBLE) * (SELECT CAST(max_by(rate, quoted_on) AS DOUBLE) FROM f WHERE f.currency = w.currency AND quoted_on <= w.start_date)) - 1 END''')}
  AS fx_perf
FROM {{windows}} w JOIN {{d_perf}} p ON p.note_id = w.note_id""",
)
def fx_performance(spark, sf):
    priced = fixings.fx_performance(performance(spark, sf), frame(spark, sf, "fx"), "start_date", "end_date")
    return priced.select("note_id", rounded("fx_perf"))


@registry.add(
    "M7_basket_performance",
    """
SELECT note_id, CAST(round(CAST(sum(weight * perf) AS DOUBLE) / 100, 8) AS DECIMAL(28,8)) AS weighted,
       min(perf) AS worst, max(perf) AS best
FROM (SELECT note_id, weight, CAST(rate - spread AS DECIMAL(9,4)) AS perf FROM {note_rows} r) c GROUP BY note_id""",
)
def basket_performance(spark, sf):
    rows = frame(spark, sf, "note_rows").select(
        "note_id", "weight", (F.col("rate") - F.col("spread")).cast("decimal(9,4)").alias("perf")
    )
    return fixings.basket_performance(rows).withColumn("weighted", F.col("weighted").cast("decimal(28,8)"))


@registry.add(
    "M8_barrier_hit",
    """
SELECT b.note_id, h.first_breach, h.first_breach IS NOT NULL AS hit FROM {barriers} b LEFT JOIN (
 SELECT note_id, min(day) AS first_breach FROM {d_observed} o
 WHERE (observation = 'american' OR (observation = 'european' AND day = end_date)
        OR (observation = 'discrete' AND (day - start_date) % 3 = 0))
   AND CASE WHEN direction = 'up' THEN price >= level ELSE price < level END
 GROUP BY 1) h ON h.note_id = b.note_id""",
)
def barrier_hit(spark, sf):
    notes = frame(spark, sf, "barriers").withColumn(
        "schedule", F.sequence("start_date", "end_date", F.expr("interval 3 day"))
    )
    hits = fixings.barrier_hit(
        notes, daily(spark, sf), "start_date", "end_date", "quote_type", "observation", "level", "direction"
    )
    return hits.select("note_id", "first_breach", "hit")


@registry.add(
    "M9_days_in_range",
    """
SELECT b.note_id, coalesce(c.n_in, 0) AS n_in, l.n_all, l.n_all - coalesce(c.n_found, 0) AS n_missing FROM {barriers} b JOIN {d_lengths} l ON l.note_id = b.note_id LEFT JOIN (
 SELECT note_id, count(*) FILTER (price >= low AND price <= high) AS n_in, count(*) AS n_found
 FROM {d_scheduled} o GROUP BY 1) c ON c.note_id = b.note_id""",
)
def days_in_range(spark, sf):
    counted = fixings.days_in_range(
        frame(spark, sf, "barriers"), daily(spark, sf), "start_date", "end_date", "quote_type", "low", "high", brazil(spark)
    )
    return counted.select("note_id", "n_in", "n_all", "n_missing")
