"""Queries over payoffs: single-date figures, path figures, audits and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikebook.functions.exact import at_least, level
from strikebook.operators import accrual, calendar, fixings, payoffs
from strikebook.plans.frames import exact_change, frame
from strikebook.plans.market import DI_ROWS, brazil, daily, performance
from strikebook.plans.registry import Registry

registry = Registry()
c = F.col


def settled(redemption):
    """The redemption, or null and a reason where a note has no fixing at either end."""
    known = c("perf").isNotNull()
    return F.when(known, redemption).alias("redemption"), F.when(~known, "no fixing").alias("reason")


def sql_settled(redemption: str) -> str:
    """DuckDB text of both columns."""
    return f"CASE WHEN perf IS NOT NULL THEN {redemption} END AS redemption, CASE WHEN perf IS NULL THEN 'no fixing' END AS reason"


HUNDREDTH = "CAST(0.01 AS DECIMAL(3,2))"


def pct(text: str) -> str:
    """DuckDB text of a percentage as an exact fraction."""
    return f"CAST(CAST({text} AS DECIMAL(9,4)) * {HUNDREDTH} AS DECIMAL(12,6))"


def mul(rate: str, value: str) -> str:
    """DuckDB text of a product rounded to 16 decimals."""
    return f"CAST({rate} * CAST({value} AS DECIMAL(22,16)) AS DECIMAL(22,16))"


def part_of(n: str, total: str) -> str:
    """DuckDB text of a quotient of counts rounded to 16 decimals; zero when there are none."""
    units = f"(2 * CAST({n} AS HUGEINT) * 10000000000000000 + {total}) // (2 * {total})"
    unit = "CAST(0.0000000000000001 AS DECIMAL(17,16))"
    return f"CASE WHEN {total} = 0 THEN CAST(0 AS DECIMAL(22,16)) ELSE CAST(CAST({units} AS DECIMAL(20,0)) * {unit} AS DECIMAL(22,16)) END"


def paid(multiple: str, nominal: str = "vn") -> str:
    """DuckDB text of ``nominal * multiple`` cut to cents, exact."""
    scaled = f"CAST(CAST({nominal} AS DECIMAL(14,2)) * 100 AS DECIMAL(14,0)) * CAST({multiple} AS DECIMAL(22,16))"
    return f"CAST(CAST(floor({scaled}) AS DECIMAL(16,0)) * {HUNDREDTH} AS DECIMAL(18,2))"


PART, CAP, COUPON = pct("participation"), pct("cap"), pct("coupon")
PERF = "{d_perf} p"


def single(name: str, multiple: str):
    """Register a figure paid on one final fixing."""
    return registry.add(name, f"SELECT note_id, {sql_settled(paid(multiple))} FROM {PERF}")


@single("N1_call_participation", f"1 + {mul(PART, 'greatest(perf, 0)')}")
def call_participation(spark, sf):
    paid = payoffs.call_participation(c("vn"), c("perf"), c("participation"))
    return performance(spark, sf).select("note_id", *settled(paid))


@single("N2_call_spread", "1 + " + mul(PART, f"least(greatest(perf, 0), {CAP})"))
def call_spread(spark, sf):
    paid = payoffs.call_spread(c("vn"), c("perf"), c("participation"), c("cap"))
    return performance(spark, sf).select("note_id", *settled(paid))


@single("N3_put_spread", "1 + " + mul(PART, f"least(greatest(-perf, 0), {CAP})"))
def put_spread(spark, sf):
    paid = payoffs.put_spread(c("vn"), c("perf"), c("participation"), c("cap"))
    return performance(spark, sf).select("note_id", *settled(paid))


@registry.add(
    "N4_digital",
    f"""
SELECT p.note_id, {sql_settled(paid(f"CASE WHEN st * 100 >= s0 * trigger_pct THEN 1 + {COUPON} ELSE CAST(d.di AS DECIMAL(22,16)) END"))}
FROM {PERF} JOIN (SELECT note_id, product(1 + coalesce(tdi, 0) * CAST(di_pct AS DOUBLE) / 100) AS di
                  FROM ({DI_ROWS}) r GROUP BY note_id) d ON d.note_id = p.note_id""",
)
def digital(spark, sf):
    notes = accrual.di_factor(performance(spark, sf), frame(spark, sf, "rates"), "start_date", "end_date", "di_pct", "di")
    above = at_least(c("st"), c("trigger_pct"), c("s0"))
    return notes.select("note_id", *settled(payoffs.digital(c("vn"), above, c("coupon"), c("di"))))


LEVEL = "CAST(CAST(s0 AS DECIMAL(18,8)) * CAST({pct} AS DECIMAL(9,4)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,8))"


def _breaches(condition: str) -> str:
    """DuckDB text: notes with a day in their window that satisfies ``condition``."""
    return f"""
SELECT DISTINCT p.note_id FROM {{d_perf}} p
JOIN {{d_fixings}} f ON f.asset = p.asset AND f.fixing_date BETWEEN p.start_date AND p.end_date
WHERE CASE p.quote_type WHEN 'close' THEN f.close WHEN 'avg' THEN f.avg WHEN 'high' THEN f.high ELSE f.low END {condition}"""


@registry.add(
    "N5_shark_fin",
    f"""
SELECT note_id, {sql_settled(paid(f"1 + CASE WHEN ko THEN {COUPON} ELSE {mul(PART, 'greatest(perf, 0)')} END"))}
FROM (SELECT p.*, CASE WHEN note_id % 2 = 0 THEN st * 100 >= s0 * upper_pct
             ELSE note_id IN ({_breaches(">= " + LEVEL.replace("{pct}", "p.upper_pct"))}) END AS ko FROM {PERF}) k""",
)
def shark_fin(spark, sf):
    notes = performance(spark, sf).withColumns(
        {"observation": F.lit("american"), "direction": F.lit("up"), "level": level(c("s0"), c("upper_pct"))}
    )
    watched = fixings.barrier_hit(
        notes, daily(spark, sf), "start_date", "end_date", "quote_type", "observation", "level", "direction"
    )
    european = at_least(c("st"), c("upper_pct"), c("s0"))
    knocked_out = F.when(c("note_id") % 2 == 0, european).otherwise(c("hit"))
    paid = payoffs.shark_fin(c("vn"), c("perf"), knocked_out, c("participation"), c("coupon"))
    return watched.select("note_id", *settled(paid))


RANGE = """(SELECT b.*, coalesce(o.n_in, 0) AS n_in, l.n_all FROM {barriers} b JOIN {d_lengths} l ON l.note_id = b.note_id LEFT JOIN (
  SELECT note_id, count(*) FILTER (price >= low AND price <= high) AS n_in FROM {d_scheduled} x GROUP BY 1) o ON o.note_id = b.note_id) r"""


@registry.add(
    "N6_range_accrual",
    f"""
SELECT note_id, {paid("1 + " + mul(COUPON, part_of("n_in", "n_all")))} AS linear,
       {paid("power(1 + CAST(coupon AS DOUBLE) / 100, n_in / 252.0)")} AS exponential,
       {paid("1 + " + mul(COUPON, part_of("n_in", "252")))} AS linear252
FROM {RANGE}""",
)
def range_accrual(spark, sf):
    counted = fixings.days_in_range(
        frame(spark, sf, "barriers"), daily(spark, sf), "start_date", "end_date", "quote_type", "low", "high", brazil(spark)
    )
    modes = [
        payoffs.range_accrual(c("vn"), c("coupon"), c("n_in"), c("n_all"), mode).alias(mode)
        for mode in ("linear", "exponential", "linear252")
    ]
    return counted.select("note_id", *modes)


@single(
    "N9_booster",
    f"CASE WHEN perf >= 0 THEN 1 + (1 + note_id % 3) * least(perf, {CAP}) ELSE greatest(1 + perf, 0) END",
)
def booster(spark, sf):
    paid = payoffs.booster(c("vn"), c("perf"), 1 + c("note_id") % 3, c("cap"))
    return performance(spark, sf).select("note_id", *settled(paid))


@single(
    "N10_reverse_convertible",
    f"1 + {COUPON} + CASE WHEN st * 100 >= s0 * lower_pct THEN 0 ELSE perf END",
)
def reverse_convertible(spark, sf):
    breached = ~at_least(c("st"), c("lower_pct"), c("s0"))
    paid = payoffs.reverse_convertible(c("vn"), c("perf"), breached, c("coupon"))
    return performance(spark, sf).select("note_id", *settled(paid))


@registry.add(
    "N10_reverse_convertible_american",
    f"""
SELECT note_id, {sql_settled(paid(f"1 + {COUPON} + CASE WHEN b THEN perf ELSE 0 END"))}
FROM (SELECT p.*, note_id IN ({_breaches("< " + LEVEL.replace("{pct}", "p.lower_pct"))}) AS b FROM {PERF}) k""",
)
def reverse_convertible_american(spark, sf):
    notes = performance(spark, sf).withColumns(
        {"observation": F.lit("american"), "direction": F.lit("down"), "level": level(c("s0"), c("lower_pct"))}
    )
    watched = fixings.barrier_hit(
        notes, daily(spark, sf), "start_date", "end_date", "quote_type", "observation", "level", "direction"
    )
    paid = payoffs.reverse_convertible(c("vn"), c("perf"), c("hit"), c("coupon"))
    return watched.select("note_id", *settled(paid))


@single(
    "N11_twin_win",
    f"1 + CASE WHEN perf >= 0 THEN {mul(PART, 'perf')} WHEN st * 100 >= s0 * lower_pct "
    f"THEN {mul(CAP, 'abs(perf)')} ELSE perf END",
)
def twin_win(spark, sf):
    breached = ~at_least(c("st"), c("lower_pct"), c("s0"))
    paid = payoffs.twin_win(c("vn"), c("perf"), breached, c("participation"), c("cap"))
    return performance(spark, sf).select("note_id", *settled(paid))


DI_FREE = f"""(SELECT note_id, product(1 + coalesce(tdi, 0) * CAST(di_pct AS DOUBLE) / 100) AS di
  FROM ({DI_ROWS}) r GROUP BY note_id)"""


def _with_di(spark, sf, start="start_date", notes=None):
    notes = frame(spark, sf, "terms") if notes is None else notes
    return accrual.di_factor(notes, frame(spark, sf, "rates"), start, "end_date", "di_pct", "di")


@registry.add(
    "N12_conditional_return",
    f"""
SELECT t.note_id, greatest({paid("round(d.di, 8)", "principal")},
                           {paid(pct("80 + t.note_id % 41"), "principal")}) AS redemption
FROM {{terms}} t JOIN {DI_FREE} d ON d.note_id = t.note_id""",
)
def conditional_return(spark, sf):
    interest = F.round(c("di").cast("decimal(38,18)"), 8)
    paid = payoffs.conditional_return(c("principal"), interest, 80 + c("note_id") % 41)
    return _with_di(spark, sf).select("note_id", paid.alias("redemption"))


@registry.add(
    "N13_indexer_switch",
    f"""
WITH w AS (SELECT *, start_date + 5 AS switch_date FROM {{terms}} t),
d AS (SELECT w.note_id, product(1 + coalesce(power(CAST(r.rate AS DOUBLE) / 100 + 1, 1.0 / 252) - 1, 0)
                                * CAST(w.di_pct AS DOUBLE) / 100) AS di
      FROM w LEFT JOIN {{rates}} r ON r.rate_date >= w.switch_date AND r.rate_date < w.end_date GROUP BY 1)
SELECT w.note_id, {paid("power(1 + CAST(coupon AS DOUBLE) / 100, (y.bd_index - x.bd_index) / 252.0) * d.di")} AS redemption
FROM w JOIN d ON d.note_id = w.note_id
JOIN {{d_calendar}} x ON x.day = w.start_date JOIN {{d_calendar}} y ON y.day = w.switch_date""",
)
def indexer_switch(spark, sf):
    notes = frame(spark, sf, "terms").withColumn("switch_date", F.date_add("start_date", 5))
    counted = calendar.business_days_between(notes, "start_date", "switch_date", brazil(spark), "du")
    both = _with_di(spark, sf, "switch_date", counted)
    pre = accrual.pre_factor(c("coupon"), c("du"))
    return both.select("note_id", payoffs.indexer_switch(pre, c("di"), c("vn")).alias("redemption"))


@registry.add(
    "N14_wedding_cake",
    f"""
SELECT note_id, {paid("1 + " + mul(pct("coupon + 4"), part_of("n_1", "n_all")) + " + " + mul(pct("coupon + 2"), part_of("(n_2 - n_1)", "n_all"))
         + " + " + mul(pct("coupon"), part_of("(n_3 - n_2)", "n_all")))} AS redemption
FROM (SELECT b.note_id, b.vn, b.coupon, l.n_all,
        count(*) FILTER (price BETWEEN low + 20 AND high - 20) AS n_1,
        count(*) FILTER (price BETWEEN low + 10 AND high - 10) AS n_2,
        count(*) FILTER (price BETWEEN low AND high) AS n_3
      FROM {{barriers}} b JOIN {{d_lengths}} l ON l.note_id = b.note_id
      LEFT JOIN (SELECT note_id AS obs_note, price FROM {{d_scheduled}} x) o ON o.obs_note = b.note_id
      GROUP BY 1, 2, 3, 4) g""",
)
def wedding_cake(spark, sf):
    notes = frame(spark, sf, "barriers")
    days = brazil(spark)
    blocks = fixings.scheduled_blocks(notes, daily(spark, sf), "start_date", "end_date", "quote_type", days)

    def inside(margin):
        return F.size(
            F.filter("observed", lambda d: (d["price"] >= c("low") + margin) & (d["price"] <= c("high") - margin))
        )

    counts = (
        blocks.select("note_id", *[inside(m).alias(f"n_{k}") for k, m in ((1, 20), (2, 10), (3, 0))])
        .groupBy("note_id")
        .agg(*[F.sum(n).alias(n) for n in ("n_1", "n_2", "n_3")])
    )
    joined = notes.join(counts, "note_id", "left").fillna(0, ["n_1", "n_2", "n_3"])
    joined = joined.withColumn("n_all", fixings.schedule_length("start_date", "end_date", days))
    for k, bonus in ((1, 4), (2, 2), (3, 0)):
        joined = joined.withColumn(f"coupon_{k}", c("coupon") + bonus)
    return payoffs.layered_accrual(joined, 3).select("note_id", "redemption")


@registry.add(
    "N14_edge_accrual",
    f"""
SELECT note_id, {paid("1 + " + mul(COUPON, part_of("n_1", "n_all")))} AS redemption
FROM (SELECT b.note_id, b.vn, b.coupon, l.n_all,
        count(*) FILTER (CASE WHEN direction = 'up' THEN price >= low ELSE price < low END) AS n_1
      FROM {{barriers}} b JOIN {{d_lengths}} l ON l.note_id = b.note_id
      LEFT JOIN (SELECT note_id AS obs_note, price FROM {{d_scheduled}} x) o ON o.obs_note = b.note_id
      GROUP BY 1, 2, 3, 4) g""",
)
def edge_accrual(spark, sf):
    notes = frame(spark, sf, "barriers")
    days = brazil(spark)
    blocks = fixings.scheduled_blocks(notes, daily(spark, sf), "start_date", "end_date", "quote_type", days)
    beyond = F.size(F.filter("observed", lambda d: fixings.breach(d["price"], c("low"), c("direction"))))
    counts = (
        blocks.select("note_id", beyond.alias("n_1"))
        .groupBy("note_id")
        .agg(F.sum("n_1").alias("n_1"))
    )
    joined = notes.join(counts, "note_id", "left").fillna(0, ["n_1"]).withColumn("coupon_1", c("coupon"))
    joined = joined.withColumn("n_all", fixings.schedule_length("start_date", "end_date", days))
    return payoffs.layered_accrual(joined, 1).select("note_id", "redemption")


@registry.add(
    "N15_master_redemption",
    f"""
SELECT note_id, CASE WHEN perf IS NOT NULL THEN greatest({paid(f'''{pct("90 + note_id % 11")} * CAST(1.05 AS DECIMAL(3,2))
   + CASE WHEN note_id % 3 = 0 THEN -1 ELSE 1 END
   * CAST({mul(PART, "greatest(perf, 0)")} AS DECIMAL(20,10)) * CAST(1.02 AS DECIMAL(3,2))''', "principal")},
   {paid(pct("95 + note_id % 6"), "principal")}) END AS redemption, CASE WHEN perf IS NULL THEN 'no fixing' END AS reason
FROM {PERF}""",
)
def master_redemption(spark, sf):
    option = F.round(payoffs.times(payoffs.percent(c("participation")), F.greatest(c("perf"), payoffs.zero())), 10)
    position = F.when(c("note_id") % 3 == 0, "bought").otherwise("sold")
    paid = payoffs.master_redemption(
        c("principal"), F.lit("1.05").cast("decimal(18,8)"), 90 + c("note_id") % 11, position, option,
        F.lit("1.02").cast("decimal(18,8)"), 95 + c("note_id") % 6,
    )
    return performance(spark, sf).select("note_id", *settled(paid))


CARRIED = paid("1 + perf")


@registry.add(
    "N16_modality_floor_audit",
    f"""
SELECT note_id, modality, redemption, floor_amount FROM (
 SELECT note_id, modality, CASE WHEN perf IS NOT NULL THEN {CARRIED} END AS redemption,
   {paid(pct("CASE WHEN modality = 'VNP' THEN greatest(100, lower_pct) ELSE lower_pct END"))} AS floor_amount
 FROM {PERF}) a WHERE redemption IS NULL OR redemption < floor_amount""",
)
def modality_floor_audit(spark, sf):
    paid = performance(spark, sf).select(
        "note_id", "modality", c("vn").alias("principal"), c("lower_pct").alias("guaranteed"),
        payoffs.money(c("vn"), 1 + c("perf")).alias("redemption"),
    )
    return payoffs.modality_floor_audit(paid).select("note_id", "modality", "redemption", "floor_amount")


@registry.add(
    "N17_withholding_tax",
    f"""
SELECT note_id, days, tax, CAST(redemption - tax AS DECIMAL(18,2)) AS net FROM (
 SELECT note_id, days, redemption, CASE WHEN redemption > vn THEN
   {paid(pct("CASE WHEN days <= 180 THEN 22.5 WHEN days <= 360 THEN 20 WHEN days <= 720 THEN 17.5 ELSE 15 END"), "redemption - vn")}
   ELSE 0 END AS tax
 FROM (SELECT p.note_id, p.vn, b.maturity_date - b.issue_date AS days, CASE WHEN perf IS NOT NULL THEN {paid("1 + " + mul(PART, "greatest(perf, 0)"))} END AS redemption
       FROM {PERF} JOIN {{book}} b ON b.note_id = p.note_id) q) t""",
)
def withholding_tax(spark, sf):
    held = frame(spark, sf, "book").select("note_id", F.datediff("maturity_date", "issue_date").alias("days"))
    paid = performance(spark, sf).select(
        "note_id", "vn", settled(payoffs.call_participation(c("vn"), c("perf"), c("participation")))[0]
    )
    taxed = paid.join(held, "note_id").withColumn("tax", payoffs.withholding_tax(c("redemption"), c("vn"), c("days")))
    return taxed.select(
        "note_id", c("days").cast("long").alias("days"), "tax", (c("redemption") - c("tax")).cast("decimal(18,2)").alias("net")
    )


GRID = [-0.4, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4]


@registry.add(
    "N18_scenario_table",
    f"""
SELECT note_id, CAST(perf AS DECIMAL(4,2)) AS scenario, redemption,
       CAST(round(CAST(redemption AS DOUBLE) / CAST(vn AS DOUBLE) - 1, 6) AS DECIMAL(18,6)) AS period_return
FROM (SELECT note_id, vn, perf, {paid("1 + " + mul(PART, f"least(greatest(perf, 0), {CAP})"))} AS redemption
      FROM (SELECT t.*, CAST(unnest({GRID}) AS DECIMAL(22,16)) AS perf FROM {{terms}} t) g) s""",
)
def scenario_table(spark, sf):
    table = payoffs.scenario_table(
        frame(spark, sf, "terms"), GRID, lambda perf: payoffs.call_spread(c("vn"), perf, c("participation"), c("cap"))
    )
    return table.select(
        "note_id", c("scenario").cast("decimal(4,2)").alias("scenario"), "redemption",
        F.round("period_return", 6).cast("decimal(18,6)").alias("period_return"),
    )


# Paths

def watched(spark, sf):
    """Observations up to the last day that has ticks."""
    last = frame(spark, sf, "ticks").agg(F.max("fixing_date")).first()[0]
    return payoffs.observations(
        frame(spark, sf, "autocalls"), daily(spark, sf), "start_date", "end_date", 3, brazil(spark), F.lit(last)
    )


@registry.add("E5_observation_no", "SELECT note_id, obs_date, CAST(obs_no AS INT) AS obs_no, n_obs FROM {d_observations} o")
def observation_no(spark, sf):
    return payoffs.observation_no(watched(spark, sf)).select("note_id", "obs_date", "obs_no", "n_obs")


MEMORY = """
SELECT *, obs_no - 1 - coalesce(max(CASE WHEN paid THEN obs_no END)
   OVER (PARTITION BY note_id ORDER BY obs_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missed
FROM (SELECT *, price * 100 >= s0 * coupon_pct AS paid, price * 100 >= s0 * lower_pct AS kept, price * 100 >= s0 * trigger_pct AS hit FROM {d_observations} o) f"""
ALIVE = f"""
SELECT * EXCLUDE (called, gap), CASE WHEN gap IS NULL OR called < gap THEN called END AS called_no, CASE WHEN called IS NULL OR gap < called THEN gap END AS gap_no
FROM (SELECT *, min(CASE WHEN hit THEN obs_no END) OVER (PARTITION BY note_id) AS called,
   min(CASE WHEN state = 'unresolved' THEN obs_no END) OVER (PARTITION BY note_id) AS gap FROM ({MEMORY}) m) a
WHERE obs_no <= least(coalesce(called, 1000000), coalesce(gap, 1000000))"""


@registry.add("E6_coupon_memory", f"SELECT note_id, obs_date, paid, CAST(missed AS INT) AS missed FROM ({MEMORY}) m")
def coupon_memory(spark, sf):
    memory = payoffs.coupon_memory(payoffs.observation_no(watched(spark, sf)))
    return memory.select("note_id", "obs_date", "paid", "missed")


@registry.add(
    "E7_first_trigger",
    f"SELECT note_id, obs_date, CAST(obs_no AS INT) AS obs_no, CAST(called_no AS INT) AS called_no FROM ({ALIVE}) a",
)
def first_trigger(spark, sf):
    cut = payoffs.first_trigger(payoffs.observation_no(watched(spark, sf)))
    return cut.select("note_id", "obs_date", "obs_no", "called_no")


@registry.add(
    "N7_athena",
    f"""
SELECT note_id, obs_date, coalesce(called_no < n_obs, false) AS early,
       {paid(f'''CASE WHEN called_no IS NOT NULL THEN 1 + {COUPON} * obs_no WHEN price IS NULL THEN NULL
                 WHEN modality = 'VNP' OR kept THEN 1 ELSE 1 + {exact_change('price', 's0', 16)} END''')} AS redemption,
       CASE WHEN gap_no IS NOT NULL THEN 'unresolved' WHEN price IS NULL THEN 'open' END AS reason
FROM ({ALIVE}) a WHERE obs_no = coalesce(called_no, gap_no, n_obs)""",
)
def athena(spark, sf):
    return payoffs.athena(watched(spark, sf)).select("note_id", "obs_date", "early", "redemption", "reason")


PHOENIX = f"""
SELECT note_id, CAST(obs_no AS INT) AS obs_no, obs_date, 'coupon' AS kind,
       {paid(f"{COUPON} * (1 + missed)")} AS amount FROM ({ALIVE}) a WHERE paid
UNION ALL
SELECT note_id, CAST(obs_no AS INT), obs_date, CASE WHEN called_no < n_obs THEN 'early redemption' ELSE 'maturity' END,
       CASE WHEN called_no IS NOT NULL OR kept THEN vn
            ELSE {paid(f"1 + {exact_change('price', 's0', 16)}")} END
FROM ({ALIVE}) b WHERE obs_no = coalesce(called_no, n_obs) AND price IS NOT NULL
UNION ALL
SELECT note_id, CAST(obs_no AS INT), obs_date, 'unresolved', NULL FROM ({ALIVE}) c WHERE obs_no = gap_no"""


@registry.add("N8_phoenix", PHOENIX)
def phoenix(spark, sf):
    return payoffs.phoenix(watched(spark, sf))


@registry.add(
    "N19_lifecycle_events",
    f"""
SELECT note_id, start_date AS event_date, 'issue' AS kind, vn AS amount FROM {{autocalls}} i
UNION ALL SELECT note_id, obs_date, 'observation', NULL FROM ({ALIVE}) w
UNION ALL SELECT p.note_id, CASE WHEN p.kind = 'early redemption' AND t.note_id % 2 = 0 THEN t.end_date ELSE p.obs_date END,
                 p.kind, p.amount FROM ({PHOENIX}) p JOIN {{autocalls}} t ON t.note_id = p.note_id""",
)
def lifecycle_events(spark, sf):
    settles = F.when(c("note_id") % 2 == 0, "maturity").otherwise("trigger")
    notes = frame(spark, sf, "autocalls").withColumn("settles", settles)
    return payoffs.lifecycle_events(notes, watched(spark, sf))
