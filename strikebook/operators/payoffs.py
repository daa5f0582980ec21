"""Redemption of the figures.

Percentages are percent numbers (25 is 25%). Factors carry 16 decimals; money is cut to cents.
Single-date figures are column expressions. Path figures work on observation rows of
(note_id, obs_date), at most one per note and day, so all their windows share one shuffle on the
note and a note's group is bounded by its schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikebook.functions.exact import FACTOR, MONEY, at_least, factor, money, percent, ratio, share, times
from strikebook.functions.truth import largest, smallest
from strikebook.operators.calendar import Calendar


def one() -> Column:
    return F.lit(1).cast("decimal(20,16)")


def zero() -> Column:
    return F.lit(0).cast("decimal(20,16)")


# One final fixing

def call_participation(vn: Column, perf: Column, part: Column) -> Column:
    return money(vn, 1 + times(percent(part), largest(perf, zero())))


def capped_move(vn: Column, move: Column, part: Column, cap: Column) -> Column:
    """Participation in a one-sided move up to a cap; the call and the put spread share it."""
    return money(vn, 1 + times(percent(part), smallest(largest(move, zero()), percent(cap))))


def call_spread(vn: Column, perf: Column, part: Column, cap: Column) -> Column:
    return capped_move(vn, perf, part, cap)


def put_spread(vn: Column, perf: Column, part: Column, cap: Column) -> Column:
    return capped_move(vn, -perf, part, cap)


def digital(vn: Column, above: Column, coupon: Column, di: Column) -> Column:
    """Fixed coupon at or above the strike, else the DI leg (a factor of 1 when there is none)."""
    return money(vn, F.when(above, 1 + percent(coupon)).otherwise(F.coalesce(di.cast(FACTOR), one())))


def shark_fin(vn: Column, perf: Column, knocked_out: Column, part: Column, rebate: Column) -> Column:
    """Rebate once knocked out, else participation in the rise."""
    paid = F.when(knocked_out, percent(rebate)).otherwise(times(percent(part), largest(perf, zero())))
    return money(vn, 1 + paid)


def range_accrual(vn: Column, coupon: Column, n_in: Column, n_all: Column, mode: str = "linear") -> Column:
    """Coupon by observations in range: share of a maximum, or an annual rate over those days."""
    rate = percent(coupon)
    if mode == "linear":
        accrued = times(rate, F.coalesce(share(n_in, n_all), zero()))
    elif mode == "linear252":
        accrued = times(rate, share(n_in, F.lit(252)))
    elif mode == "exponential":
        accrued = (F.pow(1 + rate.cast("double"), n_in / F.lit(252.0)) - 1).cast("decimal(20,16)")
    else:
        raise ValueError(f"unknown accrual mode {mode!r}")
    return money(vn, 1 + accrued)


def booster(vn: Column, perf: Column, boost: Column, cap: Column) -> Column:
    """Geared rise up to a cap; the fall is carried in full, but never below nothing."""
    up = 1 + times(boost.cast("decimal(16,8)"), smallest(perf, percent(cap)))
    return money(vn, F.when(perf >= 0, up).otherwise(largest(1 + perf, zero())))


def reverse_convertible(vn: Column, perf: Column, breached: Column, coupon: Column) -> Column:
    return money(vn, F.when(breached, 1 + perf + percent(coupon)).otherwise(1 + percent(coupon)))


def twin_win(vn: Column, perf: Column, breached: Column, up: Column, down: Column) -> Column:
    """Both directions pay until the barrier breaks; then the fall is the investor's."""
    gain = (
        F.when(perf >= 0, times(percent(up), perf))
        .when(breached, perf)
        .otherwise(times(percent(down), F.abs(perf)))
    )
    return money(vn, 1 + gain)


def conditional_return(principal: Column, interest: Column, guaranteed: Column) -> Column:
    return largest(money(principal, interest), money(principal, percent(guaranteed)))


def master_redemption(
    principal: Column, accrued: Column, base: Column, position: Column, option: Column, fx: Column, guaranteed: Column
) -> Column:
    """Accrued base leg plus signed option result, floored at the guaranteed capital.

    ``accrued`` and ``option`` are multiples of the principal; ``position`` is 'bought' (-1) or
    'sold' (+1) from the issuer's side.
    """
    sign = F.when(position == "bought", -1).when(position == "sold", 1)
    leg = times(percent(base), accrued)
    moved = factor(option.cast("decimal(18,10)") * fx.cast("decimal(18,10)")) * sign
    return largest(money(principal, leg + moved), money(principal, percent(guaranteed)))


# Days held and the withholding rate up to them, then the rate beyond.
TAX_STEPS = [(180, "22.5"), (360, "20"), (720, "17.5")]
TAX_BEYOND = "15"


def withholding_tax(redemption: Column, principal: Column, days: Column) -> Column:
    """Tax on a gain by days held; no gain, no tax."""
    rate = F.lit(TAX_BEYOND)
    for limit, pct in reversed(TAX_STEPS):
        rate = F.when(days <= limit, F.lit(pct)).otherwise(rate)
    gain = (redemption - principal).cast(MONEY)
    return F.when(gain > 0, money(gain, percent(rate.cast("decimal(9,4)")))).otherwise(F.lit(0).cast(MONEY))


def modality_floor_audit(notes: DataFrame) -> DataFrame:
    """Redemptions under the guaranteed share of the principal, which is 100% at least for VNP.

    A note without a redemption can't be cleared and is listed too.
    """
    floor_pct = F.when(
        F.col("modality") == "VNP", F.greatest(F.col("guaranteed"), F.lit(100).cast("decimal(9,4)"))
    ).otherwise(F.col("guaranteed"))
    return notes.withColumn("floor_amount", money(F.col("principal"), percent(floor_pct))).filter(
        F.col("redemption").isNull() | (F.col("redemption") < F.col("floor_amount"))
    )


def scenario_table(notes: DataFrame, performances: list[float], redemption) -> DataFrame:
    """Each note under each hypothetical performance; the grid is an array, not a second table."""
    grid = F.array(*[F.lit(str(p)).cast("decimal(20,16)") for p in performances])
    moved = notes.withColumn("scenario", F.explode(grid))
    paid = moved.withColumn("redemption", redemption(F.col("scenario")))
    change = ratio(F.col("redemption"), F.col("vn")) - 1
    return paid.withColumn("period_return", change.cast("decimal(18,8)"))


def indexer_switch(pre: Column, di: Column, vn: Column) -> Column:
    """Two periods chained at the switch date: a fixed rate, then DI.

    The figure's formula is not published; chaining the two factors is this library's reading.
    """
    return money(vn, factor(pre.cast("decimal(18,12)") * di.cast("decimal(18,12)")))


def layered_accrual(counts: DataFrame, layers: int) -> DataFrame:
    """Redemption of nested ranges from ``n_1..n_k`` (innermost first), ``coupon_1..k``, ``n_all``.

    Not published as a formula either. Reading: an observation earns the coupon of the narrowest
    range that contains it. A one-sided accrual is a single layer with an open end.
    """
    earned, inner = zero(), F.lit(0)
    for k in range(1, layers + 1):
        ring = share(F.col(f"n_{k}") - inner, F.col("n_all"))
        earned = earned + times(percent(F.col(f"coupon_{k}")), F.coalesce(ring, zero()))
        inner = F.col(f"n_{k}")
    return counts.withColumn("redemption", money(F.col("vn"), 1 + earned))


# Paths

def registered_schedule(schedule: DataFrame, calendar: Calendar | None = None) -> DataFrame:
    """Rows (note_id, scheduled_on, ...) numbered in the order of the schedule, with ``n_obs`` and the rolled ``obs_date``.

    A row may bring its own trigger_pct, coupon_pct (what a coupon needs) and lower_pct (what protects the principal).
    """
    numbered = schedule.withColumns(
        {
            "obs_no": F.row_number().over(_note().orderBy("scheduled_on")),
            "n_obs": F.count("*").over(_note()),
        }
    )
    day = F.col("scheduled_on")
    return numbered.withColumn("obs_date", day if calendar is None else calendar.next_open(day))


def observations(
    notes: DataFrame, fixings: DataFrame, start: str, end: str, step_days: int, calendar: Calendar | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """The registered observation dates of each note with their numbers and fixings.

    Numbers and their count come from the schedule; dates that are no business days roll to the following one. A
    note's ``step_down`` lowers its trigger from one date to the next.
    """
    days = F.sequence(F.col(start), F.col(end), F.expr(f"interval {step_days} day"))
    dated = notes.withColumn("n_obs", F.size(days).cast("long")).select("*", F.posexplode(days).alias("_at", "scheduled_on"))
    dated = dated.withColumn("obs_no", F.col("_at") + 1)
    if "step_down" in notes.columns:
        lowered = F.col("trigger_pct") - F.col("step_down") * F.col("_at")
        dated = dated.withColumn("trigger_pct", lowered.cast("decimal(9,4)"))
    day = F.col("scheduled_on")
    dated = dated.drop("_at").withColumn("obs_date", day if calendar is None else calendar.next_open(day))
    return observed(dated, fixings, as_of)


def observed(schedule: DataFrame, fixings: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The schedule with prices and states: fixed, open, or unresolved where ``as_of`` is past a date without a fixing.

    Without ``as_of`` all dates without a fixing are open.
    """
    closes = fixings.select("asset", F.col("fixing_date").alias("obs_date"), F.col("close").alias("price"))
    past = F.lit(False) if as_of is None else F.coalesce(F.col("obs_date") <= as_of, F.lit(False))
    state = F.when(F.col("price").isNotNull(), "fixed").when(past, "unresolved").otherwise("open")
    return schedule.join(closes, ["asset", "obs_date"], "left").withColumn("state", state)


def _note() -> Window:
    return Window.partitionBy("note_id")


def observation_no(obs: DataFrame) -> DataFrame:
    """Position of each observation and how many the note has; registered numbers stay as they are."""
    if "obs_no" in obs.columns:
        return obs
    return obs.withColumns(
        {
            "obs_no": F.row_number().over(_note().orderBy("obs_date")),
            "n_obs": F.count("*").over(_note()),
        }
    )


def _coupon_barrier(obs: DataFrame) -> Column:
    """What a coupon needs; notes that register one level use it for the principal too."""
    return F.coalesce("coupon_pct", "lower_pct") if "coupon_pct" in obs.columns else F.col("lower_pct")


def first_trigger(numbered: DataFrame) -> DataFrame:
    """First observation at or above its trigger; later observations are cut.

    An unresolved date before it leaves open whether the note lives on: it is the last row, named in ``gap_no``.
    """
    hit = at_least(F.col("price"), F.col("trigger_pct"), F.col("s0"))
    called = F.min(F.when(hit, F.col("obs_no"))).over(_note())
    unresolved = F.col("state") == "unresolved" if "state" in numbered.columns else F.lit(False)
    gap = F.min(F.when(unresolved, F.col("obs_no"))).over(_note())
    df = numbered.withColumns({"called_no": called, "gap_no": gap})
    stop = F.least("called_no", "gap_no")
    df = df.where(stop.isNull() | (F.col("obs_no") <= stop))
    before = F.coalesce(F.col("gap_no") < F.col("called_no"), F.col("gap_no").isNotNull())
    return df.withColumns({"called_no": F.when(~before, F.col("called_no")), "gap_no": F.when(before, F.col("gap_no"))})


def coupon_memory(numbered: DataFrame) -> DataFrame:
    """Coupons missed since the last paid one; a paid coupon clears them."""
    paid = at_least(F.col("price"), _coupon_barrier(numbered), F.col("s0"))
    earlier = _note().orderBy("obs_no").rowsBetween(Window.unboundedPreceding, -1)
    last_paid = F.coalesce(F.max(F.when(paid, F.col("obs_no"))).over(earlier), F.lit(0))
    return numbered.withColumn("paid", paid).withColumn("missed", F.col("obs_no") - 1 - last_paid)


def athena(obs: DataFrame) -> DataFrame:
    """Redemption of notes that are called early with a coupon per elapsed observation.

    At maturity the branches are tried in order: trigger, protection, loss. Where a trigger other
    than 100% leaves a gap or an overlap, "not triggered and at or above the barrier" is protected.
    A note whose last date has no fixing yet, or that has an unresolved date, has no redemption; ``reason`` says which.
    """
    ends = F.coalesce("called_no", "gap_no", F.col("n_obs"))
    exits = first_trigger(observation_no(obs)).filter(F.col("obs_no") == ends)
    perf = ratio(F.col("price"), F.col("s0")) - 1
    protected = (F.col("modality") == "VNP") | at_least(F.col("price"), F.col("lower_pct"), F.col("s0"))
    multiple = (
        F.when(F.col("called_no").isNotNull(), 1 + percent(F.col("coupon")) * F.col("obs_no"))
        .when(F.col("price").isNull(), None)
        .when(protected, one())
        .otherwise(1 + perf)
    )
    reason = F.when(F.col("gap_no").isNotNull(), "unresolved").when(F.col("price").isNull(), "open")
    return exits.withColumns(
        {
            "redemption": money(F.col("vn"), multiple),
            "early": F.col("called_no").isNotNull() & (F.col("called_no") < F.col("n_obs")),
            "reason": reason,
        }
    )


def phoenix(obs: DataFrame) -> DataFrame:
    """Cash flows of notes with conditional coupons and memory: one row per payment; open dates pay nothing yet.

    An unresolved date is a row without an amount, and the note's last.
    """
    flows = _with_flows(obs).withColumn("_flow", F.explode("_flows"))
    return flows.select("note_id", "obs_no", "obs_date", "_flow.kind", "_flow.amount")


def _with_flows(obs: DataFrame) -> DataFrame:
    """The observations a note lives to see, each with the array of its payments (kind, amount)."""
    alive = first_trigger(coupon_memory(observation_no(obs)))
    last = F.coalesce("called_no", F.col("n_obs"))
    early = F.col("called_no").isNotNull() & (F.col("called_no") < F.col("n_obs"))
    coupon = F.when(
        F.col("paid"),
        F.struct(
            F.lit("coupon").alias("kind"),
            money(F.col("vn"), percent(F.col("coupon")) * (1 + F.col("missed"))).alias("amount"),
        ),
    )
    kept = F.col("called_no").isNotNull() | at_least(F.col("price"), F.col("lower_pct"), F.col("s0"))
    principal = F.when(
        (F.col("obs_no") == last) & F.col("price").isNotNull(),
        F.struct(
            F.when(early, "early redemption").otherwise("maturity").alias("kind"),
            F.when(kept, F.col("vn"))
            .otherwise(money(F.col("vn"), ratio(F.col("price"), F.col("s0"))))
            .cast(MONEY)
            .alias("amount"),
        ),
    )
    unknown = F.when(
        F.col("obs_no") == F.col("gap_no"), F.struct(F.lit("unresolved").alias("kind"), F.lit(None).cast(MONEY).alias("amount"))
    )
    return alive.withColumn("_flows", F.array_compact(F.array(coupon, principal, unknown)))


def lifecycle_events(notes: DataFrame, obs: DataFrame) -> DataFrame:
    """Issue, observations, coupons and redemption of each note in one event table.

    A note whose early redemption settles at maturity gets that payment on its end date.
    """
    none = F.lit(None).cast(MONEY)
    issued = notes.select(
        "note_id", F.col("start_date").alias("event_date"), F.lit("issue").alias("kind"), F.col("vn").cast(MONEY).alias("amount")
    )
    # Observations and payments come from one pass; of an id that is booked twice, each note is paid.
    booked = notes.groupBy("note_id").agg(F.collect_list(F.struct("end_date", "settles")).alias("_notes"))
    lived = _with_flows(obs).join(booked, "note_id", "left")

    def payment(note: Column, flow: Column) -> Column:
        late = (flow["kind"] == "early redemption") & (note["settles"] == "maturity")
        return F.struct(F.when(late, note["end_date"]).otherwise(F.col("obs_date")).alias("event_date"), flow["kind"].alias("kind"), flow["amount"].alias("amount"))

    seen = F.array(F.struct(F.col("obs_date").alias("event_date"), F.lit("observation").alias("kind"), none.alias("amount")))
    paid = F.flatten(F.transform("_notes", lambda note: F.transform("_flows", lambda flow: payment(note, flow))))
    events = lived.select("note_id", F.explode(F.when(F.col("_notes").isNull(), seen).otherwise(F.concat(seen, paid))).alias("_event"))
    return issued.unionByName(events.select("note_id", "_event.*"))
