"""Input frames derived from the given tables.

The analytics work on notes, fixings, underlyings, exports and edits. These texts derive such
frames from the tables at hand. They use only SQL that Spark and DuckDB read alike, so both sides
of a comparison start from the same rows. ``{name}`` names a table or another frame.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

from strikebook.operators.calendar import national_days

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FRAMES: dict[str, str] = {}

# One row per booked note.
FRAMES["book"] = """
SELECT o.o_orderkey AS note_id,
       CASE substr(o.o_orderpriority, 1, 1)
            WHEN '1' THEN 'COE001001' WHEN '2' THEN 'COE001003' WHEN '3' THEN 'COE001005'
            WHEN '4' THEN 'COE001011' ELSE 'COE001073' END AS figure_code,
       CAST(1 + o.o_orderkey % 4 AS INT) AS template_version,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
            ELSE concat('IF', lpad(CAST(o.o_orderkey % 11003 AS STRING), 6, '0')) END AS instrument_code,
       concat('BR', lpad(CAST(o.o_custkey AS STRING), 10, '0')) AS isin,
       c.c_name AS commercial_name,
       CAST(40000 + o.o_custkey % 100 AS STRING) AS issuer_account,
       CAST(o.o_orderdate AS DATE) AS issue_date,
       CAST(o.o_orderdate AS DATE) + CAST(30 + o.o_orderkey % 1080 AS INT) AS maturity_date,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'VNP' ELSE 'VNR' END AS modality,
       c.c_mktsegment AS underlying_class,
       CAST(floor(o.o_custkey / 10) AS BIGINT) AS asset,
       1 + o.o_orderkey % 500 AS quantity,
       CAST(1000 AS DECIMAL(28,8)) AS unit_issue_price,
       CAST(o.o_totalprice AS DECIMAL(28,8)) AS notional,
       CASE o.o_orderstatus WHEN 'O' THEN 'Draft' WHEN 'F' THEN 'Registered' ELSE 'Validated' END AS status,
       CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 97 AS INT) AS updated_on,
       CAST(o.o_orderkey % 7 AS INT) AS row_version
FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

# The published names of the figures, one per order priority class, and the modelled ones.
FRAMES["figures_published"] = """
SELECT CASE substr(o_orderpriority, 1, 1)
            WHEN '1' THEN 'COE001001' WHEN '2' THEN 'COE001003' WHEN '3' THEN 'COE001005'
            ELSE concat('COE', lpad(CAST(o_orderkey % 500 AS STRING), 6, '0')) END AS figure_code,
       min(concat('Figure ', o_orderpriority)) AS figure_name,
       min(o_orderkey) AS ordinal,
       count(*) AS n_source_rows
FROM {orders} GROUP BY 1
"""
FRAMES["figures_modelled"] = """
SELECT concat('COE', lpad(CAST(o_custkey % 700 AS STRING), 6, '0')) AS figure_code,
       max(CASE WHEN o_custkey % 3 = 0 THEN concat('figure ', o_orderpriority)
                ELSE concat('Model ', CAST(o_custkey % 700 AS STRING)) END) AS model_name,
       CASE CAST(max(o_orderkey) % 4 AS INT) WHEN 0 THEN 'Pending' WHEN 1 THEN 'Enabled'
            WHEN 2 THEN 'Quarantined' ELSE 'Retired' END AS status
FROM {orders} GROUP BY 1
UNION ALL
SELECT 'COE001001', 'Model one', 'Enabled'
FROM (SELECT min(o_orderkey) AS k FROM {orders}) WHERE k IS NOT NULL
"""

# Ticks of each asset, and their calendar day.
FRAMES["ticks"] = """
SELECT event_id AS tick_id, user_id AS asset, ts, CAST(ts AS DATE) AS fixing_date,
       CAST(100 + value AS DECIMAL(18,8)) AS price
FROM {events}
"""

# Dated rates and index numbers published per asset day.
FRAMES["rates"] = """
SELECT CAST(ts AS DATE) AS rate_date,
       CAST(10 + avg(CAST(value AS DECIMAL(18,2)) % 5) AS DECIMAL(10,2)) AS rate
FROM {events} GROUP BY 1
"""

# Terms of the notes that observe the fixings: a window inside the days that have ticks.
FRAMES["terms"] = """
SELECT o_orderkey AS note_id,
       CAST(floor(o_custkey / 10) AS BIGINT) AS asset,
       DATE '2024-01-01' + CAST(o_orderkey % 8 AS INT) AS start_date,
       DATE '2024-01-14' + CAST(o_orderkey % 15 AS INT) AS end_date,
       CAST(1000 + o_orderkey % 9 AS DECIMAL(18,2)) AS vn,
       CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'close' WHEN 1 THEN 'avg' WHEN 2 THEN 'high'
            WHEN 3 THEN 'low' ELSE 'close' END AS quote_type,
       CASE WHEN o_orderkey % 2 = 0 THEN 'VNP' ELSE 'VNR' END AS modality,
       CAST(50 + o_orderkey % 101 AS DECIMAL(9,4)) AS participation,
       CAST(5 + o_orderkey % 40 AS DECIMAL(9,4)) AS cap,
       CAST(80 + o_orderkey % 41 AS DECIMAL(9,4)) AS trigger_pct,
       CAST(105 + o_orderkey % 46 AS DECIMAL(9,4)) AS upper_pct,
       CAST(55 + o_orderkey % 41 AS DECIMAL(9,4)) AS lower_pct,
       CAST(1 + o_orderkey % 12 AS DECIMAL(9,4)) AS coupon,
       CAST(70 + o_orderkey % 61 AS DECIMAL(9,4)) AS di_pct,
       CAST(o_totalprice AS DECIMAL(18,2)) AS principal
FROM {orders}
"""

# Row objects of the repeating sections: one row per item of a note.
FRAMES["note_rows"] = """
SELECT l_orderkey AS note_id, l_linenumber AS row_no, l_partkey AS part_id, l_suppkey AS supp_id,
       CAST(l_shipdate AS DATE) AS payment_date,
       CAST(l_quantity AS DECIMAL(18,8)) AS weight,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
       CAST(l_discount AS DECIMAL(9,4)) AS rate,
       CAST(l_tax AS DECIMAL(9,4)) AS spread,
       l_returnflag AS flag, l_linestatus AS item_status
FROM {lineitem}
"""

# Eligible-underlying master: instrument type from the size class.
FRAMES["underlyings"] = """
SELECT p_partkey AS pos, p_type AS asset_class,
       CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE p_brand END AS code,
       CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS valuation_index,
       CASE WHEN p_size % 3 = 0 THEN 'OPCAO' ELSE 'COE' END AS instrument_type,
       CAST(p_retailprice AS DECIMAL(18,2)) AS price
FROM {part}
"""

# Dictionary rows: a group, a published name (whole text) and an accepted type.
FRAMES["attributes"] = """
SELECT p_partkey AS pos, p_brand AS figure_code,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat(p_name, ' de ', p_type)
            WHEN 1 THEN concat(p_type, ' ', p_name, 's (%)')
            WHEN 2 THEN concat('Observação ', p_name, ' ', CAST(p_size AS STRING))
            ELSE concat(p_name, ' ', CAST(p_size % 12 AS STRING)) END AS name,
       concat('C', lpad(CAST(p_partkey AS STRING), 9, '0')) AS field_code,
       CASE WHEN p_partkey % 11 = 0 THEN 'HORA' WHEN p_partkey % 7 = 0 THEN 'DOMINIO'
            WHEN p_partkey % 3 = 0 THEN 'NUMERICO' WHEN p_partkey % 3 = 1 THEN 'DATA' ELSE 'TEXTO' END AS published_type,
       CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 = 0 THEN CAST(p_size % 4 AS INT) ELSE 0 END AS n_values,
       CAST(p_size AS INT) AS published_length, CAST(p_size % 5 AS INT) AS published_decimals,
       p_size % 2 = 0 AS mandatory
FROM {part}
"""
FRAMES["fields"] = """
SELECT l_orderkey * 8 + l_linenumber AS field_id, p.p_brand AS figure_code,
       CASE CAST(l_orderkey % 4 AS INT) WHEN 0 THEN concat(upper(p.p_name), ' ', p.p_type)
            WHEN 1 THEN concat(p.p_name, ' da ', p.p_type, ' %')
            WHEN 2 THEN concat('OBSERVACAO - ', p.p_name, ' ', CAST(p.p_size AS STRING))
            ELSE concat(p.p_name, '  ', CAST(p.p_size % 12 AS STRING)) END AS name,
       CASE CAST(l_linenumber % 5 AS INT) WHEN 0 THEN 'decimal' WHEN 1 THEN 'date' WHEN 2 THEN 'string'
            WHEN 3 THEN 'percent' ELSE 'enum' END AS data_type,
       CASE WHEN l_suppkey % 17 = 0 THEN 'C-none'
            ELSE concat('C', lpad(CAST(l_partkey AS STRING), 9, '0')) END AS field_code,
       CASE WHEN l_orderkey % 6 = 0 THEN concat(p.p_type, ' DE ', p.p_name, ' (%)') WHEN l_orderkey % 6 = 1 THEN '' ELSE concat('Campo ', p.p_name) END AS label,
       CASE WHEN l_linenumber % 5 IN (0, 1) THEN CAST(l_partkey % 3 AS INT) ELSE 0 END AS n_options, l_suppkey % 4 = 0 AS drafted_required,
       CAST(l_quantity AS INT) AS max_length, CAST(l_linenumber % 5 AS INT) AS decimals,
       l_returnflag <> 'N' AS declared
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""

# Long attributes of a note, and the fields of its template with their defaults.
FRAMES["note_attr"] = """
SELECT note_id, concat('payoff.a', CAST(row_no AS STRING)) AS path,
       min(CASE WHEN weight < 6 THEN '' ELSE CAST(CAST(weight AS INT) AS STRING) END) AS value
FROM {note_rows} GROUP BY 1, 2
"""
FRAMES["tpl_field"] = """
SELECT b.figure_code, concat('payoff.a', CAST(r.row_no AS STRING)) AS path,
       CAST(max(CAST(r.weight AS INT)) AS STRING) AS default_value
FROM {book} b JOIN {note_rows} r ON b.note_id = r.note_id GROUP BY 1, 2
"""
FRAMES["templates"] = """
SELECT figure_code, template_version AS version, min(issue_date) AS published_on,
       template_version = 4 AS is_active
FROM {book} WHERE template_version <> 3 GROUP BY figure_code, template_version
"""

# Booked notes as JSON documents. Some attributes are absent, empty or of the wrong kind.
FRAMES["note_docs"] = """
SELECT note_id, figure_code, template_version,
 concat('{"common":{"issuerAccount":"', issuer_account,
  '","commercialName":', CASE WHEN note_id % 19 = 0 THEN 'null' ELSE concat('"', coalesce(commercial_name, ''), '"') END,
  ',"instrumentCode":"', coalesce(instrument_code, ''),
  '","isin":"', CASE WHEN note_id % 29 = 0 THEN 'BR1' ELSE isin END,
  '","issueDate":"', CAST(issue_date AS STRING),
  '","maturityDate":"', CASE WHEN note_id % 23 = 0 THEN 'soon' WHEN note_id % 37 = 0 THEN CAST(issue_date AS STRING)
                             ELSE CAST(maturity_date AS STRING) END,
  '","quantity":', CAST(quantity AS STRING), CASE WHEN note_id % 31 = 0 THEN '.5' ELSE '' END,
  ',"unitIssuePrice":1000,"notional":', CAST(CAST(notional AS DECIMAL(18,2)) AS STRING),
  ',"modality":"', modality, '"',
  CASE WHEN note_id % 3 = 0 THEN ',"guaranteedCapital":90' WHEN note_id % 7 = 0 THEN ''
       ELSE ',"guaranteedCapital":100' END,
  '},"underlying":{"assetClass":"', coalesce(underlying_class, ''), '","asset":"', CAST(asset AS STRING),
  '","hasLookback":', CASE WHEN note_id % 11 = 0 THEN '"maybe"' WHEN note_id % 2 = 0 THEN 'true' ELSE 'false' END,
  '},"payoff":{"strike":', CAST(90 + note_id % 21 AS STRING),
  ',"participation":', CASE WHEN note_id % 13 = 0 THEN '"abc"' ELSE CAST(note_id % 240 AS STRING) END,
  CASE WHEN note_id % 17 = 0 THEN '' WHEN note_id % 5 = 0 THEN concat(',"cap":', CAST(note_id % 40 AS STRING), '.12500')
       ELSE concat(',"cap":', CAST(note_id % 60 AS STRING)) END,
  ',"barrierLevel":', CAST(95 + note_id % 50 AS STRING), ',"rebate":', CAST(note_id % 9 AS STRING),
  ',"leverage":', CAST(note_id % 4 AS STRING), ',"digitalCoupon":', CAST(note_id % 70 AS STRING),
  '},"observations":[',
  CASE WHEN note_id % 41 = 0 THEN '' ELSE
  concat('{"observationDate":"', CAST(issue_date + CAST(20 + note_id % 300 AS INT) AS STRING),
   '","triggerLevel":', CAST(90 + note_id % 20 AS STRING), ',"couponBarrier":', CAST(70 + note_id % 50 AS STRING),
   ',"observationCoupon":', CAST(note_id % 5 AS STRING), '},{"observationDate":"',
   CAST(issue_date + CAST(20 + note_id % 310 AS INT) AS STRING), '","triggerLevel":100',
   CASE WHEN note_id % 6 = 0 THEN '' ELSE ',"couponBarrier":80' END, ',"observationCoupon":2}') END,
  ']}') AS doc
FROM {book} AS booked
"""

# Edits: one turn of a conversation edits one note.
FRAMES["edits"] = """
SELECT conv_id * 100 + turn AS edit_id, conv_id * 7 % 1500 AS note_id, turn,
       CAST(turn % 7 AS INT) AS base_version, role,
       CASE WHEN role = 'user' THEN concat('observations[', CAST(turn % 3 AS STRING), '].couponBarrier')
            WHEN turn % 2 = 0 THEN 'payoff.cap' WHEN turn % 3 = 0 THEN 'common.modality'
            ELSE 'common.maturityDate' END AS path
FROM {conversations}
"""

# Inflation index numbers by month, and the day each becomes known.
FRAMES["ipca_index"] = """
SELECT month, ni, month + CAST(35 + month(month) * 7 % 33 AS INT) AS published_on FROM (
 SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
        CAST(1000 + max(o_totalprice) / 10 AS DECIMAL(18,4)) AS ni
 FROM {orders} GROUP BY 1) AS monthly
"""
FRAMES["fx"] = """
SELECT event_type AS currency, CAST(ts AS DATE) AS quoted_on, CAST(1 + max(value) / 100 AS DECIMAL(18,4)) AS rate
FROM {events} GROUP BY 1, 2
"""
# What notes read from the fixings at each end of their life, and the currency they carry.
FRAMES["windows"] = """
SELECT t.*, start_date + 5 AS start_until, end_date - 5 AS end_from,
       CASE CAST(note_id % 5 AS INT) WHEN 0 THEN 'single' WHEN 1 THEN 'mean_n' WHEN 2 THEN 'max'
            WHEN 3 THEN 'min' ELSE 'mean' END AS criterion,
       CAST(1 + note_id % 3 AS INT) AS n,
       CASE CAST(note_id % 5 AS INT) WHEN 0 THEN 'signup' WHEN 1 THEN 'view' WHEN 2 THEN 'error'
            WHEN 3 THEN 'purchase' ELSE 'click' END AS currency,
       note_id % 4 = 0 AS quanto
FROM {terms} AS t
"""
# Barrier levels of the notes, in price points.
FRAMES["barriers"] = """
SELECT t.*,
       CASE CAST(note_id % 3 AS INT) WHEN 0 THEN 'american' WHEN 1 THEN 'european' ELSE 'discrete' END AS observation,
       CASE WHEN note_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction,
       CAST(CASE WHEN note_id % 2 = 0 THEN 100 + upper_pct ELSE 80 + lower_pct / 2 END AS DECIMAL(18,8)) AS level,
       CAST(100 + note_id % 20 AS DECIMAL(18,8)) AS low,
       CAST(100 + note_id % 20 + participation AS DECIMAL(18,8)) AS high
FROM {terms} AS t
"""

# Autocallable notes: a fixed starting price, observed every third day of the window.
# The trigger of some falls from date to date, and coupons have a barrier of their own.
FRAMES["autocalls"] = """SELECT t.*, CAST(120 + note_id % 30 AS DECIMAL(18,8)) AS s0, CAST(note_id % 4 AS DECIMAL(9,4)) AS step_down,
 CAST(lower_pct + note_id % 6 AS DECIMAL(9,4)) AS coupon_pct FROM {terms} AS t"""

# What follows is written for DuckDB alone: the same rows the operators build.
# Every day that a note of this or the next generation can name; K7 reports years beyond.
FIRST_DAY, LAST_DAY = dt.date(1970, 1, 1), dt.date(2100, 12, 31)
FRAMES["d_holidays"] = "SELECT CAST(d AS DATE) AS holiday_date FROM (VALUES {days}) AS v(d)".replace(
    "{days}", ", ".join(f"('{d}')" for d in national_days(FIRST_DAY.year, LAST_DAY.year))
)
FRAMES["d_calendar"] = """
SELECT day, is_business_day, CAST(sum(CAST(is_business_day AS INT)) OVER (ORDER BY day) AS BIGINT) AS bd_index,
       min(CASE WHEN is_business_day THEN day END)
         OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_bd
FROM (SELECT day, isodow(day) < 6 AND day NOT IN (SELECT holiday_date FROM {d_holidays} h) AS is_business_day
      FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY)) AS DATE) AS day))
""".replace("{FIRST_DAY}", str(FIRST_DAY)).replace("{LAST_DAY}", str(LAST_DAY))
FRAMES["d_fixings"] = """
SELECT asset, fixing_date, last(price ORDER BY ts, tick_id) AS close,
       CAST(round(avg(price), 8) AS DECIMAL(18,8)) AS avg, max(price) AS high, min(price) AS low
FROM {ticks} t GROUP BY 1, 2
"""
FRAMES["d_observed"] = """
SELECT t.*, f.fixing_date AS day,
       CASE t.quote_type WHEN 'close' THEN f.close WHEN 'avg' THEN f.avg WHEN 'high' THEN f.high ELSE f.low END AS price
FROM {barriers} t JOIN {d_fixings} f ON f.asset = t.asset AND f.fixing_date BETWEEN t.start_date AND t.end_date
"""

# Of these, the daily observations: business days, whose number is the schedule's.
FRAMES["d_scheduled"] = "SELECT o.* FROM {d_observed} o JOIN {d_calendar} c ON c.day = o.day AND c.is_business_day"
FRAMES["d_lengths"] = """
SELECT t.note_id, y.bd_index - x.bd_index + CAST(x.is_business_day AS BIGINT) AS n_all
FROM {barriers} t JOIN {d_calendar} x ON x.day = t.start_date JOIN {d_calendar} y ON y.day = t.end_date
"""

FRAMES["d_observations"] = """
SELECT s.* EXCLUDE (trigger_pct), CAST(trigger_pct - step_down * (obs_no - 1) AS DECIMAL(9,4)) AS trigger_pct, f.close AS price,
       CASE WHEN f.close IS NOT NULL THEN 'fixed' WHEN s.obs_date <= (SELECT max(CAST(ts AS DATE)) FROM {events}) THEN 'unresolved' ELSE 'open' END AS state
FROM (SELECT t.*, cal.next_bd AS obs_date
      FROM (SELECT *, CAST(start_date + CAST(3 * k AS INT) AS DATE) AS scheduled_on, k + 1 AS obs_no, count(*) OVER (PARTITION BY note_id) AS n_obs
            FROM (SELECT a.*, unnest(range(0, (a.end_date - a.start_date) // 3 + 1)) AS k FROM {autocalls} a) u) t
      JOIN {d_calendar} cal ON cal.day = t.scheduled_on) s
LEFT JOIN {d_fixings} f ON f.asset = s.asset AND f.fixing_date = s.obs_date
"""


def exact_mean(total: str, n: str) -> str:
    """DuckDB text of a positive eight-decimal mean, rounded half up without binary noise."""
    scaled = f"CAST({total} * 100000000 AS HUGEINT)"
    return (
        f"CAST(CAST((2 * {scaled} + {n}) // (2 * {n}) AS DECIMAL(20,0)) * CAST(0.00000001 AS DECIMAL(9,8)) "
        "AS DECIMAL(18,8))"
    )


def exact_change(numerator: str, denominator: str, decimals: int = 8) -> str:
    """DuckDB text of ``numerator / denominator - 1`` as an exact decimal, half away from zero."""
    a, b = (f"CAST(CAST({x} AS DECIMAL(28,8)) * 100000000 AS HUGEINT)" for x in (numerator, denominator))
    units = f"sign({a} - {b}) * ((2 * abs({a} - {b}) * CAST({10**decimals} AS HUGEINT) + {b}) // (2 * {b}))"
    unit = f"CAST({10**-decimals:.{decimals}f} AS DECIMAL({decimals + 1},{decimals}))"
    return f"CAST(CAST({units} AS DECIMAL(20,0)) * {unit} AS DECIMAL({18 if decimals == 8 else decimals + 6},{decimals}))"


def _edge_value(column: str, start: str, end: str, order: str) -> str:
    mean_all = exact_mean("sum(price)", "count(*)")
    mean_n = exact_mean("sum(price) FILTER (rn <= n)", "(count(*) FILTER (rn <= n))")
    return f"""
SELECT note_id, CASE criterion WHEN 'single' THEN min(price) FILTER (rn = 1) WHEN 'mean_n' THEN {mean_n}
       WHEN 'max' THEN max(price) WHEN 'min' THEN min(price) ELSE {mean_all} END AS {column}
FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY day {order}) AS rn FROM (
  SELECT w.note_id, w.criterion, w.n, f.fixing_date AS day,
         CASE w.quote_type WHEN 'close' THEN f.close WHEN 'avg' THEN f.avg WHEN 'high' THEN f.high ELSE f.low END AS price
  FROM {{windows}} w JOIN {{d_fixings}} f ON f.asset = w.asset AND f.fixing_date BETWEEN w.{start} AND w.{end}) p) r
GROUP BY note_id, criterion, n"""


FRAMES["d_initial"] = _edge_value("s0", "start_date", "start_until", "ASC")
FRAMES["d_final"] = _edge_value("st", "end_from", "end_date", "DESC")
FRAMES["d_perf"] = f"""
SELECT w.*, i.s0, f.st, {exact_change('f.st', 'i.s0', 16)} AS perf
FROM {{windows}} w LEFT JOIN {{d_initial}} i ON i.note_id = w.note_id LEFT JOIN {{d_final}} f ON f.note_id = w.note_id
"""


def _expand(text: str, table) -> str:
    def replace(match: re.Match) -> str:
        name = match.group(1)
        if name in FRAMES:
            return "(" + _expand(FRAMES[name], table) + ")"
        return table(name) if name in TABLES else match.group(0)

    return re.sub(r"\{([a-z_]+)\}", replace, text)


def for_duckdb(text: str) -> str:
    """The text with its frames spelled out over the views DuckDB has registered."""
    return _expand(text, lambda name: name)


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text as a Spark plan over the parquet files of ``sf_dir``."""
    return spark.sql(_expand(text, lambda name: f"parquet.`{sf_dir}/{name}.parquet`"))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, "SELECT * FROM {" + name + "} AS f")


def spread(spark: SparkSession, sf_dir: str, table: str, df: DataFrame) -> DataFrame:
    """Share heavy per-row work among all cores when the table is too small to be split.

    A large table already arrives in more splits than there are cores and is left where it is.
    """
    splits = spark.read.parquet(f"{sf_dir}/{table}.parquet").rdd.getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if splits < cores else df
