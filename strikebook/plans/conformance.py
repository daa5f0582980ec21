"""Queries over figures, templates, dictionaries and instruction prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikebook.functions.dedupe import first_wins
from strikebook.functions.text import FUNCTION_WORDS
from strikebook.operators import catalogue as ops
from strikebook.plans.frames import frame, query
from strikebook.plans.registry import Registry

registry = Registry()
WORDS = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)


def d_key(name: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({name})), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"


def d_signature(key: str) -> str:
    words = f"list_filter(string_split({key}, ' '), lambda w: w <> '')"
    kept = f"list_filter({words}, lambda w: w NOT IN ({WORDS}))"
    folded = f"list_transform({kept}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, -1) ELSE w END)"
    return f"array_to_string(list_sort(CASE WHEN len({folded}) > 0 THEN {folded} ELSE {words} END), ' ')"


def agree(published: str, declared: str) -> str:
    return (
        f"CASE {published} WHEN 'NUMERICO' THEN {declared} IN ('decimal', 'percent', 'money', 'integer') "
        f"WHEN 'DATA' THEN {declared} = 'date' WHEN 'TEXTO' THEN {declared} IN ('string', 'text') WHEN 'DOMINIO' THEN {declared} IN ('enum', 'enumset', 'boolean') ELSE false END"
    )


def conflict(published: str, declared: str) -> str:
    """Known published types that do not list the declared one."""
    known = {"NUMERICO": "decimal percent money integer", "DATA": "date", "TEXTO": "string text", "DOMINIO": "enum enumset boolean"}
    return " OR ".join(f"({published} = '{p}' AND NOT list_contains(string_split('{names}', ' '), {declared}))" for p, names in known.items())


def two(spark, sf, *names):
    return [frame(spark, sf, n) for n in names]


CATALOGUE = """
SELECT coalesce(p.figure_code, m.figure_code) AS figure_code, p.figure_name, m.model_name,
  p.figure_code IS NOT NULL AS in_catalogue,
  CASE WHEN m.status IS NULL THEN 'NotConfigured' WHEN m.status = 'Enabled' THEN 'Available' ELSE m.status END AS availability,
  coalesce(m.status = 'Enabled', false) AS bookable
FROM {figures_published} p FULL JOIN {figures_modelled} m ON p.figure_code = m.figure_code"""


@registry.add("B8_enabled_figures", "SELECT figure_code, model_name, status FROM {figures_modelled} m WHERE status = 'Enabled'")
def enabled_figures(spark, sf):
    return ops.enabled_figures(frame(spark, sf, "figures_modelled")).select("figure_code", "model_name", "status")


@registry.add("B10_availability", f"SELECT figure_code, availability, bookable FROM ({CATALOGUE}) c")
def availability(spark, sf):
    return ops.catalogue(*two(spark, sf, "figures_published", "figures_modelled")).select("figure_code", "availability", "bookable")


@registry.add("C2_catalogue", CATALOGUE)
def catalogue(spark, sf):
    return ops.catalogue(*two(spark, sf, "figures_published", "figures_modelled"))


@registry.add(
    "D1_coverage",
    f"SELECT count(*) FILTER (in_catalogue) AS published, count(*) FILTER (availability <> 'NotConfigured') AS configured, "
    f"count(*) FILTER (bookable) AS available FROM ({CATALOGUE}) c",
)
def coverage(spark, sf):
    return ops.coverage(catalogue(spark, sf))


@registry.add(
    "C5_name_clash",
    "SELECT m.figure_code, m.model_name FROM {figures_modelled} m WHERE EXISTS (SELECT 1 FROM {figures_published} p "
    "WHERE lower(p.figure_name) = lower(m.model_name) AND p.figure_code <> m.figure_code)",
)
def name_clash(spark, sf):
    return ops.name_clash(*two(spark, sf, "figures_modelled", "figures_published"))


@registry.add(
    "C6_unknown_codes",
    "SELECT m.figure_code, CASE WHEN p.figure_name IS NULL THEN 'error' ELSE 'warning' END AS severity, "
    "CASE WHEN p.figure_name IS NULL THEN 'unknown code' ELSE 'name differs' END AS problem "
    "FROM {figures_modelled} m LEFT JOIN {figures_published} p ON p.figure_code = m.figure_code "
    "WHERE p.figure_name IS NULL OR lower(p.figure_name) <> lower(m.model_name)",
)
def unknown_codes(spark, sf):
    return ops.unknown_codes(*two(spark, sf, "figures_modelled", "figures_published"))


OPTIONS = """SELECT l_orderkey * 8 + l_linenumber AS option_id, concat('D', CAST(l_suppkey % 30 AS STRING)) AS domain,
  CASE WHEN l_quantity < 3 THEN ' ' ELSE CAST(l_partkey % 60 AS STRING) END AS code FROM {lineitem}"""
DOMAINS = """SELECT concat('D', CAST(p_partkey % 27 AS STRING)) AS domain, CAST(p_size AS STRING) AS code,
  p_partkey % 4 <> 0 AS enabled, p_partkey AS pos FROM {part}"""


@registry.add(
    "C7_option_conformity",
    f"""
WITH o AS ({OPTIONS}), d AS ({DOMAINS}), f AS (SELECT domain, code, min_by(enabled, pos) AS enabled FROM d GROUP BY 1, 2),
j AS (SELECT o.*, CASE WHEN o.domain NOT IN (SELECT domain FROM d) THEN 'unknown domain' WHEN trim(o.code) = '' THEN 'no code'
  WHEN f.enabled IS NULL THEN 'code not in domain' WHEN NOT f.enabled THEN 'code disabled' END AS problem
  FROM o LEFT JOIN f ON f.domain = o.domain AND f.code = o.code)
SELECT option_id, domain, code, problem, CASE WHEN problem IN ('unknown domain', 'code disabled') THEN 'warning' ELSE 'error' END AS severity
FROM j WHERE problem IS NOT NULL""",
)
def option_conformity(spark, sf):
    found = ops.option_conformity(query(spark, sf, OPTIONS), query(spark, sf, DOMAINS))
    return found.select("option_id", "domain", "code", "problem", "severity")


@registry.add(
    "C8_type_conformity",
    f"""
WITH j AS (SELECT f.*, a.published_type, a.published_length, a.published_decimals, CASE WHEN f.declared THEN 'error' ELSE 'warning' END AS strict
  FROM {{fields}} f LEFT JOIN {{attributes}} a ON a.field_code = f.field_code)
SELECT field_id, field_code, 'unknown code' AS problem, strict AS severity FROM j WHERE published_type IS NULL
UNION ALL SELECT field_id, field_code, 'type', strict FROM j WHERE {conflict('published_type', 'data_type')}
UNION ALL SELECT field_id, field_code, 'decimals', 'warning' FROM j WHERE decimals <> published_decimals
UNION ALL SELECT field_id, field_code, 'length', strict FROM j WHERE published_length > 0 AND max_length > published_length""",
)
def type_conformity(spark, sf):
    return ops.type_conformity(*two(spark, sf, "fields", "attributes"))


STRATEGY = "SELECT concat('S', CAST(p_size AS STRING)) AS field_code, min(published_type) AS published_type, max(p_size) AS published_length, max(p_size % 3) AS published_decimals FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'HORA' WHEN p_size % 2 = 0 THEN 'NUMERICO' ELSE 'TEXTO' END AS published_type FROM {part}) p GROUP BY 1"
NAMED = "SELECT field_id, CASE WHEN field_id % 3 <> 0 THEN concat('S', CAST(field_id % 60 AS STRING)) END AS field_code, data_type, decimals, max_length, declared FROM {fields}"


@registry.add(
    "C8_strategy_conformity",
    f"""
WITH j AS (SELECT f.*, a.published_type, a.published_length, a.published_decimals, a.field_code IS NULL AS absent
  FROM ({NAMED} f0) f LEFT JOIN ({STRATEGY}) a ON a.field_code = f.field_code WHERE f.field_code IS NOT NULL)
SELECT field_id, field_code, 'unknown code' AS problem, 'error' AS severity FROM j WHERE absent
UNION ALL SELECT field_id, field_code, 'type', 'error' FROM j WHERE {conflict('published_type', 'data_type')}
UNION ALL SELECT field_id, field_code, 'decimals', 'warning' FROM j WHERE decimals <> published_decimals
UNION ALL SELECT field_id, field_code, 'length', 'error' FROM j WHERE published_length > 0 AND max_length > published_length""",
)
def strategy_conformity(spark, sf):
    return ops.type_conformity(query(spark, sf, NAMED + " f0"), query(spark, sf, STRATEGY), inferred_warn=False)


CHOICES = "SELECT field_id, field_code, declared, concat('o', CAST(decimals AS STRING)) AS option, CASE WHEN max_length % 5 = 0 THEN '' ELSE CAST(max_length % 7 AS STRING) END AS code FROM {fields}"
ACCEPTED = "SELECT field_code, CAST(k AS STRING) AS code FROM (SELECT field_code, explode(sequence(1, n_values)) AS k FROM {attributes} a WHERE n_values > 0) v"


@registry.add(
    "C8_option_codes",
    f"""
WITH v AS (SELECT field_code, CAST(k AS STRING) AS code FROM (SELECT field_code, unnest(range(1, n_values + 1)) AS k FROM {{attributes}} a WHERE n_values > 0) x)
SELECT field_id, field_code, option, code, CASE WHEN declared THEN 'error' ELSE 'warning' END AS severity FROM ({CHOICES} f0) c
WHERE code <> '' AND field_code IN (SELECT field_code FROM v) AND NOT EXISTS (SELECT 1 FROM v WHERE v.field_code = c.field_code AND v.code = c.code)""",
)
def option_codes(spark, sf):
    return ops.option_codes(query(spark, sf, CHOICES + " f0"), query(spark, sf, ACCEPTED))


# Of every forty fields one is mapped under its published code; the others carry codes nobody published.
MAPPED = "SELECT figure_code, CASE WHEN field_id % 40 = 0 THEN field_code ELSE concat('own-', field_code) END AS field_code FROM {fields}"


@registry.add(
    "C9_unmapped_attributes",
    f"SELECT a.figure_code, a.field_code, a.name, a.mandatory FROM {{attributes}} a ANTI JOIN ({MAPPED} f0) f ON f.figure_code = a.figure_code AND f.field_code = a.field_code",
)
def unmapped_attributes(spark, sf):
    gaps = ops.unmapped_attributes(frame(spark, sf, "attributes"), query(spark, sf, MAPPED))
    return gaps.select("figure_code", "field_code", "name", "mandatory")


@registry.add(
    "C9_missing_attributes",
    f"WITH g AS (SELECT a.* FROM {{attributes}} a ANTI JOIN ({MAPPED} f0) f ON f.figure_code = a.figure_code AND f.field_code = a.field_code),"
    """
r AS (SELECT *, row_number() OVER (PARTITION BY figure_code ORDER BY name, field_code) AS rn FROM g WHERE mandatory)
SELECT g.figure_code, count(*) AS n_missing, count(*) FILTER (mandatory) AS n_mandatory,
  count(*) = (SELECT count(*) FROM {attributes} x WHERE x.figure_code = g.figure_code) AS none_mapped,
  (SELECT string_agg(name, ', ' ORDER BY rn) FROM r WHERE r.figure_code = g.figure_code AND rn <= 8) AS first_mandatory
FROM g GROUP BY g.figure_code""",
)
def missing_attributes(spark, sf):
    return ops.missing_attributes(frame(spark, sf, "attributes"), query(spark, sf, MAPPED))


RESOLVE = """SELECT o_orderkey AS row_id, o_custkey * 3 AS ordinal, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN concat('#', lpad(CAST(o_custkey AS STRING), 9, '0'))
  WHEN 1 THEN concat(' CLIENTE —  customer#', lpad(CAST(o_custkey AS STRING), 9, '0'), ' ') WHEN 2 THEN 'none' WHEN 3 THEN ' ' ELSE concat('é', CAST(o_custkey AS STRING)) END AS name FROM {orders}"""
ANNEX = """SELECT c_custkey * 2 AS ordinal, CASE WHEN c_custkey % 3 = 0 THEN concat(c_mktsegment, ' É', CAST(c_custkey AS STRING)) ELSE concat(c_mktsegment, ' Cliente – ', c_name) END AS title,
  concat('A', lpad(CAST(c_custkey AS STRING), 9, '0')) AS code FROM {customer}"""


@registry.add(
    "C11_resolve_codes",
    f"""
WITH r AS (SELECT *, upper(trim(regexp_replace(replace(replace(name, '–', '-'), '—', '-'), '\\s+', ' ', 'g'))) AS k FROM ({RESOLVE}) r0), a AS ({ANNEX}),
t AS (SELECT code, upper(trim(regexp_replace(replace(replace(title, '–', '-'), '—', '-'), '\\s+', ' ', 'g'))) AS title FROM a), o AS (SELECT ordinal, min(code) AS code FROM a GROUP BY 1),
names AS (SELECT DISTINCT k FROM r WHERE k <> ''), n AS (SELECT k, min(code) AS code FROM names JOIN t ON suffix(t.title, k) GROUP BY 1)
SELECT r.row_id, r.ordinal, r.name, coalesce(o.code, n.code) AS code FROM r LEFT JOIN o ON o.ordinal = r.ordinal LEFT JOIN n ON n.k = r.k""",
)
def resolve_codes(spark, sf):
    return ops.resolve_codes(query(spark, sf, RESOLVE), query(spark, sf, ANNEX))


NAMES = """SELECT concat('p', CAST(pos AS STRING)) AS id, name FROM {attributes} a
UNION ALL SELECT concat('d', CAST(doc_id AS STRING)), text FROM {documents}"""


@registry.add(
    "H1_attribute_index",
    rf"""
SELECT id, match_key, {d_signature('match_key')} AS signature,
  CASE WHEN regexp_full_match(match_key, '.+ \d+') THEN regexp_extract(match_key, '^(.+) \d+$', 1) ELSE match_key END AS stem,
  TRY_CAST(nullif(regexp_extract(match_key, '^.+ (\d+)$', 1), '') AS INT) AS number
FROM (SELECT id, {d_key('name')} AS match_key FROM ({NAMES}) n) k""",
)
def attribute_index(spark, sf):
    return ops.attribute_index(query(spark, sf, NAMES)).select("id", "match_key", "signature", "stem", "number")


INDEXED = f"SELECT *, {d_signature('match_key')} AS signature FROM (SELECT *, {d_key('name')} AS match_key FROM {{attributes}} a0) k"


@registry.add(
    "D13_ambiguous_keys",
    f"SELECT figure_code, signature, count(*) AS n, CASE WHEN count(*) = 1 THEN min(field_code) END AS field_code FROM ({INDEXED}) i GROUP BY 1, 2",
)
def ambiguous_keys(spark, sf):
    return ops.ambiguous_keys(ops.attribute_index(frame(spark, sf, "attributes")))


@registry.add("H3_near_duplicate_attributes", f"SELECT figure_code, signature, count(*) AS n FROM ({INDEXED}) i GROUP BY 1, 2 HAVING count(*) > 1")
def near_duplicate_attributes(spark, sf):
    return ops.near_duplicate_attributes(ops.attribute_index(frame(spark, sf, "attributes")))


@registry.add(
    "C12_match_attribute_names",
    f"""
WITH a AS ({INDEXED}), k AS (SELECT figure_code, match_key, min_by(field_code, pos) AS code, min_by(published_type, pos) AS type FROM a GROUP BY 1, 2),
s AS (SELECT figure_code, signature, min(field_code) AS code, min(published_type) AS type FROM a GROUP BY 1, 2 HAVING count(*) = 1),
n AS MATERIALIZED (SELECT *, {d_signature('match_key')} AS signature FROM (SELECT figure_code, shown, {d_key('shown')} AS match_key
  FROM (SELECT figure_code, name AS shown FROM {{fields}} f0 UNION SELECT figure_code, label FROM {{fields}} f9) u WHERE trim(shown) <> '') f1),
m AS MATERIALIZED (SELECT n.figure_code, n.shown, coalesce(k.code, s.code) AS code, coalesce(k.type, s.type) AS type, CASE WHEN k.code IS NOT NULL THEN 'name' ELSE 'signature' END AS how
 FROM n LEFT JOIN k ON k.figure_code = n.figure_code AND k.match_key = n.match_key
 LEFT JOIN s ON s.figure_code = n.figure_code AND s.signature = n.signature WHERE k.code IS NOT NULL OR s.code IS NOT NULL),
j AS (SELECT f.field_id, f.data_type, coalesce(x.code, y.code) AS code, coalesce(x.type, y.type) AS type, coalesce(x.how, y.how) AS how FROM {{fields}} f
 LEFT JOIN m x ON x.figure_code = f.figure_code AND x.shown = f.name LEFT JOIN m y ON y.figure_code = f.figure_code AND y.shown = f.label)
SELECT field_id, CASE WHEN {agree('type', 'data_type')} THEN code END AS field_code, CASE WHEN {agree('type', 'data_type')} THEN how END AS matched_by FROM j""",
)
def match_attribute_names(spark, sf):
    return ops.match_attribute_names(*two(spark, sf, "fields", "attributes"))


SERIES = """SELECT l_orderkey * 8 + l_linenumber AS row_id, p_brand AS figure_code, CAST(l_linenumber AS BIGINT) AS n,
  CASE WHEN l_orderkey % 2 = 0 THEN p_name ELSE concat('Observações de ', p_name) END AS concept FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


@registry.add(
    "C13_series_codes",
    rf"""
WITH a AS ({INDEXED}), m AS (SELECT *, regexp_extract(match_key, '^(.+) \d+$', 1) AS stem, TRY_CAST(nullif(regexp_extract(match_key, '^.+ (\d+)$', 1), '') AS INT) AS num FROM a),
c AS (SELECT figure_code, field_code, num, pos, {d_signature('stem')} AS concept FROM m WHERE num IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY figure_code, concept ORDER BY num, pos) AS n FROM c),
q AS (SELECT row_id, figure_code, n, {d_signature('ck')} AS concept FROM (SELECT *, {d_key('concept')} AS ck FROM ({SERIES}) s0) s)
SELECT q.row_id, q.figure_code, q.concept, q.n, r.field_code FROM q JOIN r ON r.figure_code = q.figure_code AND r.concept = q.concept AND r.n = q.n""",
)
def series_codes(spark, sf):
    return ops.series_codes(frame(spark, sf, "attributes"), query(spark, sf, SERIES)).select(
        "row_id", "figure_code", "concept", "n", "field_code"
    )


VALUES = "SELECT p_brand AS field, p_name AS value, CAST(p_size AS STRING) AS code, p_partkey AS pos FROM {part}"
ASKED = "SELECT l_orderkey * 8 + l_linenumber AS row_id, l_linenumber AS line, concat('Brand#', CAST(l_suppkey % 30 AS STRING)) AS field, upper(p_name) AS value FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"


@registry.add(
    "C14_value_code",
    f"WITH v AS (SELECT field, lower(value) AS value, min_by(code, pos) AS code FROM ({VALUES}) v0 GROUP BY 1, 2) "
    f"SELECT a.row_id, a.field, a.value, v.code FROM ({ASKED}) a LEFT JOIN v ON v.field = a.field AND v.value = lower(a.value)",
)
def value_code(spark, sf):
    return ops.value_code(query(spark, sf, ASKED), query(spark, sf, VALUES)).select("row_id", "field", "value", "code")


@registry.add(
    "D7_collect_values",
    f"SELECT field, value, pos, row_number() OVER (PARTITION BY field ORDER BY pos) AS value_no FROM (SELECT field, value, min(pos) AS pos FROM ({VALUES}) v GROUP BY 1, 2) d",
)
def collect_values(spark, sf):
    return ops.collect_values(query(spark, sf, VALUES))


PROSE = "SELECT l_orderkey * 8 + l_linenumber AS row_id, p_brand AS figure_code, concat(upper(p_name), '!') AS value FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
# Every part offers an option; every second one under a label that no prose quotes.
OFFERS = "SELECT p_brand AS figure_code, CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat(p_name, ' other') END AS label, CAST(p_size % 3 AS INT) AS layer, p_partkey AS pos, concat('enum', CAST(p_partkey % 200 AS STRING)) AS enum FROM {part}"


@registry.add(
    "C15_option_condition",
    f"WITH o AS (SELECT figure_code, {d_key('label')} AS k, enum, layer, pos FROM ({OFFERS}) o0), "
    "b AS (SELECT figure_code, k, first(enum ORDER BY layer, pos) AS enum FROM o GROUP BY 1, 2) "
    f"SELECT p.row_id, p.figure_code, p.value, b.enum FROM ({PROSE}) p LEFT JOIN b ON b.figure_code = p.figure_code AND b.k = {d_key('p.value')}",
)
def option_condition(spark, sf):
    return ops.option_condition(query(spark, sf, PROSE), query(spark, sf, OFFERS))


@registry.add("D3_latest_version", "SELECT f.figure_code, coalesce(max(t.version), 0) AS latest FROM {figures_published} f LEFT JOIN {templates} t ON t.figure_code = f.figure_code GROUP BY 1")
def latest_version(spark, sf):
    return ops.latest_version(*two(spark, sf, "figures_published", "templates"))


@registry.add("D6_first_wins", "SELECT asset_class, code, min(pos) AS pos, min_by(valuation_index, pos) AS valuation_index FROM {underlyings} u GROUP BY 1, 2")
def keep_first(spark, sf):
    rows = frame(spark, sf, "underlyings").select("asset_class", "code", "pos", "valuation_index")
    return first_wins(rows, ["asset_class", "code"], ["pos"])


RUNS = "SELECT o_custkey % 40 AS run_id, CASE o_orderstatus WHEN 'O' THEN 'published' WHEN 'P' THEN 'unchanged' ELSE CASE WHEN o_custkey % 40 < 20 THEN 'failed' ELSE 'unchanged' END END AS outcome FROM {orders}"


@registry.add(
    "D8_run_summary",
    f"SELECT run_id, count(*) AS n_files, count(*) FILTER (outcome = 'published') AS n_published, count(*) FILTER (outcome = 'failed') AS n_failed, "
    f"CASE WHEN count(*) FILTER (outcome = 'failed') > 0 THEN 'CompletedWithErrors' ELSE 'Succeeded' END AS status FROM ({RUNS}) r GROUP BY 1",
)
def run_summary(spark, sf):
    return ops.run_summary(query(spark, sf, RUNS))


@registry.add(
    "D11_generation_report",
    "SELECT figure_code, count(*) AS n_attributes, count(*) FILTER (mandatory) AS n_mandatory, count(*) FILTER (published_type = 'DATA') AS n_dates, "
    "count(*) FILTER (published_decimals > 0) AS n_with_decimals FROM {attributes} a GROUP BY 1",
)
def generation_report(spark, sf):
    return ops.generation_report(frame(spark, sf, "attributes"))


@registry.add(
    "E2_attribute_position",
    "SELECT figure_code, name, pos, row_number() OVER (PARTITION BY figure_code ORDER BY pos) AS position FROM (SELECT figure_code, name, min(pos) AS pos FROM {attributes} a GROUP BY 1, 2) d",
)
def attribute_position(spark, sf):
    return ops.attribute_position(frame(spark, sf, "attributes"))


@registry.add(
    "E3_activate_version",
    "SELECT figure_code, version, version = max(version) OVER (PARTITION BY figure_code) AS is_active FROM {templates} t",
)
def activate_version(spark, sf):
    return ops.activate_version(frame(spark, sf, "templates")).select("figure_code", "version", "is_active")


GENERATIONS = "SELECT o_custkey AS note_id, o_orderkey AS set_id, CAST(o_orderdate AS DATE) AS generated_on FROM {orders}"


@registry.add(
    "F1_top_generations",
    f"SELECT note_id, set_id, generated_on, CAST(rn AS INT) AS generation FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY generated_on DESC, set_id DESC) AS rn FROM ({GENERATIONS}) g) r WHERE rn <= 3",
)
def top_generations(spark, sf):
    return ops.top_generations(query(spark, sf, GENERATIONS), 3)


LAYERS = """SELECT p_brand AS figure_code, CAST(p_size % 4 AS INT) AS layer, p_type AS section, p_name AS key, p_partkey AS pos,
  CASE WHEN p_size % 3 = 0 THEN 'decimal' ELSE 'date' END AS data_type, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_partkey AS STRING) END AS label FROM {part}"""
REMOVED = "SELECT DISTINCT p_brand AS figure_code, p_type AS section FROM {part} WHERE p_partkey % 17 = 0"


@registry.add(
    "F2_overlay",
    f"""
SELECT figure_code, section, key, last(data_type ORDER BY layer, pos) AS data_type,
  last(nullif(label, '') ORDER BY layer, pos) FILTER (label <> '') AS label, max(layer) AS from_layer
FROM ({LAYERS}) l WHERE NOT EXISTS (SELECT 1 FROM ({REMOVED}) r WHERE r.figure_code = l.figure_code AND r.section = l.section) GROUP BY 1, 2, 3""",
)
def overlay(spark, sf):
    return ops.overlay(query(spark, sf, LAYERS), query(spark, sf, REMOVED))


OWN = "SELECT p_brand AS figure_code, p_type AS section, concat('r', CAST(p_partkey % 50 AS STRING)) AS rule_id, p_partkey AS pos FROM {part} WHERE p_size %% 2 = 0".replace("%%", "%")
INHERITED = OWN.replace("p_size % 2 = 0", "p_size % 2 = 1")


@registry.add(
    "F3_effective_rules",
    f"""
SELECT figure_code, section, rule_id, pos, count(*) OVER (PARTITION BY figure_code, rule_id) > 1 AS repeated
FROM (SELECT * FROM ({OWN}) o UNION ALL SELECT * FROM ({INHERITED}) i) u
WHERE NOT EXISTS (SELECT 1 FROM ({REMOVED}) r WHERE r.figure_code = u.figure_code AND r.section = u.section)""",
)
def effective_rules(spark, sf):
    return ops.effective_rules(query(spark, sf, OWN), query(spark, sf, INHERITED), query(spark, sf, REMOVED))


@registry.add(
    "F4_composite_hash",
    """
WITH f AS (SELECT o_orderkey AS file_id, sha256(CAST(o_orderkey AS STRING)) AS file_hash, o_orderkey % 25 AS a, o_custkey % 25 AS b, (o_custkey + 7) % 25 AS c FROM orders),
e AS (SELECT DISTINCT file_id, file_hash, unnest([a, b, c]) AS k FROM f)
SELECT file_id, sha256(file_hash || '|' || string_agg(k || '=' || sha256(n_name), '|' ORDER BY k || '=' || sha256(n_name))) AS composite
FROM e JOIN nation ON n_nationkey = k GROUP BY file_id, file_hash""",
)
def composite_hash(spark, sf):
    files = query(spark, sf, "SELECT o_orderkey AS file_id, sha2(CAST(o_orderkey AS STRING), 256) AS file_hash, "
                  "array_distinct(array(o_orderkey % 25, o_custkey % 25, (o_custkey + 7) % 25)) AS extends FROM {orders}")  # fmt: skip
    fragments = query(spark, sf, "SELECT n_nationkey AS fragment_id, sha2(n_name, 256) AS fragment_hash FROM {nation}")
    return ops.composite_hash(files, fragments)


FILES = "SELECT o_custkey AS figure_code, o_orderkey AS file_id, CASE WHEN o_orderkey % 9 = 0 THEN 'curated' ELSE 'generated' END AS source FROM {orders}"


@registry.add(
    "F5_curated_over_generated",
    f"SELECT figure_code, first(file_id ORDER BY source, file_id) AS file_id, min(source) AS source, count(*) FILTER (source = 'curated') > 1 AS conflict FROM ({FILES}) f GROUP BY 1",
)
def curated_over_generated(spark, sf):
    return ops.curated_over_generated(query(spark, sf, FILES))


LABELS = """SELECT p_partkey AS pos, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat('COE', lpad(CAST(p_partkey AS STRING), 6, '0'), ' - ', p_name)
  WHEN 1 THEN concat('COE', lpad(CAST(p_partkey AS STRING), 6, '0'), '– ', p_name) WHEN 2 THEN concat('COE', lpad(CAST(p_partkey AS STRING), 6, '0'), ' ', p_name)
  ELSE p_name END AS label FROM {part}"""


@registry.add(
    "H2_figure_index",
    rf"SELECT pos, label, nullif(regexp_extract(label, '^(COE\d{{6}})', 1), '') AS code, nullif(trim(regexp_replace(label, '^(COE\d{{6}})?\s*[-–—]?\s*', '')), '') AS name FROM ({LABELS}) l",
)
def figure_index(spark, sf):
    return ops.figure_index(query(spark, sf, LABELS))


PROSES = """SELECT doc_id AS field_id, CASE CAST(doc_id % 13 AS INT) WHEN 0 THEN 'Dados do Ativo' WHEN 1 THEN repeat('x', 71) WHEN 2 THEN '' WHEN 3 THEN '12 meses'
  WHEN 4 THEN 'Participação %' WHEN 5 THEN 'um dois três quatro cinco seis sete oito nove dez onze doze treze' ELSE concat('Campo ', source) END AS label,
 concat(text, CASE CAST(doc_id % 11 AS INT)
  WHEN 0 THEN ' Campo de preenchimento obrigatório. Formato: DD/MM/AAAA, posterior à indicada no campo "Data Inicial".'
  WHEN 1 THEN ' Preenchimento obrigatório, se indicado "Janela de datas". Formato: numérico com 8 inteiros e 4 decimais, maior que 0.'
  WHEN 2 THEN ' Campo obrigatório. Campo com as opções: Sim e Não.' WHEN 3 THEN ' Formato: alfanumérico de até 20 posições.'
  WHEN 4 THEN ' Formato: numérico percentual com 3 inteiros e 2 decimais. Não preencher se a Classe do Ativo Subjacente for igual a CESTA.'
  WHEN 5 THEN ' Campo com os domínios: Alta, Baixa, Ambas. Formato: texto.'
  WHEN 6 THEN ' Preenchimento obrigatório  quando indicado “Res. n. 8”. Formato: numérico com 4 inteiros e 1 decimal.'
  WHEN 7 THEN ' Preenchimento obrigatório. Se indicado "Não" fica em branco. Não preencher se a “Classe do Ativo  Subjacente” for igual a "CESTA".'
  WHEN 8 THEN ' Campo com as opções: "Alta",  Alta e “Baixa”. Campo obrigatório caso o campo seja "Alta".' ELSE '' END) AS text FROM {documents}"""


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# The comparison reads the prose with its own patterns.
_SAYS = lambda *phrases: " OR ".join(f"contains(folded, '{x}')" for x in phrases)
_BEFORE = lambda name: f"TRY_CAST(words[list_position(words, '{name}') - 1] AS INT)"
_LIST = "regexp_extract(text, '(?i)campo com (?:as op[çc][õo]es(?: de dom[íi]nio)?|os dom[íi]nios):([^.]*)', 1)"

EXTRACTED = f"""
SELECT field_id, data_type, CASE WHEN data_type IN ('decimal', 'percent') THEN decimals END AS decimals,
  CASE WHEN data_type IN ('decimal', 'percent') THEN CAST(repeat('9', whole) AS DECIMAL(20,0)) END AS upper_bound,
  CASE WHEN data_type = 'string' THEN coalesce(size, 100) END AS max_length, array_to_string(options, '|') AS options,
  CAST(len(options) AS INT) AS n_options, mandatory AND required_when IS NULL AS required, required_when, after_field, positive, not_for_baskets,
  len(options) > 12 AS too_many_options, data_type = 'string' AND size IS NULL AS length_assumed
FROM (SELECT *, CASE WHEN dated THEN 'date' WHEN number AND (list_contains(words, 'percentual') OR trim(label) LIKE '%\\%' ESCAPE '\\') THEN 'percent' WHEN number THEN 'decimal'
   WHEN list_sort([strip_accents(lower(o)) FOR o IN options]) = ['nao', 'sim'] THEN 'boolean' WHEN len(options) BETWEEN 1 AND 12 THEN 'enum' ELSE 'string' END AS data_type
 FROM (SELECT *, whole IS NOT NULL AND decimals IS NOT NULL AS number
  FROM (SELECT field_id, label, words, ({_SAYS('preenchimento obrigatorio', 'campo obrigatorio', 'e de preenchimento')}) AS mandatory, contains(folded, 'formato:') AS formatted,
    ({_SAYS('maior que 0', 'maior que zero')}) AS positive,
    regexp_matches(folded, 'nao preencher se a ["“”]?classe do ativo\\s+subjacente["“”]? for igual a ["“”]?cesta') AS not_for_baskets,
    ({_SAYS('dd/mm/aaaa', 'dd/mm/yyyy')}) AS dated, CASE WHEN list_contains(words, 'numerico') THEN coalesce({_BEFORE('inteiros')}, {_BEFORE('inteiro')}) END AS whole,
    CASE WHEN list_contains(words, 'numerico') THEN coalesce({_BEFORE('decimais')}, {_BEFORE('decimal')}) END AS decimals,
    TRY_CAST(list_filter(CASE WHEN list_contains(words, 'alfanumerico') THEN words[list_position(words, 'alfanumerico'):] END, lambda w: TRY_CAST(w AS INT) IS NOT NULL)[1] AS INT) AS size,
    list_filter(named, lambda o, i: list_position([lower(x) FOR x IN named], lower(o)) = i AND length(o) BETWEEN 1 AND 60) AS options,
    nullif(trim(regexp_extract(text, '(?i)obrigat[óo]rio\\s*,?\\s*(?:se|quando|caso)[^."“”]*["“”]([^"“”]+)["“”]', 1)), '') AS required_when,
    nullif(trim(regexp_extract(text, '(?i)posterior [àa] (?:indicada )?no campo\\s*["“”]([^"“”]+)["“”]', 1)), '') AS after_field
   FROM (SELECT *, strip_accents(lower(text)) AS folded, string_split_regex(strip_accents(lower(text)), '[^a-z0-9]+') AS words,
      [trim(o, ' "“”''.;') FOR o IN string_split_regex({_LIST}, ',|\\s+e\\s+')] AS named FROM ({{PROSES}}) p
     WHERE length(label) BETWEEN 1 AND 70 AND label NOT LIKE 'Dados%' AND NOT regexp_matches(label, '^[0-9]+ ') AND len(string_split(label, ' ')) <= 12) f) q
  WHERE mandatory OR formatted) n) r""".replace("{PROSES}", PROSES)


@registry.add("H4_extract_attributes", EXTRACTED)
def extract_attributes(spark, sf):
    return ops.extract_attributes(query(spark, sf, PROSES))


@registry.add(
    "H6_derive_rules",
    f"SELECT field_id, 'positive' AS rule, NULL AS argument FROM ({EXTRACTED}) e WHERE positive AND data_type IN ('decimal', 'percent') "
    f"UNION ALL SELECT field_id, 'date-after', after_field FROM ({EXTRACTED}) f WHERE data_type = 'date' AND after_field IS NOT NULL",
)
def derive_rules(spark, sf):
    return ops.derive_rules(extract_attributes(spark, sf))


@registry.add(
    "H5_merge_published_metadata",
    f"""
WITH d AS (SELECT field_id, figure_code, data_type, decimals, max_length, n_options, drafted_required, {d_key('name')} AS match_key FROM {{fields}} f0),
p AS (SELECT figure_code, match_key, min_by(field_code, pos) AS code, min_by(published_type, pos) AS kind, min_by(published_decimals, pos) AS decimals,
  min_by(published_length, pos) AS length, min_by(mandatory, pos) AS mandatory, min_by(n_values, pos) AS n_values
 FROM (SELECT *, {d_key('name')} AS match_key FROM {{attributes}} a0) a GROUP BY 1, 2),
j AS (SELECT coalesce(d.figure_code, p.figure_code) AS figure_code, coalesce(d.match_key, p.match_key) AS match_key, d.field_id, d.data_type AS was, d.decimals AS own_decimals,
  d.max_length AS own_length, coalesce(drafted_required, false) AS own_required, p.* EXCLUDE (figure_code, match_key),
  CASE WHEN d.field_id IS NULL THEN 'new ' || kind WHEN kind IN ('NUMERICO', 'TEXTO') THEN kind WHEN kind = 'DATA' AND d.data_type = 'date' THEN kind
   WHEN kind = 'DOMINIO' AND n_options = 0 AND n_values > 0 THEN 'LISTED' WHEN kind = 'DOMINIO' AND d.data_type IN ('enum', 'enumset', 'boolean') THEN kind ELSE 'none' END AS how
 FROM d FULL JOIN p ON d.figure_code = p.figure_code AND d.match_key = p.match_key)
SELECT figure_code, match_key, field_id, CASE WHEN how <> 'none' THEN code END AS field_code,
 CASE how WHEN 'new NUMERICO' THEN 'decimal' WHEN 'new TEXTO' THEN 'string' WHEN 'new DATA' THEN 'date' WHEN 'new DOMINIO' THEN 'enum' WHEN 'new HORA' THEN NULL
  WHEN 'NUMERICO' THEN CASE WHEN was IN ('percent', 'money', 'integer', 'decimal') THEN was ELSE 'decimal' END WHEN 'TEXTO' THEN CASE WHEN was IN ('string', 'text') THEN was ELSE 'string' END
  WHEN 'LISTED' THEN 'enum' ELSE was END AS data_type,
 CASE WHEN how LIKE '%NUMERICO' THEN decimals WHEN how IN ('TEXTO', 'LISTED') OR how LIKE 'new %' THEN NULL ELSE own_decimals END AS decimals,
 CASE WHEN how LIKE '%TEXTO' AND length > 0 THEN length WHEN how IN ('NUMERICO', 'LISTED') THEN NULL ELSE own_length END AS max_length,
 own_required OR (how <> 'none' AND coalesce(mandatory, false)) AS required, field_id IS NULL AS appended FROM j""",
)
def merge_published_metadata(spark, sf):
    return ops.merge_published_metadata(*two(spark, sf, "fields", "attributes"))
