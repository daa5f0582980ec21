"""Queries over readers, snapshots and artifacts. Files they read are written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strikebook.operators import validation
from strikebook.plans.frames import frame, query
from strikebook.plans.registry import Registry
from strikebook.plans.validation import TYPED, documents
from strikebook.session import checkpoint_dir
from strikebook.sources import exports, single_byte, snapshots

registry = Registry()


def scratch(spark, name: str) -> str:
    return checkpoint_dir(spark, f"{name}-{uuid.uuid4().hex}")


EXPORT = """SELECT concat_ws(';', CAST(p_partkey AS STRING), concat(' ', p_name, ' '), CASE WHEN p_size % 6 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END,
  CASE WHEN p_size % 2 = 0 THEN 'S' WHEN p_size % 3 = 0 THEN 'sim' ELSE 'N' END, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_brand END) AS line FROM {part}
UNION ALL SELECT concat_ws(';', CAST(p_partkey AS STRING), p_name) FROM {part} WHERE p_size % 10 = 0
UNION ALL SELECT 'KEY;NAME;SIZE;FLAG;BRAND' FROM {region} UNION ALL SELECT '20260828' FROM {region} WHERE r_regionkey = 0"""


@registry.add(
    "A1_read_export",
    """SELECT '20260828' AS as_of, CAST(p_partkey AS INT) AS key, p_name AS name, CASE WHEN p_size % 6 = 0 THEN 0 ELSE p_size END AS size,
  p_size % 2 = 0 OR p_size % 3 = 0 AS flag, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand FROM part""",
)
def read_export(spark, sf):
    path = scratch(spark, "export")
    # The stamp belongs to one file, so this proxy export is written as one; a reader takes many.
    query(spark, sf, EXPORT).coalesce(1).write.text(path)
    columns = [("key", 0, "int"), ("name", 1, "text"), ("size", 2, "int"), ("flag", 3, "flag"), ("brand", 4, "text")]
    return exports.read_export(spark, path, columns, 5, "KEY")


@registry.add("A2_read_annex", "SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def read_annex(spark, sf):
    path = scratch(spark, "annex")
    frame_ = query(spark, sf, "SELECT doc_id, text FROM {documents}")
    frame_.write.csv(path, sep=";", quote='"', escape='"', header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return exports.read_annex(spark, path, "doc_id long, text string")


@registry.add(
    "A3_read_domain_files",
    """SELECT concat('COE', CAST(p_partkey AS STRING)) AS figure_code, s AS section, CAST(s = 'payoff' AS INT) AS section_pos, 0 AS field_pos, p_name AS "key", p_type AS data_type
FROM (SELECT *, unnest(['common', 'payoff']) AS s FROM part WHERE p_partkey % 7 <> 0)""",
)
def read_domain_files(spark, sf):
    path = scratch(spark, "domain")
    text = query(spark, sf, """SELECT CASE WHEN p_partkey % 7 = 0 THEN '{"figureCode": "BROKEN' ELSE concat('{"figureCode":"COE', CAST(p_partkey AS STRING),
      '","sections":[{"key":"common","fields":[{"key":"', p_name, '","dataType":"', p_type, '"}]},{"key":"payoff","fields":[{"key":"', p_name, '","dataType":"', p_type, '"}]}],"rules":[]}') END AS line FROM {part}""")
    text.write.text(path)
    return exports.read_domain_files(spark, path, multi_line=False)["fields"]


@registry.add("A4_read_notes", f"SELECT note_id, issue AS issue_date, maturity AS maturity_date, CAST(quantity AS DECIMAL(28,4)) AS quantity, modality, CAST(cap AS DECIMAL(28,8)) AS cap, asset FROM ({TYPED}) t")
def read_notes(spark, sf):
    notes = validation.read_notes(documents(spark, sf), validation.load_fields())
    return notes.select(
        "note_id", F.col("common.issueDate").alias("issue_date"), F.col("common.maturityDate").alias("maturity_date"),
        F.col("common.quantity").cast("decimal(28,4)").alias("quantity"), F.col("common.modality").alias("modality"),
        F.col("payoff.cap").cast("decimal(28,8)").alias("cap"), F.col("underlying.asset").alias("asset"),
    )


LISTING = """SELECT concat(CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '_' ELSE '-' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Ativos ' ELSE 'D_' END, CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN '.txt' ELSE '.csv' END) AS name FROM {orders}
  UNION ALL SELECT concat('notes', CAST(o_custkey AS STRING), '.csv') FROM {orders}"""
ALIASES = """SELECT c_custkey AS export, concat('d', CAST(c_custkey AS STRING)) AS alias, 1 AS alias_rank FROM {customer}
  UNION ALL SELECT c_custkey, concat('ATIVOS-', CAST(c_custkey AS STRING)), 2 FROM {customer}"""
NEWEST = f"""SELECT export, stamp, name FROM (SELECT export, stamp, name, row_number() OVER (PARTITION BY export ORDER BY alias_rank, stamp DESC, name) AS rn FROM (
  SELECT name, left(name, 8) AS stamp, upper(regexp_replace(regexp_replace(substr(name, 10), '\\.[^.]*$', ''), '[^A-Za-z0-9]', '', 'g')) AS k FROM ({LISTING}) l WHERE regexp_matches(name, '^[0-9]{{8}}[_-]')) f
  JOIN (SELECT *, upper(regexp_replace(alias, '[^A-Za-z0-9]', '', 'g')) AS ak FROM ({ALIASES}) a0) a ON a.ak = f.k) r WHERE rn = 1"""


@registry.add("A5_newest_export", NEWEST)
def newest_export(spark, sf):
    return exports.newest_export(query(spark, sf, LISTING), query(spark, sf, ALIASES))


MANIFEST = "SELECT c_custkey AS export, CASE WHEN c_custkey % 3 = 0 THEN '19960101' ELSE '20010731' END AS stamp FROM {customer} WHERE c_custkey % 4 <> 0"


@registry.add(
    "A6_sync_status",
    f"""SELECT c.c_custkey AS export, n.stamp, m.stamp AS held, CASE WHEN n.stamp IS NULL THEN 'missing' WHEN m.stamp IS NULL OR n.stamp > m.stamp THEN 'downloaded'
  WHEN n.stamp < m.stamp THEN 'stale' ELSE 'current' END AS status FROM customer c LEFT JOIN ({NEWEST}) n ON n.export = c.c_custkey LEFT JOIN ({MANIFEST}) m ON m.export = c.c_custkey""",
)
def sync_status(spark, sf):
    every = query(spark, sf, "SELECT c_custkey AS export FROM {customer}")
    return exports.sync_status(every, newest_export(spark, sf), query(spark, sf, MANIFEST))


def encoded(spark, sf):
    return single_byte.encode_single_byte(query(spark, sf, "SELECT doc_id, text FROM {documents}"), "text", "content")


@registry.add(
    "A7_transcode",
    "SELECT doc_id, CAST(n - 1 AS INT) AS line_no, lines[n] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM "
    "(SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM documents) s) t",
)
def transcode(spark, sf):
    return single_byte.transcode(encoded(spark, sf), "doc_id", "content")


@registry.add("O7_encode_single_byte", "SELECT doc_id, length(text) AS n_bytes FROM documents")
def encode_single_byte(spark, sf):
    return encoded(spark, sf).select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"))


@registry.add(
    "A8_replace_snapshot",
    "SELECT export, as_of, n_rows FROM (SELECT 'part' AS export, '20260828' AS as_of, count(*) AS n_rows FROM part UNION ALL SELECT 'supplier', '20260828', count(*) FROM supplier) x",
)
def replace_snapshot(spark, sf):
    root = scratch(spark, "snapshot")
    tables = {name: query(spark, sf, "SELECT * FROM {" + name + "}") for name in ("part", "supplier")}
    snapshots.replace_snapshot(spark, root, tables, "20260828")
    # A load with an empty export leaves everything as it was.
    snapshots.replace_snapshot(spark, root, {"part": tables["part"].filter("false")}, "20260829")
    return snapshots.load_ledger(spark, root).select("export", "as_of", "n_rows")


@registry.add("D12_load_counts", " UNION ALL ".join(f"SELECT '{t}' AS export, count(*) AS n_rows FROM {t}" for t in ("part", "supplier", "nation", "lineitem")))
def load_counts(spark, sf):
    return snapshots.load_counts({t: query(spark, sf, "SELECT * FROM {" + t + "}") for t in ("part", "supplier", "nation", "lineitem")})


@registry.add("A10_store_artifacts", "SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS sha256 FROM documents")
def store_artifacts(spark, sf):
    files = query(spark, sf, "SELECT doc_id, encode(text, 'UTF-8') AS content FROM {documents}")
    return snapshots.store_artifacts(files).select("doc_id", "n_bytes", "sha256")


SETS = "SELECT o_orderkey AS set_id, o_custkey AS note_id, CAST(o_orderdate AS DATE) AS generated_on FROM {orders}"
STORED = "SELECT l_orderkey AS set_id, l_orderkey * 8 + l_linenumber AS file_id, concat(l_returnflag, l_linestatus) AS operation, l_partkey AS n_bytes FROM {lineitem}"


@registry.add(
    "A11_artifact_history",
    f"""SELECT r.set_id, r.note_id, r.generated_on, CAST(r.rn AS INT) AS generation, f.n_files, f.n_bytes, f.operations FROM (
 SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY generated_on DESC, set_id DESC) AS rn FROM ({SETS}) s) r
LEFT JOIN (SELECT set_id, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations FROM ({STORED}) x GROUP BY 1) f ON f.set_id = r.set_id
WHERE rn <= 5""",
)
def artifact_history(spark, sf):
    return snapshots.artifact_history(query(spark, sf, SETS), query(spark, sf, STORED), 5)


WANTED = "SELECT DISTINCT CASE WHEN l_orderkey % 2 = 0 THEN o_custkey ELSE 1 END AS note_id, l_orderkey * 8 + l_linenumber AS file_id FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"


@registry.add(
    "A12_read_artifact",
    f"SELECT w.note_id, w.file_id, f.set_id, f.operation, f.n_bytes FROM ({WANTED}) w JOIN ({STORED}) f ON f.file_id = w.file_id JOIN ({SETS}) s ON s.set_id = f.set_id AND s.note_id = w.note_id",
)
def read_artifact(spark, sf):
    return snapshots.read_artifact(query(spark, sf, SETS), query(spark, sf, STORED), query(spark, sf, WANTED))
