"""WARC archives: written with one gzip member per record, read back sequentially with all checks.

``archives`` makes rows (archive, content) of at most about ``ARCHIVE_BYTES`` compressed bytes, each a
complete .warc.gz file; ``records`` reads such rows, or files read with Spark's ``binaryFile`` source.
Of records with equal payloads (by SHA-1) of at least ``least`` bytes the one with the largest key is a
response, the others are revisit records that refer to it. The join on digests carries each payload once;
a digest that holds many rows is a join key that Spark splits at run time.

The reader decompresses in small steps, takes the members one after another, frames each block by its
Content-Length, and compares block and payload digests. It reads any archive of one member per record: record ids
are text, page ids follow from ids of the form ``urn:page:7``; digests may be SHA-1, SHA-256, SHA-512 or MD5 in base32 or hex,
others are not compared.

Defined cases: a null html is an empty payload. Rows that repeat the largest key of a group are all
responses. A null key ranks below all others; if all keys of a group are null, all are responses. A null
url is written as an empty target. An empty table gives no archives. A damaged record gives a row whose
``problem`` says what is wrong, and the next record is read; after broken compression the rest of that archive
can't be. Keys are integers; other keys are refused. Columns of other names are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikebook.llm.shared import integer_key, table, written

ARCHIVE_BYTES, STEP = 8_000_000, 1 << 16
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def bare_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


#: Digests the reader compares.
DIGESTS = ("sha1", "sha256", "sha512", "md5")


def digest_differs(said: str, data: bytes) -> bool:
    """Whether a labelled digest is known and not that of the data."""
    label, _, value = said.partition(":")
    name = label.strip().lower().replace("-", "")
    if name not in DIGESTS:
        return False
    raw = hashlib.new(name, data).digest()
    return value.strip().lower().rstrip("=") not in (raw.hex(), base64.b32encode(raw).decode().lower().rstrip("="))


def record_bytes(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in headers]
    lines += [f"WARC-Block-Digest: sha1:{bare_digest(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_record(key: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> bytes:
    name = lambda k: "urn:page:" + ("none" if k is None else str(k))
    headers = [("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha1:{bare_digest(payload)}")]
    http = HTTP % len(payload)
    if not revisit:
        return record_bytes("response", name(key), [*headers, ("Content-Type", "application/http; msgtype=response")], http + payload)
    headers += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", f"<{name(refers_to)}>"),
    ]
    return record_bytes("revisit", name(key), headers, http)


def referred(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """key, url, payload, refers_to, revisit: the last two from the groups of equal payloads."""
    integer_key(pages, key)
    rows = pages.select(
        F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    groups = (
        rows.where(F.length("payload") >= least)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.max("key").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1 and refers_to is not null")
    )
    joined = rows.join(groups, (F.col("digest") == F.col("of")) & (F.length("payload") >= least), "left")
    return joined.select(
        "key", "url", "payload", "refers_to", (F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to"))).alias("revisit")
    )


def archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Rows (archive, content); archives are named after the task that wrote them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            name = f"pages-{task:06d}-{n:06d}.warc.gz"
            info = record_bytes("warcinfo", f"urn:archive:{name}", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_pydict({"archive": [name], "content": [b"".join([info, *parts])]})

        for batch in batches:
            for row in batch.to_pylist():
                data = page_record(row["key"], row["url"], row["payload"], row["refers_to"], row["revisit"])
                parts.append(data)
                size += len(data)
                if size >= archive_bytes:
                    yield done()
                    n, parts, size = n + 1, [], 0
        if parts:
            yield done()

    return referred(pages, key, url, html, least).mapInArrow(run, "archive string, content binary")


def members(content: bytes) -> Iterator[bytes]:
    """The decompressed gzip members of an archive, read in small steps."""
    view, at = memoryview(content), 0
    pending = b""
    while at < len(view) or pending:
        unpack, found = zlib.decompressobj(31), []
        while not unpack.eof:
            if not pending:
                if at >= len(view):
                    raise ValueError("the last member ends early")
                pending, at = bytes(view[at : at + STEP]), at + STEP
            found.append(unpack.decompress(pending))
            pending = unpack.unused_data
        yield b"".join(found)


def parsed(member: bytes) -> dict:
    """One record: its headers by lower-case name, its block, and what is wrong with it (or empty)."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
    length = headers.get("content-length", "")
    if not version.startswith("WARC/") or not length.isdigit():
        return {"headers": headers, "block": b"", "problem": "no record header"}
    block = rest[: int(length)]
    problem = ""
    if len(block) < int(length) or rest[int(length) :] != b"\r\n\r\n":
        problem = "the block does not end where its length says"
    elif digest_differs(headers.get("warc-block-digest", ""), block):
        problem = "block digest differs"
    return {"headers": headers, "block": block, "problem": problem}


RECORD = "archive string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_id string, payload binary, problem string"


def records(files: DataFrame, archive: str = "archive", content: str = "content") -> DataFrame:
    """A row per response or revisit record in ``files``; revisits have no payload."""

    def bare(uri: str | None) -> str | None:
        return uri.strip("<> ") if uri is not None else None

    def page(uri: str | None) -> int | None:
        """The key in a record id of our own archives."""
        found = re.fullmatch(r"urn:page:(-?[0-9]{1,19})", bare(uri) or "")
        key = int(found[1]) if found else None
        return key if key is not None and -(1 << 63) <= key < 1 << 63 else None

    def row(name: str, found: dict) -> dict | None:
        headers, problem = found["headers"], found["problem"]
        kind = headers.get("warc-type")
        if kind not in ("response", "revisit") and not problem:
            return None
        http, _, payload = found["block"].partition(b"\r\n\r\n")
        labelled = headers.get("warc-payload-digest", "")
        if kind == "response" and not problem and digest_differs(labelled, payload):
            problem = "payload digest differs"
        said = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        n_bytes = int(said[0]) if said and said[0].strip().isdigit() else len(payload)
        if kind == "response" and not problem and n_bytes != len(payload):
            problem = "payload is not as long as it says"
        return {
            "archive": name, "record_id": bare(headers.get("warc-record-id")), "page_id": page(headers.get("warc-record-id")),
            "url": headers.get("warc-target-uri"), "payload_bytes": n_bytes, "payload_digest": labelled.removeprefix("sha1:"), "record_type": kind,
            "refers_to": page(headers.get("warc-refers-to")), "refers_to_id": bare(headers.get("warc-refers-to")), "payload": payload if kind == "response" else None, "problem": problem,
        }

    types = pa.schema(
        [
            ("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload", pa.binary()), ("problem", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[dict] = []
                try:
                    for member in members(data.as_py() or b""):
                        if (found := row(name, parsed(member))) is not None:
                            rows.append(found)
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows = []
                except (zlib.error, ValueError) as error:
                    rows.append(dict.fromkeys(types.names) | {"archive": name, "problem": str(error)})
                yield pa.RecordBatch.from_pylist(rows, types)

    return files.select(archive, content).mapInArrow(run, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written to the shared folder and read back."""
    files = written(archives(table(spark, sf_dir, "pages")), "warc")
    return records(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
g AS (SELECT hex, max(page_id) AS refers_to, count(*) AS n FROM p GROUP BY hex),
digest AS (
  SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    ('0x' || substr(hex, (i // 8) * 10 + 1, 10))::bigint >> (35 - 5 * (i % 8))::bigint) % 32, 1)), '') AS d FROM g)
SELECT page_id, octet_length(payload)::bigint AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = refers_to THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> refers_to THEN refers_to END AS refers_to, '' AS problem
FROM p JOIN g USING (hex) JOIN digest USING (hex)"""
