"""Archives that other writers made, and tables with clashing columns and very long pages."""

import base64
import hashlib

import pytest

from strikebook.llm import suffix_dedup, warc
from strikebook.llm.shared import written


def response(name, payload, *headers):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return warc.record_bytes("response", name, [("WARC-Target-URI", "http://a/"), *headers], http + payload)


def test_any_record_id_and_digest(spark):
    def hexed(name):
        return f"{name}:{hashlib.new(name.replace('-', ''), b'body').hexdigest()}"

    good = [
        response("urn:uuid:3f9c0f52-6d34-4a53-8a3e-6f0a3b1d9d10", b"body"),
        response("urn:uuid:x:12", b"body", ("WARC-Payload-Digest", hexed("sha256"))),
        response("http://ids.example/7", b"body", ("WARC-Payload-Digest", hexed("md5").upper())),
        response("urn:page:8", b"body", ("WARC-Payload-Digest", "sha-256:" + base64.b32encode(hashlib.sha256(b"body").digest()).decode())),
        response("urn:page:99999999999999999999", b"body", ("WARC-Payload-Digest", "blake3:abc")),
    ]
    bad = response("urn:uuid:y", b"body", ("WARC-Payload-Digest", "sha1:" + warc.bare_digest(b"other")))
    odd = warc.record_bytes("response", "urn:uuid:z", [], b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\nbody")
    revisit = warc.record_bytes("revisit", "urn:uuid:r", [("WARC-Refers-To", "<urn:uuid:3f9c>")], b"HTTP/1.1 200 OK\r\n\r\n")
    df = spark.createDataFrame([("a", bytearray(b"".join([*good[:2], bad, odd, *good[2:], revisit])))], "archive string, content binary")
    rows = {r.record_id: r for r in warc.records(df).collect()}
    assert len(rows) == 8
    assert {k for k, r in rows.items() if r.problem} == {"urn:uuid:y"}
    assert {k: r.page_id for k, r in rows.items() if r.page_id is not None} == {"urn:page:8": 8}
    assert rows["urn:uuid:r"].refers_to_id == "urn:uuid:3f9c" and rows["urn:uuid:r"].refers_to is None
    assert all(r.payload == b"body" for r in rows.values() if r.record_type == "response")


def test_files_are_read_as_they_lie(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.warc.gz").write_bytes(response("urn:uuid:1", b"x" * i) + response(f"urn:page:{i}", b"y"))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = warc.records(files, "path", "content").collect()
    assert sorted((r.archive[-9:], r.record_id, r.problem) for r in rows) == sorted((f"{i}.warc.gz", k, "") for i in range(2) for k in ("urn:uuid:1", f"urn:page:{i}"))


def test_clashing_columns_and_a_very_long_page(spark):
    pages = [(1, "u", "z" * 3_000_000, "x", "x", b"x", True), (2, "u", "z" * 3_000_000, "x", "x", b"x", True), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, key string, digest string, payload binary, revisit boolean")
    rows = {r.page_id: r for r in warc.records(written(warc.archives(df), "long-pages")).collect()}
    assert (rows[1].record_type, rows[1].refers_to, rows[1].payload_bytes) == ("revisit", 2, 3_000_000)
    assert rows[2].payload == b"z" * 3_000_000 and rows[3].payload == b"" and not any(r.problem for r in rows.values())


def test_keys_that_are_no_integers_are_refused(spark):
    df = spark.createDataFrame([("a", "u", "t")], "page_id string, url string, html string")
    with pytest.raises(ValueError, match="must be an integer"):
        warc.archives(df)
    with pytest.raises(ValueError, match="must be an integer"):
        suffix_dedup.deduplicated(df, "page_id", "html")
