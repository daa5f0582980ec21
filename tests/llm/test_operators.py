"""Each operator on rows with nulls, empty and long texts, ties, repeats and clashing columns, against plain Python."""

import hashlib
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strikebook.llm import (
    best_fit,
    decontaminate,
    html_template,
    license_scan,
    ngram_join,
    packed_matrices,
    quality_rules,
    suffix_dedup,
    token_counts,
    warc,
)
from strikebook.llm.shared import written

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(R.randint(1, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = prose(30_000, 1)
PAGE = prose(120, 2)
NEAR = PAGE.split()
NEAR[60] = "changed"
TEXTS = [
    (1, PAGE), (2, None), (3, ""), (4, "   \n\t "), (5, PAGE), (6, " ".join(NEAR)), (6, " ".join(NEAR)), (7, LONG),
    (8, PAGE[:200] + " Middle " + PAGE[200:]), (9, "one two three"), (10, "ONE two\nthree"), (None, prose(60, 3)),
    (11, "--" * 150 + "\n" + "--" * 150), (12, "Licensed under the MIT License. CC-BY, cc by; Licensed under GNU General  Public\nLicense v2. All rights reserved"),
    (13, "<|endoftext|>Hello  it's <|startoftext|> İΣ 日本 ½\r\n"), (14, "a b c d e f g h " * 40), (15, LONG[5000:5300] + "#" * 40),
]
SCHEMA = "doc_id long, text string, lang string, n_words string, KEPT string, _row int, doc int, tag int, class int, spans int, piece int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if i % 5 == 0 else "en", "x", "y", i, i, i, i, i, i) for i, (k, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).sortWithinPartitions("doc").persist()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc < 0")


def ids_of(name, text, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return library.encode(text or "", add_special_tokens=False).ids + end


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check_packing(rows, name, end, code):
    bins = {}
    seen = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault((r.doc_id, r.piece), set()).add((r.start, r.length, r.ids_crc32))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    expected = {}
    n = 0
    for key, text in TEXTS:
        ids = ids_of(name, text, end)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected.setdefault((key, piece), set()).add((start, len(part), zlib.crc32(struct.pack(f"<{len(part)}{code}", *part))))
            n += 1
    assert seen == expected
    assert len(rows) == n


def test_best_fit(docs, nothing):
    check_packing(best_fit.pack(docs).collect(), "word_bpe_49k.json", [1], "I")
    assert best_fit.pack(nothing).collect() == []


def test_best_fit_closes_the_fullest():
    bins = best_fit.OpenBins(10, 2, 0)
    assert [bins.place(s) for s in (6, 7, 3, 4, 5, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    bins = best_fit.OpenBins(10, 2, 0)
    # bins with 4, 3 and 2 free: the one with 2 free is closed
    assert [bins.place(s) for s in (6, 7, 8, 2)] == [(0, 0), (1, 0), (2, 0), (1, 7)]


def test_packed_matrices(docs, nothing):
    sequences = written(packed_matrices.matrices(docs), "test-matrices")
    rows = packed_matrices.segments(sequences).withColumnRenamed("key", "doc_id").collect()
    check_packing(rows, "byte_bpe_50k.json", [50256], "H")
    for s in sequences.collect():
        used = s.cu_seqlens[-1]
        ids = struct.unpack("<4096H", s.ids)
        assert set(ids[used:]) <= {50256}
        assert s.position_resets == (s.cu_seqlens if used < 4096 else s.cu_seqlens[:-1])
        assert [b - a for a, b in zip(s.cu_seqlens, s.cu_seqlens[1:], strict=False)] == [x.length for x in s.segments]
    assert packed_matrices.matrices(nothing).collect() == []


def test_capacity_tree():
    r = random.Random(1)
    tree, held = packed_matrices.CapacityTree(100), []
    for _ in range(2000):
        if held and r.random() < 0.5:
            x = held.pop(r.randrange(len(held)))
            tree.add(x, -1)
        else:
            held.append(r.randint(0, 100))
            tree.add(held[-1], 1)
        size = r.randint(0, 100)
        assert tree.least(size) == min((x for x in held if x >= size), default=None)


def test_token_counts(docs, nothing):
    rows = token_counts.with_counts(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        n = len(ids_of("byte_bpe_50k.json", r.text, []))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    assert token_counts.with_counts(nothing).collect() == []


def test_license_scan(docs, nothing):
    rows = license_scan.scan(docs, with_detections=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        words = words_of(r.text)
        starts = [
            (i, label)
            for label, phrase in license_scan.BASE
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert (r.first_word, r.last_word) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in starts}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    one = next(r for r in rows if r.doc_id == 12)
    assert "mit" in one.labels.split(",") and "gpl-2.0" in one.labels.split(",") and one.score == 0.95
    assert one.n_suppressed > 0
    assert license_scan.scan(nothing).collect() == []
    assert len(license_scan.rules()) > 200


def test_quality_rules(spark, docs, nothing):
    labels = spark.createDataFrame(
        [(k, 1, 0) for k, _ in TEXTS if k] + [(None, 1, 0), (1, None, 1), (2, 0, None)], "doc_id long, quality int, toxic int"
    )
    figures = quality_rules.measured(docs)
    rows = quality_rules.judged(figures, quality_rules.cutoffs(figures, labels)).collect()
    assert len(rows) == len(TEXTS)
    texts = {}
    for k, t in TEXTS:
        texts.setdefault(k, t)
    for r in rows:
        text = texts[r._key] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 5000 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        if again is not None:
            assert r.n_repeat_words == len({j for i, w in enumerate(windows) if w in again for j in (i, i + 1, i + 2)})
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        # far too few labels to prove any cutoff
        assert r.kept == (not r.base_failed)
    kept = quality_rules.keep(docs, labels.where("false"))
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert quality_rules.keep(nothing, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(k, n) for n in (1, 10, 300) for k in (0, 1, 2) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p"))
    for r in df.collect():
        exact = 1.0 if r.k >= r.n * 0.05 else sum(comb(r.n, j) * 0.05**j * 0.95 ** (r.n - j) for j in range(r.k + 1))
        assert abs(r.p - exact) < 1e-9


def test_cutoffs_hold_their_promise(spark):
    rows = [(i, f"{prose(80, i)} {'#' * (i % 100)}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 100 < 90), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    figures = written(quality_rules.measured(docs), "test-figures")
    cut = quality_rules.cutoffs(figures, labels, risk=0.25)
    clean = [r for r in quality_rules.judged(figures, cut).collect() if r._key % 100 < 90]
    assert cut.first()["_cut_symbols"] is not None
    assert sum(not r.kept for r in clean) <= 0.25 * len(clean)


def test_decontaminate(spark, docs, nothing):
    words = PAGE.split()
    items = [
        (1, " ".join(words[10:40])), (1, " ".join(words[80:100]).upper()), (2, "one, two"), (3, None), (4, ""), (None, LONG[:300]),
        (5, prose(40, 99)), (6, "d e f g h a b c d e f g h a"), (5, prose(40, 98)),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.annotated(docs, benchmark).collect()
    blocks = decontaminate.annotated(docs, benchmark, block_bytes=200).collect()
    assert sorted(map(str, rows)) == sorted(map(str, blocks))
    assert len(rows) == len(TEXTS)
    windows = [(i, w[j : j + min(13, len(w))]) for i, w in ((i, words_of(t)) for i, t in items) if w for j in range(len(w) - min(13, len(w)) + 1)]
    for r in rows:
        w, hit, names = words_of(r.text), set(), set()
        joined = " " + " ".join(w) + " "
        for item, window in windows:
            if f" {' '.join(window)} " in joined:
                places = [i for i in range(len(w)) if w[i : i + len(window)] == window]
                hit.update(i + k for i in places for k in range(len(window)))
                names.add(item)
        names = sorted(str(x) for x in names if x is not None)
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert sum(s.end - s.start for s in r.spans) == len(hit)
    assert any(r.contaminated for r in rows)
    assert decontaminate.keep(docs, benchmark).columns == docs.columns
    assert decontaminate.annotated(nothing, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate.annotated(docs, benchmark.where("false")).collect())


def test_warc(spark):
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (4, "u", ""), (5, "u", "x" * 200_000), (None, "u", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    files = written(warc.archives(df, archive_bytes=300), "test-warc")
    rows = warc.records(files).collect()
    assert len(rows) == len(pages)
    by = {}
    for r in rows:
        assert r.problem == ""
        by.setdefault(r.page_id, []).append(r)
    assert [(r.record_type, r.refers_to) for r in by[2]] == [("response", None)]
    assert [(r.record_type, r.refers_to) for r in by[1]] == [("revisit", 2)]
    assert [(r.record_type, r.refers_to) for r in by[None]] == [("revisit", 2)]
    assert [r.record_type for r in by[4]] == ["response"] * 2 and by[3][0].refers_to == 4
    assert by[5][0].payload == b"x" * 200_000 and by[5][0].payload_digest == warc.bare_digest(b"x" * 200_000)
    assert by[1][0].payload_bytes == len("<p>é</p>".encode()) and by[1][0].payload_digest == by[2][0].payload_digest
    assert {r.record_type for r in warc.records(warc.archives(df, least=1000)).collect()} == {"response"}
    assert warc.archives(df.where("false")).collect() == []


def test_warc_damage(spark):
    good = warc.page_record(7, "u", b"payload", None, False)
    cut, flipped = good[:-10], warc.page_record(8, "u", b"other", None, False)
    wrong = warc.record_bytes("response", "urn:page:9", [("WARC-Payload-Digest", "sha1:" + warc.bare_digest(b"zzz"))], b"HTTP/1.1 200 OK\r\n\r\npayload")
    df = spark.createDataFrame([("a", bytearray(good + cut)), ("b", bytearray(wrong + flipped)), ("c", bytearray(b"junk")), ("d", None)], "archive string, content binary")
    rows = warc.records(df).collect()
    assert sorted((r.archive, r.page_id or 0, r.problem == "") for r in rows) == [("a", 0, False), ("a", 7, True), ("b", 8, True), ("b", 9, False), ("c", 0, False)]


def test_html_template(spark):
    frame = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a>Menu</a><li>More</ul></nav>{}<footer>&copy; foot</footer></body></html>"
    article = "<div class='ad'>Buy</div><article><h1>Head &amp; title</h1><p>One <b>bold</b>er<br>two&nbsp; x<p>Three</p><section class='comments'><p>nice!</p></section></article><aside>side</aside>"
    plain = "<div id=content><h2>Title {0}</h2><p>Body {0} of the page, which is long enough</p><p>more</p></div><div class='sidebar widget'>links</div><div>legal</div>"
    pages = [(i, f"http://a.example/{i}", frame.format(article)) for i in range(4)]
    pages += [(10 + i, f"http://b.example/{i}", frame.format(plain.format(i))) for i in range(4)]
    pages += [(20, None, None), (21, "x", ""), (22, "http://a.example/9", "<p>only &lt;this"), (0, "http://a.example/0", frame.format(article)), (None, "http://a.example/7", frame.format(article))]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, host int")
    rows = html_template.extracted(df).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text)
        if r.page_id is None or r.page_id < 4:
            assert r.text == "Head & title One bolder two x Three"
        elif r.page_id < 20:
            assert r.text == f"Title {r.page_id - 10} Body {r.page_id - 10} of the page, which is long enough more"
        else:
            assert r.text == ("only <this" if r.page_id == 22 else "")
    assert html_template.extracted(df.where("false")).collect() == []


def test_suffix_dedup(docs, nothing):
    result = suffix_dedup.deduplicated(docs, with_text=True)
    rows = result.collect()
    assert len(rows) == len(TEXTS)
    seen, expected = set(), {}
    unique = sorted({(k is not None, k or 0, t or "") for k, t in TEXTS})
    for known, key, text in unique:
        data = text.encode()
        marks = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                marks[i : i + 100] = b"\1" * 100
            else:
                seen.add(data[i : i + 100])
        kept = bytes(x for x, m in zip(data, marks, strict=True) if not m)
        expected.setdefault(key if known else None, []).append((len(data), sum(marks), len(re.findall(b"\1+", bytes(marks))), hashlib.sha256(kept).hexdigest()))
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in expected[r.doc_id]
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    reduced = suffix_dedup.reduced(docs)
    assert reduced.columns == docs.columns
    assert {r.text for r in reduced.where("doc_id = 5").collect()} == {""}
    assert suffix_dedup.deduplicated(nothing).collect() == []


def test_run_index():
    from strikebook.llm.run_index import repeated_windows

    r = random.Random(3)
    for _ in range(100):
        base = bytes(r.choice(b"ab") for _ in range(40))
        pieces = list({base[(a := r.randint(0, 30)) : a + r.randint(1, 20)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 12))})
        seen, expected = set(), []
        for p in pieces:
            found = []
            for i in range(len(p) - 3):
                found += [i] if p[i : i + 4] in seen else []
                seen.add(p[i : i + 4])
            expected.append(found)
        assert [x.tolist() for x in repeated_windows(pieces, 4)] == expected


def test_ngram_join(docs, nothing):
    rows = ngram_join.joined(docs).collect()
    assert len(rows) == len(TEXTS)

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(k, shingles(t)) for k, t in TEXTS]
    group = list(range(len(sets)))
    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    for i, (k, x) in enumerate(sets):
        if k is not None:
            least = min(q for (q, _), g in zip(sets, group, strict=True) if g == group[i] and q is not None)
            assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id == k} == {(len(x), least)}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in rows if r.doc_id is not None} | {None}
    assert ngram_join.joined(nothing).collect() == []


def linked_groups(texts):
    """The least key of each text's group, by comparing all pairs; and the sets of shingles."""
    sets = []
    for t in texts:
        words = t.split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group, sets


def imposed_order(monkeypatch, texts):
    """Shingles in the order of these texts, instead of rare ones first: the order must not decide results."""
    import numpy as np

    from strikebook.llm.shingles import shingle_sets

    counts = {}
    for place, value in enumerate(shingle_sets(texts)):
        assert len(value) == 1
        counts.setdefault(int(value[0]) >> 16, place + 1)
    heads = np.array(sorted(counts), np.uint64)
    monkeypatch.setattr(ngram_join, "frequent_shingles", lambda docs, text: (heads, np.array([counts[int(h)] for h in heads]), 16))


def test_ngram_join_counts_shingles_in_one_buffer(monkeypatch):
    import tracemalloc
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from strikebook.llm.shingles import shingle_sets

    def batches(texts):
        return (pa.RecordBatch.from_arrays([pa.array(texts[i : i + 2], pa.string())], ["text"]) for i in range(0, len(texts), 2))

    def long_text(k, n):
        return " ".join(map(str, range(k * n, k * n + n)))

    # 2.4 million shingles: the buffer holds 16 MB and is sorted in place
    def many():
        return (b for k in range(120) for b in batches([long_text(k, 20_000)]))

    tracemalloc.start()
    sent = sum(np.frombuffer(n.as_py(), np.uint16).sum(dtype=int) for b in ngram_join.shingle_blocks(many(), 8) for n in b.column(2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 120 * 19_996
    assert peak < 64e6, f"{peak / 1e6:.0f} MB"

    # copies count once; a set may be larger than the buffer, texts may be empty
    monkeypatch.setattr(ngram_join, "FLUSH", 300)
    monkeypatch.setattr(ngram_join, "SENT", 50)
    texts = [*(long_text(k, 40) for k in range(20)), long_text(0, 40), None, "", "a b", *(long_text(0, n) for n in (5, 90, 1000))]
    expected = Counter(int(h) >> 24 for s in {tuple(x.tolist()) for x in shingle_sets(texts)} for h in s)
    found = Counter()
    for block in ngram_join.shingle_blocks(batches(texts), 8):
        assert len(set(block.column(0).to_pylist())) == block.num_rows
        for bucket, low, n in zip(*(c.to_pylist() for c in block.columns), strict=True):
            low = np.frombuffer(low, np.uint32)
            assert (low[1:] > low[:-1]).all()
            found.update({(bucket << 32) + int(x): int(m) for x, m in zip(low, np.frombuffer(n, np.uint16), strict=True)})
    assert found == expected
    assert list(ngram_join.shingle_blocks(batches([None, ""]), 8)) == []


def test_ngram_join_counts_shingles_in_the_others_tail(spark, monkeypatch):
    common = [f"c{i}" for i in range(98)]
    first, last = [f"a{i}" for i in range(16)], [f"b{i}" for i in range(6)]
    texts = [" ".join(first + common), " ".join(common + last)]
    # quotes whose prefix is the seven shingles that both prefixes share: they lead them, and link with nothing
    texts += [" ".join(common[:11] + [f"q{k}x{i}" for i in range(24)]) for k in range(30)]
    words = [(first + common)[i : i + 5] for i in range(110)] + [(common + last)[i : i + 5] for i in range(94, 100)]
    words += [t.split()[i : i + 5] for t in texts[2:] for i in range(7, 31)]
    imposed_order(monkeypatch, [" ".join(w) for w in words])
    group, sets = linked_groups(texts)
    assert [len(s) for s in sets[:3]] == [110, 100, 31] and group[:2] == [0, 0] and group[2:] == list(range(2, 32))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.joined(docs).collect()} == dict(enumerate(group))


def test_ngram_join_in_any_order(spark, monkeypatch):
    r = random.Random(11)
    texts = []
    for k in range(12):
        base = [f"w{k}x{i}" for i in range(r.randint(40, 140))]
        for _ in range(6):
            a, b = sorted((r.randint(0, len(base) // 6), len(base) - r.randint(0, len(base) // 6)))
            texts.append(" ".join([*(f"n{len(texts)}x{i}" for i in range(r.randint(0, 9))), *base[a:b], *(f"m{len(texts)}x{i}" for i in range(r.randint(0, 9)))]))
        texts += [" ".join([*base[: r.randint(5, 15)], *(f"q{len(texts)}x{j}x{i}" for i in range(r.randint(0, 30)))]) for j in range(6)]
    group, sets = linked_groups(texts)
    every = sorted({" ".join(s) for x in sets for s in x})
    r.shuffle(every)
    imposed_order(monkeypatch, every)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.joined(docs).collect()} == dict(enumerate(group))


def wordings_of(pattern):
    """Every text that a rule's pattern matches; of a range of digits the first."""
    from itertools import product
    from re import _parser

    def of(items):
        parts = []
        for op, value in items:
            if op is _parser.LITERAL:
                parts.append([chr(value)])
            elif op is _parser.IN:
                parts.append([chr(v if o is _parser.LITERAL else v[0]) for o, v in value])
            elif op is _parser.BRANCH:
                parts.append([x for b in value[1] for x in of(b)])
            elif op is _parser.SUBPATTERN:
                parts.append(of(value[3]))
            else:
                assert op is _parser.MAX_REPEAT and value[:2] == (0, 1), op
                parts.append(["", *of(value[2])])
        return ["".join(x) for x in product(*parts)]

    return of(_parser.parse(pattern))


SEPARATORS = [chr(c) for c in range(128) if not chr(c).isalnum()]


def test_license_gate_admits_every_wording(spark):
    phrases = [p for _, p in license_scan.BASE]
    for wording in {*phrases, *(t for rule in license_scan.rules() for t in wordings_of(rule.pattern))}:
        assert re.search(license_scan.GATE, wording), wording
    own = ("cc by", "altered source versions must be plainly marked as such")
    cases = [(w, f"x{a}{w.upper().replace(' ', a)}{a}x") for a in SEPARATORS for w in own]
    rows = license_scan.scan(spark.createDataFrame(cases, "wording string, text string")).collect()
    for r in rows:
        expected = (1, 1, "cc-by") if r.wording == "cc by" else (0, None, "zlib")
        assert (r.n_base, r.first_word, r.labels) == expected, repr(r.text)
    texts = [("Photo: _CC BY_ Jane",), ("__cc-by__",), ("CC BY",), ("\n_cc by",)]
    assert {(r.n_base, r.base_labels) for r in license_scan.scan(spark.createDataFrame(texts, "text string")).collect()} == {(1, "cc-by")}


def test_license_rules_fire_on_their_own_wordings(spark):
    cases = []
    for rank, rule in enumerate(license_scan.rules()):
        texts = wordings_of(rule.pattern)
        for text in texts:
            assert rule.keyword in f" {text} ", (rule.name, text)
        cases += [(rank, text) for text in {*texts[:2], *texts[-2:], *texts[:: max(1, len(texts) // 3)]}]
    cases += [(r, t) for r, rule in enumerate(license_scan.rules()) for t in (
        ["licensed under the creative commons attribution 3 0 license"] if rule.name == "licensed_under_cc-by-3.0" else
        ["spdx license identifier gfdl 1 3"] if rule.name == "identifier_gfdl-1.3" else [])]
    rows = license_scan.scan(spark.createDataFrame(cases, "rank int, text string"), with_detections=True).collect()
    assert len(rows) == len(cases)
    for r in rows:
        assert r.rank in {d["rank"] for d in r.detections or ()}, (license_scan.rules()[r.rank].name, r.text)


def test_suffix_dedup_tells_texts_of_one_key_apart(spark):
    from pyspark.sql import functions as F

    texts = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 512).alias("t"))
    low = texts.groupBy(F.xxhash64("t").bitwiseAND(F.lit((1 << 24) - 1))).agg(F.sort_array(F.collect_list("t")).alias("t"))
    one, two = low.where(F.size("t") > 1).orderBy("t").first()["t"][:2]
    # texts without a key precede the others, so both repeats go and only they
    docs = spark.createDataFrame([(None, one), (None, two), (1, one), (2, two + "!")], "doc_id long, text string").coalesce(1)
    rows = suffix_dedup.deduplicated(docs, with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in rows) == sorted([(0, 0, one), (0, 0, two), (1, 128, ""), (2, 128, "!")])


def test_html_names_count_as_whole_names(spark):
    text = "<p>Text {0} of the story"
    shells = [
        "<body class='has-sidebar'><div>{}</div></body>", "<div class='content no-sidebar'>{}</div>", "<article class='post comment-open'>{}</article>",
        "<div id='ad-free-story'>{}</div>", "<article data-title='The hidden cost'>{}</article>", "<main aria-hidden='false'>{}</main>", "<main class='content search'>{}</main>",
        "<div title='class=nav'>{}</div>", "<div class='w-1/2 ad-free' hidden=until-found>{}</div>", "<div data-x=\"id='menu' hidden\">{}</div>",
    ]
    pages = [(10 * k + i, f"http://h{k}.example/{i}", shell.format(text.format(i))) for k, shell in enumerate(shells) for i in range(1)]
    pages += [(900, "http://x.example/1", "<div>a</div><div class='post hidden'>b</div><div hidden>c</div><div role=search>d</div><div id=menu>e</div>")]
    rows = html_template.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    for r in rows:
        assert r.text == ("a" if r.page_id == 900 else f"Text {r.page_id % 10} of the story"), (r.html, r.text)


def test_html_slot_holds_all_that_varies(spark):
    long = "a long paragraph " * 30
    cases = {
        "one": ("<div id=content><h2>Title {0}</h2><p>{1}{0}</p></div>", 1, "Title {0} {1}{0}"),
        "single": ("<div id=content><h2>Title {0}</h2><p>{1}{0}</p></div><div>legal</div>", 4, "Title {0} {1}{0}"),
        "lead": ("<div>legal</div><div class=story><h1>T {0}</h1><div class=lead>Lead {0}</div><div class=body>{1}{0}</div></div>", 4, "T {0} Lead {0} {1}{0}"),
        "two": ("<div><article class=a>First {0}</article><article class=b>{1}{0}</article></div>", 4, "First {0} {1}{0}"),
        "part": ("<div class=site-footer>Us</div><div class=ad-free>Own {0}</div><div class=b>{1}{0}</div>", 4, "Own {0} {1}{0}"),
        "same": ("<div class=a>Head</div><div class=site-notice>All</div>", 3, "Head All"),
        "rare": ("<div class=a>{1}{0}</div><div class=x{0}><p>Note {0}</div>", 4, "{1}{0} Note {0}"),
    }
    pages = [(f"{n}{i}", f"http://{n}.example/{i}", h.format(i, long), " ".join(t.format(i, long).split())) for n, (h, k, t) in cases.items() for i in range(k)]
    pages += [(f"again{i}", "http://again.example/", "<p>Story</p><div class=time>" + str(i) + "</div>", f"Story {i}") for i in range(4)]
    rows = html_template.extracted(spark.createDataFrame(pages, "page_id string, url string, html string, expected string")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == r.expected, r.page_id


def test_keep_one_keeps_rows_not_keys(spark):
    texts = [(1, PAGE), (1, PAGE), (1, " ".join(NEAR)), (1, "one of a kind"), (2, PAGE), (2, "only here"), (2, "Only  HERE"), (3, "only here"), (4, ""), (4, ""), (None, PAGE), (5, "five")]
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(texts)], "doc_id long, text string, i int").repartition(3)
    rows = ngram_join.keep_one(docs).collect()
    found = sorted((r.doc_id or 0, r.text) for r in rows)
    one = next(t for k, t in found if k == 1 and t != "one of a kind")
    assert one in (PAGE, " ".join(NEAR))
    assert found == sorted([(0, PAGE), (1, one), (1, "one of a kind"), (2, "Only  HERE"), (4, ""), (4, ""), (5, "five")])
    assert all(texts[r.i] == (r.doc_id, r.text) for r in rows)
