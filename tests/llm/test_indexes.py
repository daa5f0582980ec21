"""Manifest, ranked search and digest index on awkward rows, against plain Python."""

import hashlib
import math
import random
import re
import uuid
import zlib

import numpy as np
import pytest

from strikebook.llm import digest_index, merkle_manifest, ranked_search
from strikebook.llm.shared import scratch
from tests.llm.test_operators import LONG, PAGE, VOCABULARY, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Digest index

COPIES = [
    (5, "a  b\tc"), (3, "a b c"), (9, " a b c"), (4, None), (7, ""), (8, "\n"), (2, " "), (1, LONG), (6, LONG.replace(" ", "\r\n")),
    (3, "a b c"), (None, "a b c"), (None, "only here"), (None, "only here"), (10, "a b c"),
]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def copies(spark, rows):
    return spark.createDataFrame([(k, t, "x", i, b"y", 0) for i, (k, t) in enumerate(rows)], "doc_id long, text string, digest string, tag int, keep binary, _row int").repartition(3)


def index_of(spark, **options):
    return digest_index.DigestIndex(spark, scratch(spark, f"index-{uuid.uuid4().hex}"), **options)


@pytest.mark.parametrize("share", [digest_index.HOT_SHARE, 2])
def test_groups_of_copies(spark, monkeypatch, share):
    # with a share of two, only texts of over half of the rows are hot
    monkeypatch.setattr(digest_index, "HOT_SHARE", share)
    rows = COPIES + [(20 + i, "hot  text") for i in range(40)]
    index = index_of(spark, buckets=3)
    thin = digest_index.digests(copies(spark, rows), "doc_id", "text")
    index.append(thin)
    index.append(thin)
    got = digest_index.decided(thin, index).collect()
    assert len(got) == len(rows) and index.rows().count() == len({normal(t) for _, t in rows})
    groups = {}
    for k, t in rows:
        groups.setdefault(hashlib.sha256(normal(t).encode()).digest(), []).append(k)
    for r in got:
        keys = [k for k in groups[bytes(r.digest)] if k is not None]
        assert r.keep == min(keys, default=None) and r.n == len(groups[bytes(r.digest)])
    kept = [bytes(r.digest) for r in got if r.kept]
    assert sorted(kept) == sorted(groups) and all(r.key == r.keep for r in got if r.kept)


def test_index_outlives_its_batches(spark):
    folder = scratch(spark, f"index-{uuid.uuid4().hex}")
    index = digest_index.DigestIndex(spark, folder, buckets=2)
    first = digest_index.survivors(copies(spark, COPIES), index)
    assert first.columns == ["doc_id", "text", "digest", "tag", "keep", "_row"]
    # a key and text twice, in rows that differ elsewhere, is one survivor
    assert sorted((str(r.doc_id), normal(r.text)) for r in first.collect()) == sorted([("2", " "), ("3", "a b c"), ("4", ""), ("9", " a b c"), ("1", normal(LONG)), ("None", "only here"), ("10", "a b c")])
    spark.sql(f"DROP TABLE {index.name}")
    again = digest_index.DigestIndex(spark, folder, buckets=2)
    later = copies(spark, [(0, "a b c"), (11, "new"), (12, "new "), (13, "new")])
    assert sorted((r.doc_id, r.text) for r in digest_index.survivors(later, again).collect()) == [(11, "new"), (12, "new ")]
    assert again.rows().count() == 9
    assert digest_index.survivors(later.where("false"), again).collect() == []
    plan = again.unknown(digest_index.digests(later, "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


# Ranked search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected_ranks(docs, items, k):
    found = [(key, terms(t)) for key, t in docs]
    n, total = sum(1 for _, w in found if w), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for key, w in found:
            if not w:
                continue
            m = 50 + (50 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in set(terms(text)) if t in df)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank + 1, key, -s) for rank, (s, _, _, key) in enumerate(sorted(scored)[:k])]
    return out


def test_ranked_search(spark):
    docs = [(i, prose(30 + i % 50, i)) for i in range(120)] + [(200, PAGE), (201, PAGE), (None, PAGE), (202, None), (203, ""), (204, "-- !"), (205, LONG), (206, "É é ẞ x2 X2 x_2"), (201, PAGE)]
    base = prose(25, 7)
    items = [(1, base), (2, base + " " + prose(9, 8)), (3, prose(9, 8) + " É x2"), (4, None), (5, "... "), (6, "nowhere zzzzqq"), (None, base.upper()), (1, PAGE), (7, LONG[:9000])]
    d = spark.createDataFrame([(k, t, 1, "z") for k, t in docs], "doc_id long, text string, item int, score string").repartition(4)
    b = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id long, text string, rank int")
    want = sorted(expected_ranks(docs, items, 5), key=str)
    for options in ({}, {"block_terms": 30}):
        got = ranked_search.ranked(d, b, k=5, **options).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert ranked_search.ranked(d, b.where("false")).collect() == []
    assert ranked_search.ranked(d.where("false"), b).collect() == []


def test_shared_sets_give_plain_sums():
    draw = random.Random(4)
    for _ in range(20):
        common = [set(draw.sample(VOCABULARY, 6)) for _ in range(4)]
        items = [{w.encode() for w in set().union(*draw.sample(common, draw.randint(1, 3)), draw.sample(VOCABULARY, 3))} for _ in range(draw.randint(1, 12))]
        plan = ranked_search.Plan(items)
        assert all(len(set(x.tolist())) == len(x) for x in plan.items)
        value = np.array([draw.randint(1, 10**6) for _ in plan.hashes], np.int64)
        cells = np.zeros((plan.n_nodes, 1), np.int64)
        np.add.at(cells[:, 0], plan.set_of, value)
        place = {h: i for i, h in enumerate(plan.hashes.tolist())}
        for item, scores in zip(items, plan.scores(cells), strict=True):
            hashes = ranked_search.word_hashes(b" ".join(sorted(item)))[1].tolist()
            assert scores[0] == sum(value[place[h]] for h in hashes)


# Manifest

def tree_of(digests):
    """Levels of a tree, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        run = at // 8 * 8
        path.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return path


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def expected_manifest(rows):
    trees = {}
    for i, row in enumerate(rows):
        trees.setdefault(row[2], []).append((row[0] is None, row[0] or 0, leaf(row, row[4]), i))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {name: tree_of([x[2] for x in sorted(trees[name])]) for name in names}
    top = tree_of([levels[name][-1][0] for name in names])
    out = []
    for j, name in enumerate(names):
        for at, (none, key, digest, i) in enumerate(sorted(trees[name])):
            path = path_of(levels[name], at) + path_of(top, j)
            hit = not none and zlib.crc32(str(key).encode()) % 3 == 0
            folded = leaf(rows[i], rows[i][4].translate(LOWER)) if hit and rows[i][4] is not None else digest
            for left, right in path:
                folded = sha(left + folded + right)
            root = top[-1][0]
            out.append((None if none else key, digest, levels[name][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def manifest_rows(n, seed=1):
    draw = random.Random(seed)
    langs = ["en", "fr", None, "", "é", "Z"]
    rows = [(i * draw.choice([1, 3]) + (1 << 20) * draw.choice([0, 0, 5]), draw.choice(["web", None]), "en" if i % 2 else draw.choice(langs), i, prose(3, i).title()) for i in range(n)]
    return rows


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, tree string, place int, leaf int"


def manifest(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], MANIFEST).repartition(3)
    got = merkle_manifest.manifest(df, with_path=True).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert all(sha("".join(r.path)) == r.proof_sha256 for r in got)
    return sorted((tuple(r[c] for c in names) for r in got), key=str)


@pytest.mark.parametrize("n", [1, 9, 700])
def test_manifest(spark, n):
    rows = manifest_rows(n)
    if n == 9:
        rows += [(None, None, None, None, None), (None, "a", "en", 1, "Null Key"), (None, "a", "en", 1, "Null Key"), (3, "a", "en", 1, LONG), (3, "a", "en", 1, LONG), (3, "b", "en", 1, ""), (-70000, "b", "en", None, "Below")]
    assert manifest(spark, rows) == sorted(expected_manifest(rows), key=str)


def test_manifest_of_nothing(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], MANIFEST)).collect() == []


def test_containers_and_ranks():
    draw = np.random.default_rng(2)
    for size in (0, 1, merkle_manifest.SPARSE, merkle_manifest.SPARSE + 1, 30_000, merkle_manifest.CONTAINER):
        offsets = np.sort(draw.choice(merkle_manifest.CONTAINER, size, replace=False))
        dense, data = merkle_manifest.packed(offsets)
        assert merkle_manifest.unpacked(dense, data).tolist() == offsets.tolist() and len(data) <= 8192
        more = offsets[:3]
        ranks = merkle_manifest.Ranks({"before": 5, "dense": dense, "bits": data, "again": more.astype(np.uint16).tobytes(), "more": np.full(len(more), 2).tobytes()})
        at = draw.integers(0, merkle_manifest.CONTAINER, 50)
        assert ranks.of((9 << 16) + at).tolist() == [5 + int((offsets < x).sum()) + 2 * int((more < x).sum()) for x in at]
