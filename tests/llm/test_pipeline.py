"""The pipeline against plain Python on a small corpus."""

import hashlib
import os
import re

import pytest

import corpus_pipeline
from strikebook.llm import queries
from strikebook.llm.shared import table, written
from tests.check import ROOT, connect
from tests.llm.test_operators import ids_of, words_of

SF = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    con = connect(SF)
    for (name, stage), query, keep in zip(
        corpus_pipeline.STAGES[:-1],
        ("op7_quality_rules", "op9_ngram_join", "op8_suffix_dedup", "op4_decontaminate"),
        ("kept", "doc_id = component_id", "true", "not contaminated"),
        strict=True,
    ):
        con.execute("DROP VIEW IF EXISTS documents")
        con.register("documents", docs.toArrow())
        verdict = con.execute(f"SELECT * FROM ({queries.QUERIES[query][1]}) WHERE {keep} ORDER BY doc_id").fetchdf()
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert sorted(after) == verdict.doc_id.tolist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if query != "op8_suffix_dedup":
            assert all(after[k] == before[k] for k in after)
        else:
            for r in verdict.itertuples():
                text = after[r.doc_id].text
                if r.n_removed == 0 or "�" not in text and hashlib.sha256(text.encode()).hexdigest() == r.kept_sha256:
                    continue
                # a character was cut apart: its bytes go too
                assert len(text.encode()) < r.n_bytes - r.n_removed
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {k: len(ids_of("word_bpe_49k.json", d.text, [1])) for k, d in after.items()}
    assert all(re.fullmatch(r"[^ ]+", w) for d in after.values() for w in words_of(d.text)[:5])
