"""The registered queries of the operators and of the pipeline, each with its comparison SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
from strikebook.llm import (
    best_fit,
    decontaminate,
    digest_index,
    html_template,
    license_scan,
    merkle_manifest,
    ngram_join,
    packed_matrices,
    quality_rules,
    ranked_search,
    suffix_dedup,
    token_counts,
    warc,
)

QUERIES = {
    "op1_license_scan": (license_scan.query, license_scan.sql()),
    "op2_best_fit_packing": (best_fit.query, None),
    "op3_token_counts": (token_counts.query, None),
    "op4_decontaminate": (decontaminate.query, decontaminate.SQL),
    "op5_warc": (warc.query, warc.SQL),
    "op6_html_template": (html_template.query, None),
    "op7_quality_rules": (quality_rules.query, quality_rules.sql()),
    "op8_suffix_dedup": (suffix_dedup.query, suffix_dedup.SQL),
    "op9_ngram_join": (ngram_join.query, ngram_join.SQL),
    "op10_packed_matrices": (packed_matrices.query, None),
    "op11_merkle_manifest": (merkle_manifest.query, merkle_manifest.sql()),
    "op12_ranked_search": (ranked_search.query, ranked_search.SQL),
    "op13_digest_index": (digest_index.query, digest_index.SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
