"""Queries of the operators and the pipeline, and their SQL where SQL can express them."""
from __future__ import annotations

import corpus_pipeline
from foliospark.llm import filter_audit, hamming, html, licenses, line_dedup, mixing, packing, quality, sharding, simhash, token_counts, toxicity, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": toxicity.op1,
    "op2_source_mixing": mixing.op2,
    "op3_token_counts": token_counts.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_exact_top_k": hamming.op5,
    "op6_html_extraction": html.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_license_scans": licenses.op8,
    "op9_quality_rules": quality.op9,
    "op10_best_fit_packing": packing.op10,
    "op11_sharding": sharding.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_whitening": whitening.op13,
}

ORACLES = {
    "op2_source_mixing": mixing.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_exact_top_k": hamming.SQL,
    "op9_quality_rules": quality.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
