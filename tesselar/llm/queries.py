"""The registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import centroids, decontamination, hard_negatives, html_text, language_id, line_dedup, ngram_join, packing, quality_rules, substring_dedup, toxicity, url_filters, warc

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_url_filters": url_filters.query,
    "op3_packing": packing.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_quality_rules": quality_rules.query,
    "op6_toxicity": toxicity.query,
    "op7_html_extraction": html_text.query,
    "op8_ngram_join": ngram_join.query,
    "op9_language_id": language_id.query,
    "op10_line_dedup": line_dedup.query,
    "op11_warc": warc.query,
    "op12_centroids": centroids.query,
    "op13_hard_negatives": hard_negatives.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_url_filters": url_filters.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_warc": warc.SQL,
    "op12_centroids": centroids.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
