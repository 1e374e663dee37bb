"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from shelfline.llm import decontaminate, fill_middle, html_text, language, line_dedup, near_dedup, pieces, quality, resample, secrets, topk, url_filter, warc

QUERIES = {
    "op1_html_extraction": html_text.query,
    "op2_line_dedup": line_dedup.query,
    "op3_language_id": language.query,
    "op4_warc": warc.query,
    "op5_decontamination": decontaminate.query,
    "op6_sentencepiece": pieces.query,
    "op7_url_filters": url_filter.query,
    "op8_secret_scans": secrets.query,
    "op9_exact_topk": topk.query,
    "op10_simhash_near_dedup": near_dedup.query,
    "op11_quality_classifier": quality.query,
    "op12_importance_resampling": resample.query,
    "op13_fill_in_middle": fill_middle.query,
}

CHECKS: dict[str, str] = {
    "op4_warc": warc.CHECK,
    "op7_url_filters": url_filter.CHECK,
    "op9_exact_topk": topk.CHECK,
    "op12_importance_resampling": resample.CHECK,
    "op13_fill_in_middle": fill_middle.CHECK,
}
