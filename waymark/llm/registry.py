"""The queries of this subpackage and, where SQL can express them, the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from . import decontamination, html_extraction, line_dedup, mixing, ngram_join, oracles, quality_rules, secret_scan, toxicity, url_filters, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_mixing": mixing.op3_mixing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_html_extraction": html_extraction.op5_html_extraction,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
SQL: dict[str, str] = {
    "op1_warc": oracles.OP1,
    "op6_url_filters": oracles.OP6,
    "op9_quality_rules": oracles.op9(quality_rules.RULES, quality_rules.STOP_WORDS, quality_rules.BASE_WORDS, quality_rules.BASE_REPEAT_PERCENT),
    "op10_ngram_join": oracles.OP10,
}
