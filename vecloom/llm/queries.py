"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from vecloom.llm import chat, html, jaccard, lines, mixing, packing, quality, suffix, topk, urls

QUERIES = {
    "op1_line_dedup": lines.query,
    "op2_html_extraction": html.query,
    "op3_packing": packing.query,
    "op4_chat_formatting": chat.query,
    "op5_ngram_jaccard_join": jaccard.query,
    "op6_quality_rules": quality.query,
    "op7_mixing": mixing.query,
    "op8_url_filters": urls.query,
    "op9_suffix_dedup": suffix.query,
    "op10_exact_topk": topk.query,
}

ORACLES = {
    "op1_line_dedup": lines.ORACLE,
    "op5_ngram_jaccard_join": jaccard.ORACLE,
    "op8_url_filters": urls.ORACLE,
    "op10_exact_topk": topk.ORACLE,
}
