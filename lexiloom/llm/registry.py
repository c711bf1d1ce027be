"""Queries of the training-data operators and their SQL twins, by name."""

from __future__ import annotations

from lexiloom.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixing, nearest, page_text, paragraph_dedup, phrases, quote_links, ranked_search, secret_scan, suffix_dedup

QUERIES = {
    "op1_quote_links": quote_links.op1_quote_links,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_html_text": page_text.op4_html_text,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_paragraph_dedup": paragraph_dedup.op6_paragraph_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_phrases": phrases.op12_phrases,
    "op13_nearest": nearest.op13_nearest,
}

ORACLES = {
    "op1_quote_links": quote_links.OP1_SQL,
    "op2_jaccard_join": jaccard_join.OP2_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
