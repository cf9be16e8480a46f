"""Registered queries of the training-data operators, one per operator, and their oracles where SQL can express them."""

from __future__ import annotations

from arbiter.llm import decontaminate, jaccard_join, line_crf, mixing, pii, quality_rules, quote_threads, suffix_dedup, token_align, token_count, topk_search, url_filter, whitening

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_token_counts": token_count.op4_token_counts,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_line_crf": line_crf.op7_line_crf,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quote_threads": quote_threads.op9_quote_threads,
    "op10_pii": pii.op10_pii,
    "op11_token_align": token_align.op11_token_align,
    "op12_whiten": whitening.op12_whiten,
    "op13_topk_search": topk_search.op13_topk_search,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op9_quote_threads": quote_threads.ORACLE,
}
