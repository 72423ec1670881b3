"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quiverine.llm import bpe, gif, langid, packing, pii, simhash, substring, topk, toxicity, url_filter

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_packing": packing.op2_packing,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_gif": gif.op6_gif,
    "op7_url_filters": url_filter.op7_url_filters,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_simhash": simhash.op10_simhash,
}

ORACLES = {
    "op7_url_filters": url_filter.ORACLE,
    "op8_exact_topk": topk.ORACLE,
    "op9_substring_dedup": substring.ORACLE,
}
