"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from undertow.llm import bpe, chat_format, exact_dedup, html_extract, mixing, near_dedup, quality_rules, sharding, token_counts, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_sharding": sharding.op4_sharding,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op2_chat_format": chat_format.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
