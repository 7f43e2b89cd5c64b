"""Queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from . import chat_format, embedding_dedup, exact_dedup, jaccard_join, lexical_search, mixing, packing, quality, quality_rules, secret_scan, substring_dedup, suffix_dedup, whitening

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_secret_scan": secret_scan.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_quality": quality.query,
    "op5_chat_format": chat_format.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_packing": packing.query,
    "op8_embedding_dedup": embedding_dedup.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_lexical_search": lexical_search.query,
    "op12_quality_rules": quality_rules.query,
    "op13_whitening": whitening.query,
}
ORACLES = {"op1_mixing": mixing.SQL, "op5_chat_format": chat_format.SQL, "op6_exact_dedup": exact_dedup.SQL}
