"""The corpus operators' queries, and SQL where SQL can express them."""

from __future__ import annotations

from widegrain.llm import (
    embedding_dedup,
    language_id,
    line_dedup,
    packing,
    pii,
    quality_lm,
    quality_rules,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
)

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_language_id": language_id.query,
    "op3_sentencepiece": sentencepiece_codec.query,
    "op4_line_dedup": line_dedup.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_packing": packing.query,
    "op7_quality_lm": quality_lm.query,
    "op8_pii_surrogates": pii.query,
    "op9_quality_rules": quality_rules.query,
    "op10_simhash_dedup": simhash_dedup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op5_substring_dedup": substring_dedup.ORACLE_SQL,
}
