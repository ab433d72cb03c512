"""Queries of the llm operators and their SQL counterparts."""

from __future__ import annotations

from ferrule.llm import bpe, embedding_dedup, jaccard_join, language_id, line_dedup, mixing, pii, quality_rules, substring_dedup, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_pii": pii.op4_pii,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_warc": warc.op9_warc,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}
ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op4_pii": pii.ORACLE_SQL,
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_mix_sources": mixing.ORACLE_SQL,
    "op7_substring_dedup": substring_dedup.ORACLE_SQL,
}
