"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ctw, decontaminate, html_text, langid, piece_bpe, quality_ftrl, quality_rules, sharding, simhash, token_count

QUERIES = {
    "op1_lm_scoring": ctw.op1,
    "op2_simhash": simhash.op2,
    "op3_sentencepiece": piece_bpe.op3,
    "op4_quality_classifier": quality_ftrl.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_decontamination": decontaminate.op6,
    "op7_sharding": sharding.op7,
    "op8_html_text": html_text.op8,
    "op9_token_counts": token_count.op9,
    "op10_language_id": langid.op10,
}

ORACLE_SQL: dict[str, str] = {}
