"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from basinflow.llm import chat, exact_dedup, fingerprints, hard_negatives, html_text, licenses, line_dedup, merkle, mixing, packing, quality, simhash, suffix_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_packing": packing.op6_packing,
    "op7_chat_perspectives": chat.op7_chat_perspectives,
    "op8_simhash_dedup": simhash.op8_simhash_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_html_text": html_text.op10_html_text,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_license_scan": licenses.op13_license_scan,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op7_chat_perspectives": chat.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
