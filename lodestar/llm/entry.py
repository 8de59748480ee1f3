"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lodestar.llm import alignment, byte_bpe, exact_dedup, hard_negatives, language_id, license_scan, matroska, near_dedup, packing, quality, secret_scan, simhash, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_matroska": matroska.op6_matroska,
    "op7_language_id": language_id.op7_language_id,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_simhash": simhash.op11_simhash,
    "op12_alignment": alignment.op12_alignment,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
