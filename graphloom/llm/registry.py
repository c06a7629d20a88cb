"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ann, chat, decontaminate, fst, language, license, lines, neardup, packing, suffix

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_license_scan": license.op3_license_scan,
    "op4_nearest_neighbours": ann.op4_nearest_neighbours,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_chat_format": chat.op7_chat_format,
    "op8_token_counts": fst.op8_token_counts,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_language_id": language.op10_language_id,
}
ORACLES = {"op3_license_scan": license.ORACLE}
