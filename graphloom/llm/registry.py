"""The queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Name of the query, and the module that has its query() and SQL.
MODULES = {
    "op1_language_id": "language_id",
    "op2_line_dedup": "line_dedup",
    "op3_warc_derivatives": "warc",
    "op4_minhash_near_dedup": "near_dedup",
    "op5_best_fit_packing": "packing",
    "op6_quality": "quality_classifier",
    "op7_sentencepiece": "sentencepiece_codec",
    "op8_exact_dedup": "exact_dedup",
    "op9_quality_rules": "quality_rules",
    "op10_substring_dedup": "substring_dedup",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {n: _module(n).query for n in MODULES}


def oracle_sql() -> dict[str, str]:
    return {n: _module(n).SQL for n in MODULES if getattr(_module(n), "SQL", None)}
