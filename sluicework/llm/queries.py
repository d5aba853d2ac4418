"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

import importlib

#: query name: module that has it, with ORACLE where SQL can express it.
MODULES = {
    "op1_url_filter": "url_filter",
    "op2_packing": "packing",
    "op3_decontamination": "decontamination",
    "op4_toxicity": "toxicity",
    "op5_substring_dedup": "substring_dedup",
    "op6_quality_rules": "quality_rules",
    "op7_ngram_join": "ngram_join",
    "op8_prefix_tokens": "prefix_tokens",
    "op9_language_id": "language_id",
    "op10_sharding": "sharding",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE", None))}
