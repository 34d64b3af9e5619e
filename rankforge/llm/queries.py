"""The registered queries of this subpackage and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_license_scan": "licenses",
    "op2_language_id": "langid",
    "op3_token_codes": "dac",
    "op4_minhash_near_dedup": "neardup",
    "op5_best_fit_packing": "packing",
    "op6_exact_topk_search": "knn",
    "op7_secret_scan": "secrets",
    "op8_sharding": "sharding",
    "op9_quality_rules": "quality",
    "op10_source_mixing": "mixing",
}


def queries() -> dict:
    return {name: import_module(f"rankforge.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"rankforge.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
