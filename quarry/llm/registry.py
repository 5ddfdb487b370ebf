"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

NAMES = {
    "op1_template_free_text": "html_text",
    "op2_wavelet_tokens": "token_ids",
    "op3_secret_spans": "secrets",
    "op4_balanced_shards": "sharding",
    "op5_minhash_near_dup": "near_dup",
    "op6_string_tiling": "decontaminate",
    "op7_quality_lines": "quality",
    "op8_token_counts": "token_fst",
    "op9_warc_derivatives": "warc",
    "op10_mix_sources": "mixing",
    "op11_token_alignment": "alignment",
    "op12_bounded_packing": "packing",
    "op13_spelling_variants": "spelling",
}


def queries() -> dict:
    found = {}
    for name, module in NAMES.items():
        found[name] = getattr(importlib.import_module(f"quarry.llm.{module}"), name)
    return found


def oracle_sql() -> dict:
    return {}
