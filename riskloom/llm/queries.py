"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

import importlib

#: Module and function of each query, in the order of the operators.
_QUERIES = (
    ("op1_bpe", "op1_bpe"),
    ("op2_language", "op2_language"),
    ("op2_language", "language_of_pages"),
    ("op3_bitplanes", "op3_bitplanes"),
    ("op4_packing", "op4_packing"),
    ("op5_tiff", "op5_tiff"),
    ("op6_line_dedup", "op6_line_dedup"),
    ("op7_quality", "op7_quality"),
    ("op8_ngram_join", "op8_ngram_join"),
    ("op9_url_filter", "op9_url_filter"),
    ("op10_sharding", "op10_sharding"),
    ("op11_whitening", "op11_whitening"),
    ("op12_mixing", "op12_mixing"),
    ("op13_search", "op13_search"),
)


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"riskloom.llm.{module}"), name) for module, name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in _QUERIES:
        if sql := getattr(importlib.import_module(f"riskloom.llm.{module}"), "ORACLE_SQL", None):
            found[name] = sql
    return found
