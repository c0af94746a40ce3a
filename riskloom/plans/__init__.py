"""Registered queries: each applies operators of this library to the given tables."""

from __future__ import annotations

import importlib

_FAMILIES = ("audits", "columns", "relations", "summaries", "cohorts", "evaluation", "policies")


def _load() -> None:
    for family in _FAMILIES:
        importlib.import_module(f"riskloom.plans.{family}")


def queries() -> dict:
    from riskloom.plans.base import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from riskloom.plans.base import ORACLES

    _load()
    return dict(ORACLES)
