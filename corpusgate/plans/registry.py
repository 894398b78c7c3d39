"""All registered queries and their oracle SQL, gathered from the plan modules."""
from __future__ import annotations

import importlib

PLAN_MODULES = ("corpus", "manifests", "datacheck", "changes", "export", "streams")


def _modules():
    return [importlib.import_module(f"corpusgate.plans.{m}") for m in PLAN_MODULES]


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
