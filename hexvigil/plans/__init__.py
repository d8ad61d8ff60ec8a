"""Runnable queries: every operator applied to the supplied tables."""

from __future__ import annotations

import importlib

_MODULES = [
    "scores", "techniques", "activity", "indicators", "trust", "text", "intake", "privacy", "graph", "digest", "sources", "streams",
]


def _load():
    for name in _MODULES:
        importlib.import_module(f"hexvigil.plans.{name}")
    from hexvigil.plans import registry

    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
