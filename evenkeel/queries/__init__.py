"""Registered queries: each operator on the given tables, with check SQL where it can be written."""

from __future__ import annotations

import importlib

MODULES = (
    "q_sources", "q_joins", "q_policies", "q_policy_tables", "q_builds", "q_hierarchy", "q_scalar", "q_derived", "q_models",
    "q_metrics", "q_lab",
)


def all_queries():
    """(queries, check SQL) of every module."""
    from evenkeel.queries import registry

    for name in MODULES:
        importlib.import_module(f"evenkeel.queries.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
