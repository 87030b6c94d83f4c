"""Registered queries by theme."""

from __future__ import annotations

import importlib

from vectile.plans.registry import ORACLES, QUERIES

MODULES = (
    "table_queries",
    "sampling_queries",
    "source_queries",
    "vector_queries",
    "score_queries",
    "set_queries",
    "run_queries",
    "text_run_queries",
)


def all_queries():
    """(queries, SQL counterparts) after loading every theme."""
    for m in MODULES:
        importlib.import_module(f"vectile.plans.{m}")
    return dict(QUERIES), dict(ORACLES)
