"""Registered queries: each module here has QUERIES (name -> callable) and SQL (name -> text for the cross-check)."""

from __future__ import annotations

import importlib
import pkgutil


def registered() -> tuple[dict, dict]:
    """Queries and SQL of every plan module."""
    queries: dict = {}
    sql: dict = {}
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        module = importlib.import_module(f"{__name__}.{info.name}")
        queries |= getattr(module, "QUERIES", {})
        sql |= getattr(module, "SQL", {})
    return queries, sql
