"""Registered queries over the driver tables and their DuckDB counterparts."""

from __future__ import annotations

import importlib

MODULES = (
    "text_queries", "audit_queries", "table_queries", "html_queries", "edit_queries",
)


def load():
    """All queries and SQL texts, by name."""
    from tracebound.workload import registry

    for module in MODULES:
        importlib.import_module(f"tracebound.workload.{module}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
