"""Query catalogue: one module per operator group."""

from __future__ import annotations

import importlib

GROUPS = ("sources", "search", "text", "web", "geo", "stats", "graph", "registers", "vectors", "streams")


def load():
    """Import every group and return (queries, check SQL)."""
    from gleaner.catalog import registry

    for group in GROUPS:
        importlib.import_module(f"gleaner.catalog.{group}")
    return registry.QUERIES, registry.ORACLES
