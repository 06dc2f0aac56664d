"""Queries over the test tables, each with an equivalent SQL statement where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("base", "formula", "technical", "sources", "panels", "evaluation", "portfolios", "operations", "extras")


def load():
    """All registered queries by name."""
    from quantloom.catalog.registry import REGISTRY

    for name in MODULES:
        importlib.import_module(f"quantloom.catalog.{name}")
    return REGISTRY
