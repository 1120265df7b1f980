"""Registered queries by group."""

from __future__ import annotations

import importlib

GROUPS = ("feature_queries", "research_queries", "relational_queries", "coverage_queries", "model_queries", "boost_queries", "interaction_queries", "component_queries", "module_queries")


def load() -> None:
    """Import every group, which registers its queries."""
    for group in GROUPS:
        importlib.import_module(f"{__name__}.{group}")
