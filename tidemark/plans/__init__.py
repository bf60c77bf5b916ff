"""Queries over sample tables, and the research pipeline as a whole."""

from __future__ import annotations


def all_queries() -> dict:
    from tidemark.plans import catalog, catalog_discovery, catalog_families, catalog_tests  # noqa: F401  the others add to the first

    return catalog.QUERIES


def all_sql() -> dict[str, str]:
    from tidemark.plans import catalog, catalog_discovery, catalog_families, catalog_tests  # noqa: F401  the others add to the first

    return catalog.SQL
