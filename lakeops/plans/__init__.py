"""Registered queries over the driver tables and their DuckDB oracles."""

from __future__ import annotations


def all_queries():
    from lakeops.plans import queries  # noqa: F401  (registers on import)
    from lakeops.plans.registry import QUERIES
    return dict(QUERIES)


def all_oracles():
    from lakeops.plans import queries  # noqa: F401
    from lakeops.plans.registry import ORACLES
    return dict(ORACLES)
