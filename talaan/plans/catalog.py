"""All core queries and their SQL, by name."""

from __future__ import annotations

from talaan.plans import connectors, leads, matching, pipeline, runs, spatial, store

MODULES = [runs, leads, matching, store, connectors, pipeline, spatial]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in MODULES for name, q in getattr(m, "SQL", {}).items()}
