"""Registry of the library's own queries and their DuckDB texts."""

from __future__ import annotations

from . import io_plans, ml_plans, scalar_plans, signal_plans, table_plans

MODULES = (scalar_plans, table_plans, io_plans, signal_plans, ml_plans)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.CATALOGUE.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.CATALOGUE.oracle.items()}
