"""The registered queries and their SQL, by subject."""

from . import engine, series

MODULES = [engine, series]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
