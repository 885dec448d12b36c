"""All registered core queries and their oracle SQL."""

from __future__ import annotations

from lorekiln.plans import graphs, notes, problems, quality, retrieval

MODULES = (retrieval, graphs, notes, quality, problems)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
