"""Name -> query and name -> equivalent SQL, gathered from the modules of this package."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _gather() -> None:
    from grainflow.plans import comparisons, descriptions, distributions, frames, population, populations, sequences, shapes, tables

    for module in (population, sequences, distributions, frames, populations, comparisons, descriptions, shapes, tables):
        QUERIES.update(module.QUERIES)
        ORACLE_SQL.update(module.ORACLE_SQL)


_gather()
