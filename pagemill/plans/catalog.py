"""All queries of the engine's own operators, with their DuckDB oracles.

A query takes (spark, folder) and returns a DataFrame; its SQL, if it has one, gives
the same rows from views named like the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered already")
            self.queries[name] = query
            if sql:
                self.oracles[name] = sql
            return query

        return put


def load() -> Catalog:
    from pagemill.plans import layout_queries, text_queries, translation_queries

    out = Catalog()
    for module in (layout_queries, text_queries, translation_queries):
        module.register(out)
    return out


_ALL = load()
QUERIES, ORACLES = _ALL.queries, _ALL.oracles
