"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, ctes: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """Registers a query under its function's name; sql: the same rows in DuckDB, after the named views."""

        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = ("WITH RECURSIVE " + ",\n".join(ctes) + ("\n" if _selects(sql) else ",\n") if ctes else "") + sql
            return query

        return register


def _selects(sql: str) -> bool:
    """Whether the text is a statement; else it begins with more views."""
    return sql.lstrip().upper().startswith("SELECT") or sql.lstrip().startswith("(")
