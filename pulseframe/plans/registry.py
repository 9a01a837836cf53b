"""The table of queries, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bridge import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, shared: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its name; shared: the SQL follows the shared inputs after WITH."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if shared:
                text = f"WITH {SQL}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {SQL} {text}"
            ORACLE_SQL[f.__name__] = text
        return f

    return put
