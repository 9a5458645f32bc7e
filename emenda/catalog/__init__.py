"""Registry of the queries that exercise the library's operators, with their SQL.

A query is registered under the name of its operator.  Its SQL is for DuckDB over the same Parquet
tables; a query without SQL is one that SQL can't express sensibly, and is tested otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .registry import QUERIES, SQL
from . import building, correction, details, functions, lexicons, tokens  # noqa: F401  (they register their queries)

FLAGSHIP = "restore_accents"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
