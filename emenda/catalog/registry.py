"""The register, and literals that Spark and DuckDB read alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lit(v) -> str:
    """A literal of DuckDB."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(lit, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


class Fixture:
    """A small table, as a DataFrame and as a subquery."""

    def __init__(self, schema: str, rows: Sequence[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def sql(self) -> str:
        body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(self.names)}))"


def strip_sql(x: str) -> str:
    return f"lower(translate({x}, {lit(T.ACCENTED)}, {lit(T.BASES)}))"


def key_sql(x: str) -> str:
    return f"trim(regexp_replace({strip_sql(x)}, '\\s+', ' ', 'g'))"


VI_SQL = lit(T.VIETNAMESE)
