"""The registered queries and, where SQL can state them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def golden(columns: str, rows: list[tuple]) -> str:
    """SQL for rows of values worked out by hand."""
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    values = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) AS t({columns})"
