"""Where queries and their DuckDB twins are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Lists a function of (spark, sf_dir) under a name, with SQL that returns the same rows where there is some."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c, alias: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(alias) if alias else F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else df[c] for c in df.columns])
