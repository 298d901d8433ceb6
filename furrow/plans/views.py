"""The test tables seen as surveys; SQL of the same views for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of 12 lines and 5 channels."""
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rid"), (F.col("user_id") % 12).cast("string").alias("line"), seconds.alias("t"), F.col("event_type").alias("label"), "value",
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("status"), F.floor(F.col("event_id") / 37).cast("double").alias("mark"),
        F.col("user_id").cast("double").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"),
    )


READINGS = """readings AS (SELECT event_id AS rid, CAST(user_id % 12 AS VARCHAR) AS line, epoch(ts) AS t, event_type AS label, value,
  CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status, CAST(event_id // 37 AS DOUBLE) AS mark, CAST(user_id AS DOUBLE) AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by channel and line with a distance: half hours since 2024-01-01, so that some readings share one."""
    r = readings(spark, sf_dir)
    return r.select("label", "line", "rid", "value", (F.floor((F.col("t") - 1704067200) / 1800) / 2).alias("dist"))


POINTS = READINGS + """, points AS (SELECT label, line, rid, value, floor((t - 1704067200) / 1800) / 2 AS dist FROM readings)"""


def area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings on a field of 100 by 50."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"), (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"),
        F.col("l_extendedprice").alias("v"), F.col("l_linenumber").cast("string").alias("line"), F.year("l_shipdate").alias("year"),
    )


AREA = """area AS (SELECT l_orderkey * 10 + l_linenumber AS rid, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 50 AS DOUBLE) AS y, l_extendedprice AS v,
  CAST(l_linenumber AS VARCHAR) AS line, year(l_shipdate) AS year FROM lineitem)"""

BLOCKS = AREA + """, blocks AS (SELECT CAST(floor(y / 5) AS BIGINT) AS iy, CAST(floor(x / 5) AS BIGINT) AS ix, median(x) AS x, median(y) AS y, median(v) AS v, count(*) AS n FROM area GROUP BY 1, 2)"""
