"""Readings that arrive as files, prepared as they come. The reference has no streams: this is an addition, with the same operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def follow(spark: SparkSession, folder: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls handle(batch, number) for the new files of a folder, each file once, also after a restart."""
    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
