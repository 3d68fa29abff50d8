"""Sorted runs from a stream, merged on demand.

A stream has no total order until it ends. So each micro-batch becomes a run,
sorted and written once under its batch number, and reading merges the runs
there are. A batch that is repeated after a failure overwrites its own run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merging import kway_merge


def write_runs(stream: DataFrame, path: str, checkpoint: str, *keys: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that writes each micro-batch to ``path/run_id=N``, ordered by ``keys``."""

    def run(batch: DataFrame, number: int) -> None:
        batch.orderBy(*keys).write.mode("overwrite").parquet(f"{path}/run_id={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn("run_id", F.col("run_id").cast("long"))


def merged(spark: SparkSession, path: str, key: str, *ties: str) -> DataFrame:
    """All runs so far in one order, with positions."""
    return kway_merge(read_runs(spark, path), key, "run_id", *ties)
