"""Total sort, distributed positions and neighbours, top-k."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = str | Column
#: ``monotonically_increasing_id`` has the partition above these bits, the row within it in them.
ROW_BITS = 33


def total_sort(df: DataFrame, *keys: Key) -> DataFrame:
    """Globally ordered rows: one range exchange, one sort. Later keys break ties."""
    return df.orderBy(*keys)


def ranged(df: DataFrame, *keys: Key, name: str = "_range") -> DataFrame:
    """Rows in key ranges of about equal size, numbered by ``name``.

    A range's bounds come from a sample; several reads of the result must see
    the same ranges, so it is kept (in memory, else on disk) once made.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).withColumn(name, F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)


def with_position(df: DataFrame, *keys: Key, name: str = "position") -> DataFrame:
    """Number rows from 1 in the order of ``keys``, without one task that sees all rows.

    The keys must order the rows totally: then the sampled bounds of the ranges
    do not matter. Rows move and are sorted once, by the total sort; a row's
    place in its range is shifted by the sizes of the ranges before it. The
    sorted rows are kept (in memory, else on disk), as they are read twice.
    """
    rows = total_sort(df, *keys).withColumn("_row", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    rows = rows.withColumn("_range", F.shiftright("_row", ROW_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = F.broadcast(sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))  # one row a range
    place = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + F.col("_offset") + 1
    return rows.join(offsets, "_range").withColumn(name, place).drop("_range", "_offset", "_row")


def with_previous(df: DataFrame, value: str, *keys: Key, name: str = "previous") -> DataFrame:
    """The ``value`` of the row before in the order of ``keys`` (null for the first), range by range.

    The first row of a range takes the last value of the nearest range before that has rows.
    """
    rows = ranged(df, *keys)
    order = Window.partitionBy("_range").orderBy(*keys)
    rows = rows.withColumn("_row", F.row_number().over(order)).withColumn(name, F.lag(value).over(order))
    last = rows.groupBy("_range").agg(F.max_by(F.struct(value), "_row").alias("_last"))
    last = F.broadcast(last.select((F.lead("_range").over(Window.orderBy("_range"))).alias("_range"), F.col(f"_last.{value}").alias("_carried")))  # one row a range
    rows = rows.join(last, "_range", "left")
    return rows.withColumn(name, F.when(F.col("_row") == 1, F.col("_carried")).otherwise(F.col(name))).drop("_range", "_row", "_carried")


def tie_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """``rank()`` by one key: equal keys share the smallest position. Only key counts are ordered, not rows."""
    counts = with_position(df.groupBy(key).agg(F.count("*").alias("_n")), key, name="_p")
    rows = ranged(counts, "_p")
    within = Window.partitionBy("_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.sum("_n").alias("_s"))
    offsets = F.broadcast(sizes.select("_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset")))  # one row a range
    ranks = rows.join(offsets, "_range").select(key, (F.coalesce(F.sum("_n").over(within), F.lit(0)) + F.col("_offset") + 1).alias(name))
    return df.join(ranks, key)


def top_k(df: DataFrame, k: int, *keys: Key) -> DataFrame:
    """The first k rows: each task keeps k, so nothing is sorted as a whole."""
    return df.orderBy(*keys).limit(k)
