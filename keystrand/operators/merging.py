"""Merging sorted inputs.

Spark keeps sorts below a union, so runs are never sorted first: a merge is the
union of its inputs, tagged by origin, ordered once. All merge shapes (pairs,
k ways, levels, groups) give the same order; ties fall to the earlier input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sorting import with_position


def tagged(inputs: list[DataFrame], name: str = "src") -> DataFrame:
    return reduce(DataFrame.unionByName, [x.withColumn(name, F.lit(i)) for i, x in enumerate(inputs)])


def pair_merge(left: DataFrame, right: DataFrame, key: str, *ties: str) -> DataFrame:
    """Merge two inputs; equal keys of the left one come first, then by ``ties``."""
    return with_position(tagged([left, right]), key, "src", *ties)


def kway_merge(runs: DataFrame, key: str, run: str = "run_id", *ties: str) -> DataFrame:
    """Merge runs that stand in one table: by key, then run, then ``ties``."""
    return with_position(runs, key, run, *ties)


def merge_levels(spark: SparkSession, runs: int) -> DataFrame:
    """How many files each level of a binary merge tree has; an odd one is carried up."""
    levels, n = [(0, runs)], runs
    while n > 1:
        n = n // 2 + n % 2
        levels.append((len(levels), n))
    return spark.createDataFrame(levels, "level int, files long")


def merge_groups(df: DataFrame, runs: int, workers: int, run: str = "run_id", name: str = "group_id") -> DataFrame:
    """Consecutive runs in groups of ceil(runs / workers): what one worker merges before the last merge.

    With fewer than twice as many runs as workers one level is enough: group 0.
    """
    each = -(-runs // workers)
    return df.withColumn(name, (F.floor(F.col(run) / each) if runs >= 2 * workers else F.lit(0)).cast("long"))


def _within(df: DataFrame, groups: list[str], name: str, *keys: str) -> DataFrame:
    """Positions from 1 within each group, in one order of all rows: no task need hold a group."""
    rows = with_position(df, *groups, *keys, name=name)
    first = rows.groupBy(*groups).agg(F.min(name).alias("_first"))
    return rows.join(first, groups).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def merge_tree(runs: DataFrame, count: int, key: str, *ties: str, run: str = "run_id") -> DataFrame:
    """Binary merging of ``count`` runs (0 to count - 1), level by level, as data.

    Returns every level's rows: ``level``, ``merged_run`` (which run of that
    level a row is in) and its ``position`` there from 1. A level merges runs
    0 and 1, 2 and 3, ...; an odd last one is carried up as it is. Ties fall to
    the earlier run, then to ``ties``. Levels are written for inspection: the
    last one by itself is a k-way merge.
    """
    levels = max(0, count - 1).bit_length()
    rows = runs.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    rows = rows.withColumn("merged_run", F.call_function("shiftright", F.col(run).cast("long"), F.col("level")))
    return _within(rows, ["level", "merged_run"], "position", key, run, *ties)


def grouped_merge(runs: DataFrame, count: int, workers: int, key: str, *ties: str, run: str = "run_id") -> DataFrame:
    """Merging in two levels: each worker its group of runs, then the groups.

    Returns rows with ``group_id`` and ``group_position`` (their place in what
    the worker merged) and ``position`` (their place in the end).
    """
    rows = _within(merge_groups(runs, count, workers, run), ["group_id"], "group_position", key, run, *ties)
    return with_position(rows, key, "group_id", "group_position")
