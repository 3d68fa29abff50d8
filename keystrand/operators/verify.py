"""Checks: sortedness, positional and multiset comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sorting import with_previous


def violations(df: DataFrame, value: str, *order: str) -> DataFrame:
    """Rows whose ``value`` is below that of the row before, with that value as ``previous``."""
    return with_previous(df, value, *order).where(F.col(value) < F.col("previous"))


def is_sorted(df: DataFrame, value: str, *order: str) -> DataFrame:
    """One row: ``violations`` and ``sorted``."""
    return violations(df, value, *order).agg(F.count("*").alias("violations")).withColumn("sorted", F.col("violations") == 0)


def positional_diff(left: DataFrame, right: DataFrame, columns: list[str], position: str = "position") -> DataFrame:
    """Positions at which any column differs or one side has no row.

    Every difference counts, of key or payload alike. Columns come as ``left_`` and ``right_``.
    """
    a = left.select(position, *[F.col(c).alias(f"left_{c}") for c in columns], F.lit(True).alias("_a"))
    b = right.select(position, *[F.col(c).alias(f"right_{c}") for c in columns], F.lit(True).alias("_b"))
    differ = F.col("_a").isNull() | F.col("_b").isNull()
    for c in columns:
        differ = differ | ~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))
    return a.join(b, position, "full").where(differ).drop("_a", "_b")


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks (as often as it lacks them), tagged ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def fingerprint(df: DataFrame) -> DataFrame:
    """Count and order-free hash sum: equal multisets have equal fingerprints, in one pass."""
    return df.select(F.xxhash64(*df.columns).cast("decimal(20,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").cast("decimal(38,0)").alias("hash_sum"))
