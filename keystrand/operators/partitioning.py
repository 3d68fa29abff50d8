"""Dealing rows and chunks to workers, and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB = 1 << 30


def round_robin(df: DataFrame, workers: int, position: str = "position", name: str = "worker") -> DataFrame:
    """Row i to worker i mod n, by position from 1."""
    return df.withColumn(name, F.pmod(F.col(position) - 1, F.lit(workers)).cast("long"))


def deal_chunks(df: DataFrame, workers: int, chunk: str = "chunk_id", name: str = "worker") -> DataFrame:
    """Chunk i to worker i mod (n - 1): one of n hands the chunks out. With one worker it takes all."""
    return df.withColumn(name, F.pmod(F.col(chunk), F.lit(max(1, workers - 1))).cast("long"))


# The shares and bounds below are what budgets must equal.
def memory_budget(total_bytes: Column, available: int = 8 * GIB, most: int = 32 * GIB, share: int = 10) -> Column:
    """The smallest of a share of the input, the available memory and a fixed bound."""
    return F.least(F.floor(total_bytes / share), F.lit(available), F.lit(most)).cast("long")


def memory_cap(requested: Column, file_bytes: Column) -> Column:
    """No more than 1.1 times the file."""
    return F.least(requested, F.floor(file_bytes * 1.1)).cast("long")


def chunk_bytes(file_bytes: Column, memory: Column, workers: int) -> Column:
    """A hundredth of the file, or what three workers' shares of memory hold, if less."""
    return F.least(F.floor(file_bytes / 100), F.floor(memory * 3 / workers)).cast("long")
