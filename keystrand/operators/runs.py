"""Runs and chunks: how an external sort would cut its input.

Spark's sorter spills by itself; these operators make the cuts visible. Greedy
cuts are recurrences along a file: each depends on the cut before. They are
folded in one pass over rows that are sorted within their file, one task a
file, with memory for one batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

# What runs must equal.
#: Shares of the memory budget: a sorted run, and the heap of replacement selection.
RUN_SHARE = 0.9
HEAP_SHARE = 0.8
#: A heap gives up a twentieth of its records at a time.
BATCH_PART = 20


def fixed_runs(df: DataFrame, rows_per_run: int, position: str = "position", name: str = "run_id") -> DataFrame:
    """Runs of so many rows each, by position from 1."""
    return df.withColumn(name, F.floor((F.col(position) - 1) / rows_per_run).cast("long"))


def run_stats(df: DataFrame, key: str, size: str, run: str = "run_id") -> DataFrame:
    return df.groupBy(run).agg(F.count("*").alias("n"), F.min(key).alias("kmin"), F.max(key).alias("kmax"), F.sum(size).cast("long").alias("bytes"))


def _fold(df: DataFrame, size: str, file: str, order: list[str], name: str, cut) -> DataFrame:
    schema = StructType([*df.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, chunk = (), 0, 0
        for batch in batches:
            parts = []
            for key, rows in batch.groupby(file, sort=False, dropna=False):
                mine = None if pd.isna(key) else key  # rows without a file name are one file
                if mine != current:
                    current, used, chunk = mine, 0, 0
                sizes, ids = rows[size].to_numpy(np.int64), np.empty(len(rows), np.int64)
                ends, at = np.cumsum(sizes), 0
                while at < len(ids):
                    base = int(ends[at - 1]) if at else 0
                    to, closed = cut(ends, base, used, at)
                    ids[at:to] = chunk
                    used += (int(ends[to - 1]) if to else 0) - base
                    if closed:
                        chunk, used = chunk + 1, 0
                    at = to
                parts.append(rows.assign(**{name: ids}))
            if parts:
                yield pd.concat(parts)

    return df.repartition(file).sortWithinPartitions(file, *order).mapInPandas(run, schema)


def greedy_chunks(df: DataFrame, chunk_bytes: int, size: str, file: str, *order: str, name: str = "chunk_id") -> DataFrame:
    """Cut after the row that brings a chunk to ``chunk_bytes`` or more; the rest is the last chunk."""

    def cut(ends: np.ndarray, base: int, used: int, at: int) -> tuple[int, bool]:
        to = int(np.searchsorted(ends, base + chunk_bytes - used)) + 1
        return (to, True) if to <= len(ends) else (len(ends), False)

    return _fold(df, size, file, list(order), name, cut)


def budget_runs(df: DataFrame, budget_bytes: int, size: str, file: str, *order: str, name: str = "run_id") -> DataFrame:
    """Cut before the row that would exceed the budget; a row above it is a run of its own."""

    def cut(ends: np.ndarray, base: int, used: int, at: int) -> tuple[int, bool]:
        to = int(np.searchsorted(ends, base + budget_bytes - used, side="right"))
        if to == at and used == 0:
            to = at + 1  # larger than the budget
        return to, to < len(ends)

    return _fold(df, size, file, list(order), name, cut)


def sorted_runs(df: DataFrame, budget_bytes: int, key: str, size: str, file: str, *order: str, name: str = "run_id") -> DataFrame:
    """Load-sort runs: cuts by budget in the order of the file, and each run's rows sorted by key (ties: as they came), with ``run_position`` from 1."""
    within = Window.partitionBy(file, name).orderBy(key, *order)
    return budget_runs(df, budget_bytes, size, file, *order, name=name).withColumn("run_position", F.row_number().over(within).cast("long"))


def replacement_runs(df: DataFrame, memory_bytes: int, key: str, size: str, *arrival: str, lanes: int = 1) -> DataFrame:
    """Replacement selection: a heap within HEAP_SHARE of memory gives up its smallest keys batch by batch.

    A row whose key is below the last one given up waits for the next run. Adds
    lane (the share of the input that one heap works through), run_id within it
    and run_position. Rows arrive in the order of ``arrival`` within a lane.
    """
    schema = StructType([*df.schema.fields, StructField("lane", IntegerType()), StructField("run_id", LongType()), StructField("run_position", LongType())])
    columns, room = df.columns, int(memory_bytes * HEAP_SHARE)
    k, s = columns.index(key), columns.index(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap: list = []
        held = seq = current = position = 0
        last = None
        lane = None

        def give(n: int) -> list:
            nonlocal held, current, position, last
            out = []
            for _ in range(min(n, len(heap))):
                if heap[0][0] != current:
                    current, position, last = heap[0][0], 0, None
                _, value, _, row = heapq.heappop(heap)
                held -= row[s]
                position, last = position + 1, value
                out.append((*row, lane, current, position))
            return out

        for batch in batches:
            out: list = []
            for row in batch.itertuples(index=False, name=None):
                *row, mine = row
                if mine != lane:
                    out += give(len(heap))
                    lane, held, current, position, last = mine, 0, 0, 0, None
                while heap and held + row[s] > room:
                    out += give(max(1, len(heap) // BATCH_PART))
                seq += 1
                heapq.heappush(heap, (current + (last is not None and row[k] < last), row[k], seq, row))
                held += row[s]
            if out:
                yield pd.DataFrame(out, columns=[*columns, "lane", "run_id", "run_position"])
        if heap:
            yield pd.DataFrame(give(len(heap)), columns=[*columns, "lane", "run_id", "run_position"])

    dealt = df.withColumn("_lane", F.pmod(F.xxhash64(*arrival), F.lit(lanes)).cast("int"))
    return dealt.repartition(lanes, "_lane").sortWithinPartitions("_lane", *arrival).mapInPandas(run, schema)
