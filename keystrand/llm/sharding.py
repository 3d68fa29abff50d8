"""Sharding by longest-processing-time scheduling.

Groups (rows of equal text) must stay together. Sorted by size, each goes to
the shard that has least, which a heap finds.

The heap runs on the driver over a number of items that does not depend on the
input: a group above 1/``heavy`` of a shard's fair share is an item of its own
(there can be at most ``shards * heavy`` of these), and the groups below it are
packed by the hash of their text into ``cells`` fixed cells, each an item. Both
bounds are proven, so the plan is the same at any input size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import utf8_bytes, written

OVERHEAD = 8


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """LPT: ``(item, size)`` by falling size (ties: smaller item) to the least-loaded shard (ties: smaller shard)."""
    heap = [(0, k) for k in range(shards)]
    placed = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        placed[item] = k
        heapq.heappush(heap, (load + size, k))
    return placed


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000, cells: int = 1 << 16) -> DataFrame:
    """Place every row; returns id, size, text_crc32, law, shard, slot, grown_shard.

    Size: UTF-8 bytes plus 8. A null text has no bytes; it is of one group with
    the empty text. Rows that repeat are rows of their own. Null ids come last
    within an item. Columns beyond id and text are not read. An empty table
    gives an empty result. The law is ``bytes``, so ``grown_shard`` is null.
    """
    spark = docs.sparkSession
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"),
        (utf8_bytes(text_col) + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
    ))
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = max(1, total // (shards * heavy))

    # at most shards * heavy groups are above the limit
    large = [(r.h, r.bytes) for r in groups.where(F.col("bytes") > limit).orderBy("h").collect()]
    parts, at = [], cells
    for h, size in large:
        k = -(-size // limit)  # the rows of a large group are numbered in k parts, together at most 2 * shards * heavy
        parts.append((h, at, k))
        at += k
    heads = F.broadcast(spark.createDataFrame(parts, "h long, first long, parts long"))
    items = rows.join(heads, "h", "left").withColumn(
        "item",
        F.when(F.col("first").isNull(), F.pmod(F.col("h"), F.lit(cells)))
        .otherwise(F.col("first") + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts"))),
    ).select("doc_id", "size", "text_crc32", "item")
    counted = items.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("item").collect()

    first_of = {first + j: first for _, first, k in parts for j in range(k)}
    loads: dict[int, int] = {}
    for r in counted:
        head = first_of.get(r["item"], r["item"])
        loads[head] = loads.get(head, 0) + r["bytes"]
    placed = schedule(list(loads.items()), shards)
    fill, plan = [0] * shards, []
    for r in counted:
        k = placed[first_of.get(r["item"], r["item"])]
        plan.append((r["item"], k, fill[k]))
        fill[k] += r["n"]
    # one row for each item: bounded by cells + 2 * shards * heavy
    table = F.broadcast(spark.createDataFrame(plan, "item long, shard int, offset long"))
    order = Window.partitionBy("item").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (
        items.withColumn("slot", F.row_number().over(order).cast("long") - 1)
        .join(table, "item")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("offset")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
