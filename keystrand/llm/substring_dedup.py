"""Substring dedup by fixed-block anchors.

Every document indexes its non-overlapping blocks of ``anchor`` words, and
probes the index with each rolling window of as many words. A run of
``window`` >= 2 * anchor - 1 words that two documents share holds a whole
indexed block of either, so it is hit. Hits are extended: all windows of
``window`` words around them are compared across documents, by hash and
smallest id, and overlapping repeats unite to maximal exact repeats.

Both exchanges (probes with the index as a flag, then windows around hits) are
packed by blocks of documents, see :mod:`.blocks`; no pairs are formed, so a
passage that a third of all documents hold costs one entry for each block.
Windows are told apart by 64-bit hashes of their words' 64-bit hashes: of m
windows around hits, about m * m / 2 ** 65 would be mistaken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .shared import written

RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"
PROBE, WINDOW = 1, 2


def _runs(block: B.Block, window: int, anchor: int):
    """Words, starts of probes (of documents long enough to have a window), and the probes' hashes."""
    words = B.words_of(block, lower=False)
    valid = B.windows(words, anchor) & np.repeat(np.diff(words.first) >= window, np.diff(words.first))[: max(0, len(words.starts) - anchor + 1)]
    at = np.flatnonzero(valid)
    return words, at, B.mixed_bits(B.rolling(words.hashes, anchor))[at]


def _around(words: B.Words, at: np.ndarray, hit: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Starts of the windows that hold a hit."""
    n = len(words.starts) - window + 1
    if n <= 0 or not hit.any():
        return np.zeros(0, np.int64)
    hits = np.zeros(len(words.starts) + 1, np.int64)
    hits[at[hit] + 1] = 1
    hits = np.cumsum(hits)
    j = np.arange(n)
    return np.flatnonzero(B.windows(words, window) & (hits[j + window - anchor + 1] > hits[j]))


def _smallest(words: B.Words, block: B.Block, at: np.ndarray, keys: np.ndarray):
    order, heads = B.distinct(keys)
    ids = block.ids[words.doc()[at]]
    return order, heads, ids, np.minimum.reduceat(ids[order], heads) if len(heads) else ids


def _kept(block: B.Block, words: B.Words, covered: np.ndarray) -> Iterator[bytes]:
    """Of each document, the words that are not covered, joined by one space."""
    last = np.zeros(len(words.starts), bool)
    last[words.first[1:][np.diff(words.first) > 0] - 1] = True
    step = np.zeros(len(block.data) + 1, np.int8)
    step[words.starts[~covered]] += 1
    step[words.ends[~covered]] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    mask[words.ends[~covered & ~last]] = True
    out = np.where(B._SPACE[block.data], np.uint8(32), block.data)[mask]
    bounds = np.concatenate(([0], np.cumsum(mask)))[block.bounds]
    raw = out.tobytes()
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        yield raw[a : z - 1] if z > a and raw[z - 1] == 32 else raw[a:z]


def substring_dedup(docs: DataFrame, window: int = 50, anchor: int = 25, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    Returns one row per document: doc_id, n_words, n_removed, spans (maximal
    repeats, as word positions from 0, end exclusive), kept (the other words
    joined by one space). A null text has no words; texts with fewer than
    ``window`` words keep all. Rows with equal ids are one another's equals: neither
    is the smaller, so copies among them stay. Null ids count as the largest. An
    empty table gives an empty result. Other columns are not read.
    """
    if not 1 <= anchor <= (window + 1) // 2:
        raise ValueError("anchor must be at most half of window + 1, or a shared window may hold no indexed block")
    spark = docs.sparkSession
    table, parts = B.block_table(docs, id_col, text_col, block_bytes)

    def probe(block: B.Block) -> Iterator[pa.RecordBatch]:
        words, at, keys = _runs(block, window, anchor)
        if not len(keys):
            return
        order, heads, ids, low = _smallest(words, block, at, keys)
        high = np.maximum.reduceat(ids[order], heads)
        indexed = (at - words.first[words.doc()[at]]) % anchor == 0
        flags = np.logical_or.reduceat(indexed[order], heads) + 2 * (high > low).astype(np.uint8)
        yield from B.requests(block.block, keys[order][heads], parts, lambda a, z: B.squeeze(flags[a:z].astype(np.uint8)))

    def look_up(g: B.Gathered) -> list[bytes]:
        flags = np.concatenate([B.stretch(x, n, np.uint8) for x, n in zip(g.extras, np.diff(g.bounds), strict=True)])
        order, heads = B.distinct(g.keys)
        seen = np.bitwise_or.reduceat(flags[order], heads)
        times = np.diff(np.append(heads, len(order)))
        hit = np.zeros(len(order), np.uint8)
        hit[order] = np.repeat((seen & 1).astype(bool) & ((seen & 2).astype(bool) | (times > 1)), times)
        return [B.squeeze(hit[a:z]) for a, z in zip(g.bounds[:-1], g.bounds[1:], strict=True)]

    def hits(block: B.Block, blobs: dict):
        words, at, keys = _runs(block, window, anchor)
        order, heads = B.distinct(keys)
        hit = np.zeros(len(keys), bool)
        if len(keys):
            found = B.aligned(keys[order][heads], parts, blobs, PROBE, np.uint8)
            hit[order] = np.repeat(found, np.diff(np.append(heads, len(order)))).astype(bool)
        around = _around(words, at, hit, window, anchor)
        return words, around, B.mixed_bits(B.rolling(words.hashes, window))[around]

    def extend(block: B.Block, blobs: dict) -> pa.Table:
        words, around, keys = hits(block, blobs)
        order, heads, _, low = _smallest(words, block, around, keys)
        rows = list(B.requests(block.block, keys[order][heads], parts, lambda a, z: B.squeeze(low[a:z])))
        return pa.Table.from_batches(rows, schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())]))

    def earlier(g: B.Gathered) -> list[bytes]:
        low = np.concatenate([B.stretch(x, n, np.int64) for x, n in zip(g.extras, np.diff(g.bounds), strict=True)])
        order, heads = B.distinct(g.keys)
        least = np.minimum.reduceat(low[order], heads)
        before = np.zeros(len(order), np.uint8)
        before[order] = np.repeat(least, np.diff(np.append(heads, len(order)))) < low[order]
        return [B.squeeze(before[a:z]) for a, z in zip(g.bounds[:-1], g.bounds[1:], strict=True)]

    def finish(block: B.Block, blobs: dict) -> pa.Table:
        words, around, keys = hits(block, blobs)
        order, heads, ids, low = _smallest(words, block, around, keys)
        covered = np.zeros(len(words.starts) + 1, np.int64)
        if len(keys):
            times = np.diff(np.append(heads, len(order)))
            before = np.repeat(B.aligned(keys[order][heads], parts, blobs, WINDOW, np.uint8), times).astype(bool)
            repeat = around[order][before | (ids[order] > np.repeat(low, times))]
            covered[repeat] += 1
            covered[repeat + window] -= 1
        covered = np.cumsum(covered)[:-1] > 0
        removed = np.concatenate(([0], np.cumsum(covered)))[words.first]
        spans: list[list[dict]] = [[] for _ in block.ids]
        doc = words.doc()
        where = np.flatnonzero(covered)
        if len(where):
            breaks = np.flatnonzero((np.diff(where) > 1) | (np.diff(doc[where]) > 0)) + 1
            for a, z in zip(where[np.concatenate(([0], breaks))], where[np.concatenate((breaks, [len(where)])) - 1], strict=True):
                d = doc[a]
                spans[d].append({"start": int(a - words.first[d]), "end": int(z - words.first[d]) + 1})
        kept = [x.decode("utf-8", "replace") for x in _kept(block, words, covered)] if len(words.starts) else [""] * len(block.ids)
        ids = pa.array(block.ids, pa.int64(), mask=block.ids == B.NO_ID)
        return pa.table({"doc_id": ids, "n_words": pa.array(np.diff(words.first), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.string())})

    first = written(B.answered(B.asked(table, probe), look_up).withColumn("kind", F.lit(PROBE)))
    second = written(B.answered(B.with_answers(table, first, extend, B.REQUEST_SCHEMA), earlier).withColumn("kind", F.lit(WINDOW)))
    return B.with_answers(table, first.unionByName(second), finish, RESULT)
