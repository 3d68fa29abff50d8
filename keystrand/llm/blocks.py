"""Blocks of documents, and exchanges of packed keys between blocks and key owners.

A corpus of words has far too many rolling windows to shuffle one row each.
Here the documents stand in a table of blocks (some MB of text each, whole
documents). A block sorts the keys it asks about, and sends each owner (a range
of the key space) one packed blob; the owner answers with an array aligned to
that blob, and the block, deriving the same sorted keys again, reads the answer
by position. Nothing that grows with the corpus is broadcast or collected; a
key occurs once in each block's request however often the block has it, so a
hot key loads its owner with one entry for each block only.

Every block may ask every owner, so there are up to blocks times owners packed
requests. Blocks and owners therefore grow with the root of the corpus (see
:func:`sizes`): the requests are in proportion to the corpus, each holds a
hundred keys or more, and a task's memory grows as the root: 4 MB blocks up to
160 GB of text, 100 MB at 100 TB. A hot key's share of an owner is one entry for
each block, at 100 TB a hundredth of what the owner holds.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import written

BLOCK_BYTES = 4 << 20
#: An owner has the keys of so many blocks' text.
OWNER_BLOCKS = 6
NO_ID = np.iinfo(np.int64).max  # stands for a null id, after all others

BLOCK_SCHEMA = "block long, size long, ids array<long>, lens array<long>, text binary"
REQUEST_SCHEMA = "part int, block long, n int, keys binary, extra binary"
ANSWER_SCHEMA = "block long, part int, answer binary"


def trim() -> None:
    """Give memory that is free back to the system: Python workers live on, idle, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def sizes(total: int, least: int = BLOCK_BYTES) -> tuple[int, int]:
    """Bytes of a block, and number of owners (a power of two), for so many bytes of text."""
    block = max(least, math.isqrt(100 * total))
    return block, power_of_two(total / (OWNER_BLOCKS * block))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0


def block_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Write the documents as blocks; returns the table and the number of owners.

    A text is never cut, so one long text may be a block of its own. A null text
    has length -1, a null id stays null; ids must be integers or their text.
    """
    block_bytes, parts = sizes(text_bytes(docs, text_col), least)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze, seq, ids, lens, parts, size = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 20, [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([seq], pa.int64()), "size": pa.array([size], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "lens": pa.array([lens], pa.list_(pa.int64())), "text": pa.array([squeeze.compress(b"".join(parts))], pa.binary())})

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for i, key in enumerate(batch.column(0).to_pylist()):
                text = texts[i].as_py()
                ids.append(key)
                lens.append(-1 if text is None else len(text))
                parts.append(text or b"")
                size += len(text or b"")
                if size >= block_bytes or len(ids) >= 1 << 16:
                    yield row()
                    seq, ids, lens, parts, size = seq + 1, [], [], [], 0
        if ids:
            yield row()
        trim()

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return written(rows.mapInArrow(make, BLOCK_SCHEMA), block_mb=8), parts


def power_of_two(least: float) -> int:
    return 1 << max(0, math.ceil(least) - 1).bit_length()


class Block(NamedTuple):
    """A block in memory: ids as int64 (NO_ID for null), byte bounds of texts, and the bytes."""

    block: int
    ids: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    null: np.ndarray


def opened(row: dict) -> Block:
    lens = np.array(row["lens"], np.int64)
    ids = np.array([NO_ID if x is None else x for x in row["ids"]], np.int64)
    raw = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, row["size"]))
    bounds = np.concatenate(([0], np.cumsum(np.maximum(lens, 0))))
    return Block(row["block"], ids, bounds, np.frombuffer(raw, np.uint8), lens < 0)


# ---------------------------------------------------------------- hashing

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that their top bits are even."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words(NamedTuple):
    """Words of a block in order: byte starts and ends, hashes, and the first word's index of each document (with an end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))


def words_of(block: Block, lower: bool, piece: int = 1 << 20) -> Words:
    """Find words (longest runs of other than ASCII white space) and hash their bytes, A-Z as a-z if ``lower``."""
    data, bounds = block.data, block.bounds
    empty = np.zeros(0, np.int64)
    if not len(data):
        return Words(empty, empty, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    begins[cuts] = solid[cuts]  # a text's first byte may begin a word
    starts = np.flatnonzero(begins)
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | begins[1:]
    ends = np.flatnonzero(stops) + 1
    table = _BYTE.copy()
    if lower:
        table[65:91] = table[97:123]
    hashes, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece)))
        a, z = starts[at], ends[to - 1]
        head = starts[at:to] - a
        place = np.zeros(z - a, np.int32)
        place[head] = head
        np.maximum.accumulate(place, out=place)
        place = np.arange(z - a, dtype=np.int32) - place
        powers = np.cumprod(np.full(int(place.max()) + 1, _R, np.uint64))
        value = table[data[a:z]] * powers[place]
        value[~solid[a:z]] = 0
        hashes[at:to] = np.add.reduceat(value, head)
        at = to
    hashes = mixed_bits(hashes + (ends - starts).astype(np.uint64))
    return Words(starts, ends, hashes, np.searchsorted(starts, bounds))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive ones (of as many windows as there are), by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, width, power = np.zeros(n, np.uint64), 0, 1, _Q
    part, scale = hashes, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                total += scale * part[done : done + n]
                scale, done = scale * power, done + width
            if done == k:
                return total
            part = part[: len(part) - width] + power * part[width:]
            width, power = width * 2, power * power


def windows(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each word on are of one document."""
    n = max(0, len(words.starts) - k + 1)
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(words.starts))
    return left[:n] >= k


# ---------------------------------------------------------------- packing

def squeeze(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: planes that are mostly zero cost little."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def stretch(blob: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, n * size))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def stretch_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(stretch(blob, n, np.uint64), dtype=np.uint64)


def part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each owner's keys begin in sorted keys, with an end."""
    if parts == 1:
        return np.array([0, len(keys)])
    step = np.uint64((1 << 64) // parts)
    return np.concatenate(([0], np.searchsorted(keys, np.arange(1, parts, dtype=np.uint64) * step), [len(keys)]))


def requests(block: int, keys: np.ndarray, parts: int, extra: Callable[[int, int], bytes]) -> Iterator[pa.RecordBatch]:
    """One row for each owner of some of the sorted keys; ``extra(a, z)`` packs what goes with keys[a:z]."""
    bounds = part_bounds(keys, parts)
    for p in np.flatnonzero(np.diff(bounds)):
        a, z = int(bounds[p]), int(bounds[p + 1])
        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "block": pa.array([block], pa.int64()), "n": pa.array([z - a], pa.int32()), "keys": pa.array([squeeze_keys(keys[a:z])], pa.binary()), "extra": pa.array([extra(a, z)], pa.binary())})


def asked(blocks: DataFrame, ask: Callable[[Block], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The requests of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from ask(opened(batch.slice(i, 1).to_pylist()[0]))
                trim()

    return blocks.mapInArrow(run, REQUEST_SCHEMA)


class Gathered(NamedTuple):
    """All requests to one owner: block and size of each, keys one after the other, and the extras."""

    blocks: list[int]
    bounds: np.ndarray
    keys: np.ndarray
    extras: list[bytes]


def answered(wanted: DataFrame, answer: Callable[[Gathered], list[bytes]]) -> DataFrame:
    """Each owner answers its requests: one blob for each of them, in their order."""

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n").to_pylist()
        bounds = np.concatenate(([0], np.cumsum(n)))
        keys = np.concatenate([stretch_keys(x.as_py(), k) for x, k in zip(table.column("keys"), n, strict=True)])
        blobs = answer(Gathered(table.column("block").to_pylist(), bounds, keys, table.column("extra").to_pylist()))
        trim()
        return pa.table({"block": table.column("block"), "part": table.column("part"), "answer": pa.array(blobs, pa.binary())})

    return wanted.groupBy("part").applyInArrow(run, ANSWER_SCHEMA)


def with_answers(blocks: DataFrame, answers: DataFrame, finish: Callable[[Block, dict], Iterator[pa.RecordBatch] | pa.Table], schema: str) -> DataFrame:
    """Bring the answers to their blocks; ``finish`` gets the block and its blobs by (kind, owner).

    ``answers`` may have a column ``kind`` to tell several exchanges apart.
    """
    kinds = "kind" in answers.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("kind").to_pylist() if kinds else [0] * right.num_rows
        blobs = dict(zip(zip(kind, right.column("part").to_pylist(), strict=True), right.column("answer").to_pylist(), strict=True))
        out = finish(opened(left.to_pylist()[0]), blobs)
        trim()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def aligned(keys: np.ndarray, parts: int, blobs: dict, kind: int, dtype) -> np.ndarray:
    """An answer for each of the sorted keys, from owners that sent one number each."""
    bounds, out = part_bounds(keys, parts), np.zeros(len(keys), dtype)
    for p in np.flatnonzero(np.diff(bounds)):
        a, z = int(bounds[p]), int(bounds[p + 1])
        out[a:z] = stretch(blobs[kind, int(p)], z - a, dtype)
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of keys, and where runs of equal ones begin in it."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return order, np.flatnonzero(new)
