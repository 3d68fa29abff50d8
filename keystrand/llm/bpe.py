"""Byte-level BPE: each distinct word is encoded once, in a global shuffle of distinct words.

Documents are split into pre-tokens, held by blocks as positions in the block's
word list. Each block sends its distinct words to their owners (ranges of a word
hash); an owner encodes each distinct word once, whichever and however many
blocks ask, and the ids go back to the blocks, where each document's ids are
put together by position. Decoding joins each id with the table of token bytes.

The vocabulary file is read by the driver and sent to executors: its size is
that of a tokenizer, whatever the input.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..shipping import ship
from . import blocks as B
from .shared import written

CODED = "block long, ids array<long>, counts array<long>, n long, digest long, codes binary, rank binary"
BLOCK_BYTES = 3 << 20
_ranks: dict[int, dict[bytes, int]] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def ranks_of(blob: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank in each line."""
    key = hash(blob)
    if key not in _ranks:
        _ranks[key] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    return _ranks[key]


#: Up to so many bytes the pair to merge is looked for in a list, beyond it in a heap.
SHORT = 64


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all neighbours the pair of lowest rank is merged (the first of equals), until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) <= SHORT:
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[x] for x in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
    # a linked list of parts, by their first byte, and a heap of pairs; a pair counts if its parts are still those it was made of
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, z = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != z:
            continue
        alive[end[i]] = 0
        end[i] = z
        if z < n:
            before[z] = i
            if (r := ranks.get(word[i : end[z]])) is not None:
                heapq.heappush(heap, (r, i, end[z]))
        if i and (r := ranks.get(word[before[i] : z])) is not None:
            heapq.heappush(heap, (r, before[i], z))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def steady(docs: DataFrame) -> bool:
    """Whether every scan of ``docs`` gives the same rows in the same order: only projections and filters over files (or a range)."""
    plan = docs._jdf.queryExecution().optimizedPlan()

    def fine(node) -> bool:
        below = [node.children().apply(i) for i in range(node.children().size())]
        return node.nodeName() in ("Project", "Filter", "LogicalRelation", "RelationV2", "Relation", "Range", "SubqueryAlias") and all(map(fine, below))

    return bool(plan.deterministic()) and fine(plan)


def ascii_form(pattern: str) -> str:
    """The pattern for texts of ASCII characters only, in the syntax of the faster standard module: \\p{L} and \\p{N} become ranges."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i : i + 5] in (r"\p{L}", r"\p{N}"):
            letters = "A-Za-z" if pattern[i + 3] == "L" else "0-9"
            out.append(letters if inside else f"[{letters}]")
            i += 5
        elif c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        else:
            inside = c == "[" or inside and c != "]"
            out.append(c)
            i += 1
    return "".join(out)


class Words(NamedTuple):
    """A block of documents as positions in its list of distinct words, which stand in the order of their hashes."""

    block: int
    ids: list
    counts: list[int]
    flat: np.ndarray
    words: list[bytes]
    keys: np.ndarray
    order: np.ndarray


def pre_tokenised(batches: Iterator[pa.RecordBatch], pattern: str, block_bytes: int) -> Iterator[Words]:
    """Blocks of a task's (id, text) rows. Blocks depend on the rows and their order only, not on how they come in batches."""
    import regex
    import xxhash
    from pyspark import TaskContext

    find, seq = regex.compile(pattern).findall, TaskContext.get().partitionId() << 20
    find_ascii = re.compile(ascii_form(pattern), re.ASCII).findall

    def fresh() -> tuple[defaultdict, list, list, list]:
        codes: defaultdict = defaultdict()
        codes.default_factory = codes.__len__
        return codes, [], [], []

    codes, ids, counts, parts = fresh()
    size = 0

    def block() -> Words:
        flat = np.concatenate(parts)
        words = [w.encode() for w in codes]
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(keys, kind="stable")
        return Words(seq, ids, counts, flat, [words[i] for i in order], keys[order], order)

    for batch in batches:
        texts = batch.column(1)
        for i, key in enumerate(batch.column(0).to_pylist()):
            text = texts[i].as_py() or ""
            found = (find_ascii if text.isascii() else find)(text)
            ids.append(key)
            counts.append(len(found))
            parts.append(np.fromiter(map(codes.__getitem__, found), np.uint32, len(found)))
            size += len(text)
            if size >= block_bytes or len(ids) >= 1 << 16:
                yield block()
                codes, ids, counts, parts = fresh()
                seq, size = seq + 1, 0
                B.trim()
    if ids:
        yield block()
    del codes, parts
    B.trim()


def _digest(keys: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1


def _packed(words: list[bytes]) -> bytes:
    lens = B.squeeze(np.array([len(w) for w in words], np.uint32))
    return struct.pack("<q", len(lens)) + lens + zstandard.ZstdCompressor(3).compress(b"".join(words))


def _unpacked(blob: bytes, n: int) -> list[bytes]:
    (size,) = struct.unpack_from("<q", blob)
    lens = B.stretch(blob[8 : 8 + size], n, np.uint32)
    raw = zstandard.ZstdDecompressor().decompress(blob[8 + size :], max_output_size=max(1, int(lens.sum())))
    at = np.concatenate(([0], np.cumsum(lens, dtype=np.int64))).tolist()
    return [raw[a:z] for a, z in zip(at, at[1:], strict=False)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """Encode whole texts; returns one row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    With ``decoded`` the ids are decoded again where they stand (as :func:`decode`
    would), into a further column of bytes.

    A null text encodes as the empty one, to no ids. Rows that repeat, and null
    ids, are rows of their own. An empty table gives an empty result. Each match
    of ``pattern`` is encoded by itself, special tokens are not known. Other columns are not read.

    Texts are split twice, for the words and again for the positions: writing
    the positions down would cost more disk than a second pass costs time. Both
    passes must see the same rows in the same order, also where a task is
    repeated: files give that, and what does not come straight from files (after
    a shuffle, say) is written first. A digest of the word list proves it.
    """
    spark = docs.sparkSession
    ship(spark)
    blob = spark.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text"))
    if not steady(rows):
        rows = written(rows, block_mb=16)
    block_bytes, parts = B.sizes(B.text_bytes(rows), block_bytes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pre_tokenised(batches, pattern, block_bytes):
            bounds = B.part_bounds(x.keys, parts)
            for p in np.flatnonzero(np.diff(bounds)):
                mine = x.words[bounds[p] : bounds[p + 1]]
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "block": pa.array([x.block], pa.int64()), "n": pa.array([len(mine)], pa.int32()), "digest": pa.array([_digest(x.keys)], pa.int64()), "words": pa.array([_packed(mine)], pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        ranks = ranks_of(blob.value)
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        asked = []
        for n, words in zip(group.column("n").to_pylist(), group.column("words").to_pylist(), strict=True):
            asked.append(np.fromiter(map(known.__getitem__, _unpacked(words, n)), np.int64, n))
        coded = [merged(w, ranks) for w in known]  # each distinct word once
        lens = np.array([len(x) for x in coded], np.uint32)
        heads = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        flat = np.fromiter((i for x in coded for i in x), np.uint32, int(heads[-1]))
        blobs = []
        for code in asked:
            sizes = B.squeeze(lens[code])
            blobs.append(struct.pack("<qq", len(code), len(sizes)) + sizes + B.squeeze(flat[_spread(heads[code], lens[code].astype(np.int64))]))
        del known, coded, asked, flat, lens, heads
        B.trim()
        return pa.table({"block": group.column("block"), "part": group.column("part"), "digest": group.column("digest"), "answer": pa.array(blobs, pa.binary())})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions as ranks by frequency in the block, so that they are small."""
        for x in pre_tokenised(batches, pattern, block_bytes):
            rank = np.empty(len(x.words), np.uint32)
            rank[np.argsort(-np.bincount(x.flat, minlength=len(x.words)), kind="stable")] = np.arange(len(x.words), dtype=np.uint32)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([x.block], pa.int64()), "ids": pa.array([x.ids], pa.list_(pa.int64())), "counts": pa.array([x.counts], pa.list_(pa.int64())), "n": pa.array([len(x.words)], pa.int64()),
                "digest": pa.array([_digest(x.keys)], pa.int64()), "codes": pa.array([B.squeeze(rank[x.flat])], pa.binary()), "rank": pa.array([B.squeeze(rank[x.order])], pa.binary()),
            })

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        n = row["n"]
        lens, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for _, digest, x in sorted(zip(right.column("part").to_pylist(), right.column("digest").to_pylist(), right.column("answer").to_pylist(), strict=True)):
            if digest != row["digest"]:
                raise ValueError("the two passes over the texts saw different rows")
            size, z = struct.unpack_from("<qq", x)
            lens.append(B.stretch(x[16 : 16 + z], size, np.uint32))
            ids.append(B.stretch(x[16 + z :], int(lens[-1].sum()), np.uint32))
        lens, ids = np.concatenate(lens).astype(np.int64), np.concatenate(ids)
        where = np.empty(n, np.int64)
        where[B.stretch(row["rank"], n, np.uint32)] = np.arange(n)
        counts = np.array(row["counts"], np.int64)
        code = where[B.stretch(row["codes"], int(counts.sum()), np.uint32)]
        heads = np.concatenate(([0], np.cumsum(lens)))[:-1]
        flat = ids[_spread(heads[code], lens[code])]
        ends = np.concatenate(([0], np.cumsum(lens[code])))[np.concatenate(([0], np.cumsum(counts)))]
        raw = flat.astype("<u4").tobytes()
        packed = [raw[4 * a : 4 * z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        out = {"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids": pa.array(packed, pa.binary())}
        if decoded:
            del code, flat, where
            text = Decoder(ranks_of(blob.value))
            out["decoded"] = pa.array(map(text, packed), pa.binary())
        B.trim()
        return pa.table(out)

    wanted = rows.mapInArrow(ask, "part int, block long, n int, digest long, words binary")
    found = wanted.groupBy("part").applyInArrow(answer, "block long, part int, digest long, answer binary")
    return rows.mapInArrow(place, CODED).groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def _spread(heads: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions heads[i], heads[i] + 1, ... (lens[i] of them) for each i in turn."""
    ends = np.cumsum(lens)
    return np.repeat(heads - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


class Decoder:
    """The table of token bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.lens = np.array([len(x) for x in tokens], np.int64)
        self.heads, self.data = np.concatenate(([0], np.cumsum(self.lens)))[:-1], np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, packed: bytes | None, piece: int = 1 << 17) -> bytes | None:
        """The bytes of packed ids, joined to the table a piece at a time."""
        if packed is None:
            return None
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        return b"".join(self.data[_spread(self.heads[i], self.lens[i])].tobytes() for i in np.split(ids, range(piece, len(ids), piece)))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for; null ids give null. An id that is not in the vocabulary is an error."""
    spark = encoded.sparkSession
    ship(spark)
    blob = spark.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file
    names = encoded.columns
    at = names.index(ids_col)
    plain = [f"c{i}" for i in range(len(names) + 1)]  # column names may be such as cannot be referred to
    schema = StructType([StructField(c, kind) for c, kind in zip(plain, [*(f.dataType for f in encoded.schema.fields), BinaryType()], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = Decoder(ranks_of(blob.value))
        for batch in batches:
            out = pa.array([text(x.as_py()) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=plain)

    return encoded.toDF(*plain[:-1]).mapInArrow(run, schema).toDF(*names, out_col)
