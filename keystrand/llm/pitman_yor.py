"""Hierarchical Pitman-Yor language model, trained and scored over blocks of documents.

Each context has a restaurant of its own; all share one parent, whose base is
uniform over the training vocabulary and one place for unknown words. A
context is the word before, whichever it is, or a text's start. Counts cover the
whole training corpus. They are held by owners of word-hash ranges, so that all
seats of a word, in every context and in the parent, are in one task. What the
tasks share are restaurant totals: after each sweep, the owners of words send
the tables of their contexts to the owners of context-hash ranges, packed, and
get the sums of all owners back for the next sweep. The driver gets only sums
over all contexts.

Gibbs sampling: given all other words' tables, the number of tables of a word in
a restaurant has the law S(n, t) * x ** t (generalised Stirling numbers; x: the
weight of a new table), from which it is drawn directly; for words with over
``STIRLING`` customers in a restaurant the law's mean and variance come from
its saddle point. Draws are seeded by sweep and owner, so a lost task repeats
the same ones. Each sweep starts from the seats that the one before wrote.
Predictive probabilities are averaged over the sweeps after burn-in.

A task holds what an owner is asked about packed. It is unpacked request by
request, again for the answers; pairs are merged by ranges of about ``PIECE``.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .shared import remove_folder, shared_folder, written

BLOCK_BYTES = 8 << 20
#: Pairs of an owner that are merged at once.
PIECE = 1 << 18
STIRLING = 64
STRENGTH = 1.0
END = np.uint64(0xA0761D6478BD642F)  # stands for the end of a text, and as a context for the start of the next
#: Rows of an owner: to an owner of contexts (part), or what stays with it (MODEL: its counts, later its seats), with sums for the driver.
ROWS = f"{B.REQUEST_SCHEMA}, sums array<long>"
MODEL, SEATS = -1, -2
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Tokens(NamedTuple):
    """Tokens of a block (each text's words, then its end): hash, and each document's first token (with an end)."""

    keys: np.ndarray
    first: np.ndarray


def tokens_of(block: B.Block) -> Tokens:
    words = B.words_of(block, lower=True)
    n = len(block.ids)
    keys = np.full(len(words.hashes) + n, END, np.uint64)
    at = np.arange(len(words.hashes)) + words.doc()
    keys[at] = words.hashes
    return Tokens(keys, words.first + np.arange(n + 1))


def _held_out(block: B.Block, folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == B.NO_ID else str(i).encode()) % folds == fold for i in block.ids.tolist()], bool)


class Pairs(NamedTuple):
    """A block's distinct words, and its distinct (word, context) pairs, by word; a context is the place of its word."""

    keys: np.ndarray
    of_word: np.ndarray
    context: np.ndarray
    of_token: np.ndarray
    word_of_pair: np.ndarray


def _pairs(tokens: Tokens) -> Pairs:
    keys, code = np.unique(tokens.keys, return_inverse=True)
    width = len(keys)
    before = np.concatenate(([np.searchsorted(keys, END)], code[:-1]))  # a text's first word follows an end
    pair, of_token = np.unique(code * width + before, return_inverse=True)
    return Pairs(keys, np.bincount(pair // width, minlength=width), pair % width, of_token, pair // width)


def _packed(pairs: Pairs, count: np.ndarray, at: np.ndarray, a: int, z: int) -> bytes:
    """What goes with the words keys[a:z]: pairs of each word, the hashes of their contexts, each pair's place there and count."""
    mine = slice(at[a], at[z])
    used, place = np.unique(pairs.context[mine], return_inverse=True)
    hashes = np.diff(pairs.keys[used], prepend=np.uint64(0))
    return _blobs(pairs.of_word[a:z].astype(np.uint32), hashes, place.astype(np.uint32), count[mine])


class Asked(NamedTuple):
    """All pairs that an owner is asked about, request by request, packed; and their contexts' hashes, sorted."""

    extras: list
    contexts: np.ndarray

    def pairs(self) -> int:
        return sum(_lengths(x)[3] for x in self.extras)

    def requests(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of each word; context and count of each pair. By word and context, pairs of a request are sorted."""
        for x in self.extras:
            of_word, hashes, place, count = _arrays(x, np.uint32, np.uint64, np.uint32, np.uint32)
            yield of_word, np.searchsorted(self.contexts, np.cumsum(hashes, dtype=np.uint64))[place], count


def _union(sets: list[np.ndarray]) -> np.ndarray:
    """Distinct ones, sorted; np.unique would hash them, which takes more time and memory."""
    x = np.concatenate(sets)
    x.sort()
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def unpacked(extras: list) -> Asked:
    contexts, more, n = np.zeros(0, np.uint64), [], 0
    for x in extras:
        more.append(np.cumsum(_arrays(x, None, np.uint64, None, None)[1], dtype=np.uint64))
        n += len(more[-1])
        if n > max(PIECE, len(contexts)):
            contexts, more, n = _union([contexts, *more]), [], 0
    return Asked(extras, _union([contexts, *more]))


def _blobs(*arrays: np.ndarray) -> bytes:
    packed = [B.squeeze(x) for x in arrays]
    return struct.pack(f"<{2 * len(arrays)}q", *(y for x, p in zip(arrays, packed, strict=True) for y in (len(x), len(p)))) + b"".join(packed)


def _lengths(blob) -> tuple:
    """Of the four arrays that come with the words of a request."""
    return struct.unpack_from("<8q", blob)[::2]


def _arrays(blob, *kinds) -> list[np.ndarray | None]:
    """The packed arrays; those of no kind are left out."""
    head = struct.unpack_from(f"<{2 * len(kinds)}q", blob)
    at, out = 16 * len(kinds), []
    for kind, n, size in zip(kinds, head[::2], head[1::2], strict=True):
        out.append(None if kind is None else B.stretch(blob[at : at + size], n, kind))
        at += size
    return out


# ---------------------------------------------------------------- the model

class Owned(NamedTuple):
    """An owner's words with training counts: keys, and by (word, context) the customers, sorted; and its contexts' hashes."""

    part: int
    keys: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    contexts: np.ndarray = np.zeros(0, np.uint64)


def merged(part: int, keys: np.ndarray, asked: Asked, bounds: np.ndarray, piece: int = PIECE) -> Owned:
    word_keys, code = np.unique(keys, return_inverse=True)
    width = len(asked.contexts)
    most, ends = asked.pairs(), [0]
    ids, counts = np.empty(most, np.int64), np.empty(most, np.uint32)  # of pairs with counts; sorted in each request
    for (of_word, context, count), a, z in zip(asked.requests(), bounds[:-1], bounds[1:], strict=True):
        used = np.flatnonzero(count)
        ends.append(ends[-1] + len(used))
        ids[ends[-2] : ends[-1]] = (np.repeat(code[a:z], of_word) * width + context)[used]
        counts[ends[-2] : ends[-1]] = count[used]
    ids = ids[: ends[-1]]
    del code
    ranges = max(1, math.ceil(len(ids) / piece))
    sample = np.sort(ids[:: max(1, piece >> 10)])
    cuts = sample[np.arange(1, ranges) * len(sample) // ranges]
    at = [a + np.concatenate(([0], np.searchsorted(ids[a:z], cuts), [z - a])) for a, z in zip(ends[:-1], ends[1:], strict=True)]
    pairs, sums, done = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64), 0  # more than needed; the rest is never touched
    for r in range(ranges):
        found = np.concatenate([ids[x[r] : x[r + 1]] for x in at])
        order, heads = B.distinct(found)
        count = np.concatenate([counts[x[r] : x[r + 1]] for x in at]).astype(np.int64)[order]
        now, done = done, done + len(heads)
        pairs[now:done] = found[order[heads]]
        sums[now:done] = np.add.reduceat(count, heads) if len(heads) else 0
    del ids, counts
    of, count = pairs[:done], sums[:done]
    context = of % width
    of //= width
    new = np.ones(done, bool)
    np.not_equal(of[1:], of[:-1], out=new[1:])
    known = word_keys[of[new]]
    np.cumsum(new, out=of)
    of -= 1
    return Owned(part, known, of, context, count, asked.contexts)


def summed(g: B.Gathered) -> list[bytes]:
    """An owner of contexts adds up what the owners of words sent, context by context."""
    sent = np.concatenate([B.stretch(x, n, np.int64) for x, n in zip(g.extras, np.diff(g.bounds), strict=True)])
    keys, code = np.unique(g.keys, return_inverse=True)
    sums = np.bincount(code, weights=sent, minlength=len(keys)).astype(np.int64)[code]
    return [B.squeeze(sums[a:z]) for a, z in zip(g.bounds[:-1], g.bounds[1:], strict=True)]


class Totals(NamedTuple):
    """What restaurants share: discounts, customers and tables of an owner's contexts, and of the parent."""

    discount: float
    parent_discount: float
    vocabulary: int
    customers: np.ndarray
    tables: np.ndarray
    parent_customers: int
    parent_tables: int


def stirling(discount: float, most: int = STIRLING) -> np.ndarray:
    """log S(n, t): S(n + 1, t) = S(n, t - 1) + (n - discount * t) * S(n, t)."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(1, most):
            stay = np.where(t <= n, np.log(np.maximum(n - discount * t, 1e-300)) + s[n, 1:], -np.inf)
            s[n + 1, 1:] = np.logaddexp(stay, s[n, :-1])
    return s


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draw the number of tables of each dish, given its customers and the weight of a new table."""
    tables = np.minimum(customers, 1)
    small = np.flatnonzero((customers > 1) & (customers <= STIRLING))
    order = small[np.argsort(customers[small], kind="stable")]
    heads = np.searchsorted(customers[order], np.arange(2, STIRLING + 2))
    for n, a, z in zip(range(2, STIRLING + 1), heads[:-1], heads[1:], strict=True):
        for at in np.array_split(order[a:z], max(1, (z - a) * n >> 17)):
            if len(at):
                law = table[n, 1 : n + 1] + np.log(weight[at])[:, None] * np.arange(1, n + 1)
                law = np.cumsum(np.exp(law - law.max(axis=1, keepdims=True)), axis=1)
                tables[at] = 1 + (rng.random(len(at))[:, None] * law[:, -1:] > law).sum(axis=1)
    large = np.flatnonzero(customers > STIRLING)
    if len(large):
        n, x = customers[large], weight[large]
        low, high = np.full(len(large), -700.0), np.zeros(len(large))
        for _ in range(60):  # the saddle point: x * u ** (d - 1) * (1 - u) = n
            mid = (low + high) / 2
            short = np.log(x) + (discount - 1) * mid + np.log1p(-np.exp(mid)) < np.log(n)
            high, low = np.where(short, mid, high), np.where(short, low, mid)
        u = np.exp(high)
        mean = x * (1 - u**discount) / discount
        spread = n + (1 - u) ** 2 * x * (1 - discount) * u ** (discount - 2)
        share = np.clip(n.astype(float) ** 2 / spread / np.maximum(mean, 1e-12), 0, 0.999)
        trials = np.maximum(1, np.round(mean / np.maximum(share, 1e-12)))
        few = share < 0.01
        drawn = np.where(few, rng.poisson(mean), rng.binomial(np.where(few, 1, trials).astype(np.int64), np.clip(np.where(few, 0, mean / trials), 0, 1)))
        tables[large] = np.minimum(1 + drawn, n)
    return tables


def sweeps(own: Owned, history: list[Totals], seed: int, first: int = 0, start: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sweeps from ``first`` on, whose totals are known, from the tables and parent tables at their start; yields tables, parent customers and parent tables after each."""
    words = len(own.keys)
    tables, at_parent = (np.minimum(own.count, 1), np.ones(words, np.int64)) if start is None else start
    for k, totals in enumerate(history, first):
        rng = np.random.Generator(np.random.PCG64([seed, k, own.part]))
        new_parent = (STRENGTH + totals.parent_discount * totals.parent_tables) / (totals.vocabulary + 1)
        served = np.bincount(own.word, weights=tables, minlength=words)
        share = (served - totals.parent_discount * at_parent + new_parent) / (STRENGTH + totals.parent_customers)
        weight = (STRENGTH + totals.discount * totals.tables[own.context]) * share[own.word]
        tables = seat(own.count, weight, totals.discount, stirling(totals.discount), rng)
        served = np.bincount(own.word, weights=tables, minlength=words).astype(np.int64)
        at_parent = seat(served, np.full(words, new_parent), totals.parent_discount, stirling(totals.parent_discount), rng)
        yield tables, served, at_parent


class Sample(NamedTuple):
    """Seats after a sweep and the totals of these very seats, so that the probabilities of all words add up to one."""

    totals: Totals
    tables: np.ndarray
    served: np.ndarray
    at_parent: np.ndarray


def answers_of(own: Owned, keys: np.ndarray, asked: Asked, bounds: np.ndarray, kept: list[Sample]) -> Iterator[bytes]:
    """For each request: its words' training counts, and log10 of the mean probability of each pair that it asks about."""
    width, none = len(own.contexts), np.zeros(0, np.int64)
    pair_id = own.word * width + own.context
    total = np.bincount(own.word, weights=own.count, minlength=len(own.keys)).astype(np.uint32)
    own = own._replace(word=none, context=none)
    for (of_word, context, _), a, z in zip(asked.requests(), bounds[:-1], bounds[1:], strict=True):
        mine = keys[a:z]
        place = np.minimum(np.searchsorted(own.keys, mine), max(0, len(own.keys) - 1))
        known = own.keys[place] == mine if len(own.keys) else np.zeros(len(mine), bool)
        word_at = np.repeat(np.arange(len(mine)), of_word)
        ask_id = place[word_at] * width + context
        at = np.minimum(np.searchsorted(pair_id, ask_id), max(0, len(pair_id) - 1))
        seen = np.flatnonzero(known[word_at] & (pair_id[at] == ask_id)) if len(pair_id) else none
        at, word = at[seen], place[known]
        mean = np.zeros(len(ask_id))
        for t, tables, served, at_parent in kept:
            share = np.full(len(mine), (STRENGTH + t.parent_discount * t.parent_tables) / (t.vocabulary + 1))
            share[known] += served[word] - t.parent_discount * at_parent[word]
            p = (STRENGTH + t.discount * t.tables[context]) * share[word_at] / (STRENGTH + t.parent_customers)
            p[seen] += own.count[at] - t.discount * tables[at]
            mean += p / (STRENGTH + t.customers[context]) / len(kept)
        counts = np.zeros(len(mine), np.uint32)
        counts[known] = total[word]
        yield _blobs(counts, np.log10(np.maximum(mean, 1e-300)).astype(np.float32))


def score(docs: DataFrame, folds: int = 7, fold: int = 2, burn_in: int = 2, samples: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Train on all documents but those of the held-out fold of crc32(id as text), score every document.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10 probabilities of the words and the end). A null text is an
    empty one: its end is its one token. Null ids fold as the empty text. Rows
    that repeat are rows of their own, each counted. Without training tokens
    both scores are 0. An empty table gives an empty result. Words are told
    apart by 64-bit hashes. Other columns are not read.
    """
    table, parts = B.block_table(docs, id_col, text_col, block_bytes)

    def ask(block: B.Block) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(block)
        pairs = _pairs(tokens)
        train = np.repeat(~_held_out(block, folds, fold), np.diff(tokens.first))
        count = np.bincount(pairs.of_token[train], minlength=len(pairs.context)).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum(pairs.of_word)))
        yield from B.requests(block.block, pairs.keys, parts, functools.partial(_packed, pairs, count, at))

    def gather(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Asked]:
        """The order of an owner's requests, by block, and what they hold."""
        order = np.argsort(np.array(group.column("block")), kind="stable")
        n = np.array(group.column("n"))[order]
        column = lambda name: (memoryview(group.column(name)[i].as_buffer()) for i in order.tolist())
        keys = np.concatenate([B.stretch_keys(x, k) for x, k in zip(column("keys"), n.tolist(), strict=True)])
        return order, keys, np.concatenate(([0], np.cumsum(n))), unpacked(list(column("extra")))

    def rows_of(own: Owned, kind: int, by_context: np.ndarray) -> list[pa.RecordBatch]:
        """An owner's numbers for the owners of its contexts; those of kind 1 go to owners of their own."""
        sent = by_context.astype(np.int64)
        found = [pa.Table.from_batches([x]) for x in B.requests(own.part, own.contexts, parts, lambda a, z: B.squeeze(sent[a:z]))]
        return [x.set_column(0, "part", pa.array(np.array(x.column("part"), np.int32) + np.int32(kind * parts), pa.int32())).append_column("sums", pa.nulls(x.num_rows, pa.list_(pa.int64()))) for x in found]

    def kept(own: Owned, extra: bytes, sums: list) -> pa.Table:
        return pa.table({"part": pa.array([MODEL], pa.int32()), "block": pa.array([own.part], pa.int64()), "n": pa.array([len(own.keys)], pa.int32()), "keys": pa.array([b""], pa.binary()), "extra": pa.array([extra], pa.binary()), "sums": pa.array([[int(x) for x in sums]], pa.list_(pa.int64()))})

    def seats(own: Owned, tables: np.ndarray, served: np.ndarray, at_parent: np.ndarray) -> tuple[list, list]:
        """What an owner tells after a sweep: sums for the driver, and tables for the owners of contexts."""
        sums = [served.sum(), at_parent.sum(), (served == 1).sum(), (served == 2).sum()]
        return sums, rows_of(own, 0, np.bincount(own.context, weights=tables, minlength=len(own.contexts)))

    def collect(group: pa.Table) -> pa.Table:
        _, keys, bounds, asked = gather(group)
        own = merged(group.column("part")[0].as_py(), keys, asked, bounds)
        del keys, asked
        B.trim()
        model = _blobs(own.keys, own.word.astype(np.uint32), own.context.astype(np.uint32), own.count, np.diff(own.contexts, prepend=np.uint64(0)))
        sums, rows = seats(own, np.minimum(own.count, 1), np.bincount(own.word, minlength=len(own.keys)), np.ones(len(own.keys), np.int64))
        sums += [len(own.keys), (own.count == 1).sum(), (own.count == 2).sum(), own.count.sum()]
        rows += rows_of(own, 1, np.bincount(own.context, weights=own.count, minlength=len(own.contexts)))
        B.trim()
        return pa.concat_tables([kept(own, model, sums), *rows])

    def opened(part: int, model: bytes) -> Owned:
        keys, word, context, count, contexts = _arrays(model, np.uint64, np.uint32, np.uint32, np.int64, np.uint64)
        return Owned(part, keys, word.astype(np.int64), context.astype(np.int64), count, np.cumsum(contexts, dtype=np.uint64))

    def exchanged(rows: DataFrame, sweep: int) -> DataFrame:
        """The sums of all owners for each owner, and its own seats after the sweep: (owner, sweep, kind, blob)."""
        found = B.answered(rows.where(F.col("part") != MODEL).drop("sums"), summed)
        found = found.select(F.col("block").cast("int").alias("owner"), F.lit(sweep).alias("sweep"), F.col("part").alias("kind"), F.col("answer").alias("blob"))
        if sweep:
            stays = rows.where(F.col("part") == MODEL)
            found = found.unionByName(stays.select(F.col("block").cast("int").alias("owner"), F.lit(sweep).alias("sweep"), F.lit(SEATS).alias("kind"), F.col("extra").alias("blob")))
        return written(found, block_mb=16)

    def since(shared: DataFrame, sweep: int) -> DataFrame:
        """What owners get again: customers, and what was shared after this sweep or later ones."""
        return shared.where((F.col("sweep") >= sweep) | (F.col("sweep") == 0) & (F.col("kind") >= parts))

    def discount(one: int, two: int) -> float:
        return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5

    def added(rows: DataFrame, names: str) -> dict[str, int]:
        """Sums over all owners; the driver gets one number of each kind."""
        row = rows.where(F.col("part") == MODEL).agg(*[F.sum(F.col("sums")[i]) for i in range(len(names.split()))]).first()
        return dict(zip(names.split(), (x or 0 for x in row), strict=True))

    def known_of(own: Owned, right: pa.Table, scalars: list[tuple], after: range) -> tuple[list[Totals], list]:
        """The totals after these sweeps, at an owner's contexts, and its tables and parent tables (none after sweep 0: it has not been seated)."""
        at = zip(right.column("sweep").to_pylist(), right.column("kind").to_pylist(), strict=True)
        place = {(k, *((kind,) if kind < 0 else divmod(kind, parts))): i for i, (k, kind) in enumerate(at)}
        blob = lambda i: memoryview(right.column("blob")[i].as_buffer())

        def sums(sweep: int, kind: int) -> np.ndarray:
            mine = {(kind, x[2]): blob(i) for x, i in place.items() if x[:2] == (sweep, kind) and len(x) > 2}
            return B.aligned(own.contexts, parts, mine, kind, np.int64).astype(np.float64)

        customers, totals, seated = sums(0, 1), [], []
        for k in after:
            parent, c, t = scalars[k]
            totals.append(Totals(lower, parent, words, customers, sums(k, 0), c, t))
            seated.append(_arrays(blob(place[k, SEATS]), np.uint32, np.uint32) if k else None)
        return totals, seated

    spark = docs.sparkSession
    wanted = B.asked(table, ask)  # made twice: it is larger than the blocks
    folder = shared_folder(spark)
    rows = written(wanted.groupBy("part").applyInArrow(collect, ROWS), folder, block_mb=16)
    models = written(rows.where(F.col("part") == MODEL).select(F.col("block").cast("int").alias("owner"), F.lit(0).alias("sweep"), F.col("part").alias("kind"), F.col("extra").alias("blob")), block_mb=16)
    found = added(rows, "c t p1 p2 v s1 s2 n")
    lower, words, train_tokens = discount(found["s1"], found["s2"]), found["v"], found["n"]
    scalars, shared = [], None
    while True:
        scalars.append((discount(found["p1"], found["p2"]), found["c"], found["t"]))
        totals = exchanged(rows, len(scalars) - 1)
        remove_folder(spark, folder)
        shared = totals if shared is None else shared.unionByName(totals)
        if len(scalars) > burn_in + samples:
            break

        def swept(group: pa.Table) -> pa.Table:
            model = group.filter(pc.equal(group.column("kind"), MODEL))
            own = opened(model.column("owner")[0].as_py(), memoryview(model.column("blob")[0].as_buffer()))
            last = len(scalars) - 1
            totals, (start,) = known_of(own, group, scalars, range(last, last + 1))
            ((tables, served, at_parent),) = sweeps(own, totals, seed, last, start and tuple(x.astype(np.int64) for x in start))
            sums, out = seats(own, tables, served, at_parent)
            state = _blobs(tables.astype(np.uint32), at_parent.astype(np.uint32))
            B.trim()
            return pa.concat_tables([kept(own, state, sums), *out])

        folder = shared_folder(spark)
        rows = written(models.unionByName(since(shared, len(scalars) - 1)).groupBy("owner").applyInArrow(swept, ROWS), folder, block_mb=16)
        found = added(rows, "c t p1 p2")

    def answer(group: pa.Table, right: pa.Table) -> pa.Table:
        order, keys, bounds, asked = gather(group)
        own = merged(group.column("part")[0].as_py(), keys, asked, bounds)
        B.trim()
        sampled = zip(*known_of(own, right, scalars, range(burn_in + 1, burn_in + samples + 1)), strict=True)
        kept = [Sample(totals, tables, np.bincount(own.word, weights=tables, minlength=len(own.keys)).astype(np.int64), at_parent) for totals, (tables, at_parent) in sampled]
        found = answers_of(own, keys, asked, bounds, kept)
        del own, keys, asked, kept
        blobs = pa.array(found, pa.binary())
        blocks, part = group.column("block").take(pa.array(order)), group.column("part")
        del found
        B.trim()
        return pa.table({"block": blocks, "part": part, "answer": blobs})

    def finish(block: B.Block, blobs: dict) -> pa.Table:
        tokens = tokens_of(block)
        pairs = _pairs(tokens)
        got = [_arrays(x, np.uint32, np.float32) for _, x in sorted(blobs.items())]
        count = np.concatenate([c for c, _ in got]).astype(np.float64)
        logs = np.concatenate([x for _, x in got]).astype(np.float64)
        base = np.log10((count + 1) / (train_tokens + words + 1))[pairs.word_of_pair]
        first = tokens.first[:-1]
        by_doc = lambda x: np.add.reduceat(x[pairs.of_token], first)
        return pa.table({
            "doc_id": pa.array(block.ids, pa.int64(), mask=block.ids == B.NO_ID), "held_out": pa.array(_held_out(block, folds, fold)),
            "n_tokens": pa.array(np.diff(tokens.first), pa.int64()), "n_known": pa.array(by_doc((count > 0)[pairs.word_of_pair].astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(block.ids), train_tokens), pa.int64()), "base_score": pa.array(by_doc(base)), "score": pa.array(by_doc(logs)),
        })

    answers = written(wanted.groupBy("part").cogroup(since(shared, burn_in + 1).groupBy("owner")).applyInArrow(answer, B.ANSWER_SCHEMA), block_mb=16)
    return B.with_answers(table, answers, finish, RESULT)
