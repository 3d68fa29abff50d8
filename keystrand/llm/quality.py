"""Quality classifier by positive-unlabelled learning.

A score f(x) = w . phi(x) is fitted by the non-negative unbiased risk: with
class prior p, trusted positives P and unlabelled text U,

    p * R(P, +) + max(0, R(U, -) - p * R(P, -)),

where R is the mean squared loss (1 - y f) ** 2 / 4. When the second term would
fall below zero (f begins to call trusted positives negative where only
unlabelled ones are), the step goes against it instead. With this loss the
risks are quadratic in w, so that sums of phi and of its products over all rows
of P and U are all that is needed of them: nothing is sampled, and tasks send
one matrix each. phi(x) holds the shares of kinds of characters and words, how
much repeats, hashed words, and random ridge functions of the former.

The class prior is estimated from P and U alone: a first fit tells P from U,
and the prior is the smallest ratio, over thresholds, of the shares of U and of
(other) positives above it, with the confidence term of the best-bin estimate
(Garg, Wu, Smola, Balakrishnan, Lipton: Mixture proportion estimation and PU
learning, 2021). Labelled negatives serve for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import blocks as B
from .shared import fold_of, written

PASS_SCORE = 0.3
RIDGES = 160
#: Hashed words fall into so many cells.
CELLS = 64
#: The penalty on w: the less of it, the more positives there are.
RIDGE, SHRINK = 1e-3, 20.0
STEPS = 400
BINS = 1024
UNLABELLED, TRUSTED, OTHER = 0, 1, 2  # kinds of rows that teach; the positives are halved for the prior

_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = 1
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 5
_CLASS[(_CLASS == 0) & (np.arange(256) < 128)] = 6  # other symbols and controls


def _per(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(1, of)


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each document has."""
    keys = keys.copy()
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        keys[a:z].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n)


def features(block: B.Block) -> np.ndarray:
    """Of each text: shares of kinds of characters and words, how much repeats, and the shares of its words by hash cell."""
    n, size = len(block.ids), np.diff(block.bounds)
    kind = _CLASS[block.data]
    count = np.zeros((7, n))
    for k in range(1, 7):
        count[k] = np.diff(np.concatenate(([0], np.cumsum(kind == k)))[block.bounds])
    lines = np.diff(np.concatenate(([0], np.cumsum(block.data == 10)))[block.bounds])
    words = B.words_of(block, lower=True)
    doc, number, length = words.doc(), np.diff(words.first), words.ends - words.starts
    share = lambda x: _per(np.bincount(doc[x], minlength=n), number)
    last = kind[words.ends - 1] if len(length) else kind
    first = kind[words.starts] if len(length) else kind
    again = np.zeros(len(length), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    at = np.flatnonzero(B.windows(words, 3))
    threes = _distinct(B.rolling(words.hashes, 3)[at], doc[at], n)
    letters = count[1] + count[2]
    cell = (words.hashes >> np.uint64(64 - (CELLS - 1).bit_length())).astype(np.int64)
    lexical = np.sqrt(np.bincount(doc * np.int64(CELLS) + cell, minlength=n * CELLS).reshape(n, CELLS) / np.maximum(1, number)[:, None])
    return np.column_stack([
        np.log1p(size) / 10, np.log1p(number) / 10, _per(letters, size), _per(count[2], letters), _per(count[3], size), _per(count[4], size),
        np.sqrt(_per(count[5], size)), np.sqrt(_per(count[6], size)),
        np.log1p(_per(np.bincount(doc, weights=length, minlength=n), number)) / 3, share(length <= 3), share(length >= 12),
        share(last == 5), share(last == 6), share(first == 2), share(first == 6), share(again),
        _per(_distinct(words.hashes, doc, n), number), _per(threes, np.maximum(0, number - 2)), np.sqrt(_per(lines, number)), (size == 0).astype(float), lexical,
    ])


STYLE = 20


class Basis:
    """phi: the features as they are (standardised), a constant, and tanh of random projections of those that are no hashed words."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, ridges: int = RIDGES, seed: int = 23) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        style = min(STYLE, len(mean))
        self.mean, self.scale, self.style = mean, scale, style
        self.a, self.b = rng.normal(0, 1.5 / style**0.5, (style, ridges)), rng.uniform(-2, 2, ridges)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate((np.ones((len(z), 1)), z / 5, np.tanh(z[:, : self.style] @ self.a + self.b)), axis=1)


class Moments(NamedTuple):
    """Of one kind of rows: their number, the mean of phi, and of its products."""

    n: float
    m: np.ndarray
    a: np.ndarray


def moments(phi: np.ndarray) -> Moments:
    return Moments(len(phi), phi.mean(axis=0), phi.T @ phi / len(phi))


def together(p: Moments, q: Moments) -> Moments:
    n = p.n + q.n
    return Moments(n, (p.n * p.m + q.n * q.m) / n, (p.n * p.a + q.n * q.a) / n)


def risk(w: np.ndarray, p: Moments, y: int) -> tuple[float, np.ndarray]:
    """Mean of (1 - y w . phi) ** 2 / 4 over the rows of ``p``, and its gradient."""
    return (1 - 2 * y * w @ p.m + w @ p.a @ w) / 4, (p.a @ w - y * p.m) / 2


def prior_of(above_u: np.ndarray, above_p: np.ndarray, n_u: float, n_p: float, slack: float = 0.01, doubt: float = 0.1) -> float:
    """The best-bin estimate, from the shares of unlabelled rows and of positives at or above each threshold."""
    some = above_p > 0
    q_u, q_p = above_u[some], above_p[some]
    margin = (np.log(4 / doubt) / 2 / n_u) ** 0.5 + (np.log(4 / doubt) / 2 / n_p) ** 0.5
    at = np.argmin(q_u / q_p + (1 + slack) / q_p * margin)
    return float(min(0.98, max(0.02, q_u[at] / q_p[at])))


def penalty(p: Moments) -> np.ndarray:
    """A ridge; the constant is free."""
    return (RIDGE + SHRINK / p.n) * np.diag([1e-6] + [1.0] * (len(p.m) - 1))


def told_apart(p: Moments, u: Moments) -> np.ndarray:
    """A least-squares fit that tells positives from unlabelled rows."""
    return np.linalg.solve(p.a + u.a + penalty(p), p.m - u.m)


def train(p: Moments, u: Moments, prior: float, steps: int = STEPS) -> np.ndarray:
    """Minimise the non-negative risk: from the least unbiased risk on, by steps that go against the second term where it is negative."""
    ridge = penalty(p)
    w = np.linalg.solve(u.a + ridge, 2 * prior * p.m - u.m)  # p R(P, +) - p R(P, -) is linear in w
    rate = 1 / (np.linalg.eigvalsh(u.a + prior * p.a + ridge)[-1])
    for _ in range(steps):
        (plus, up), (minus, down), (unlabelled, side) = risk(w, p, 1), risk(w, p, -1), risk(w, u, -1)
        if unlabelled - prior * minus < 0:
            w = w + rate * (side - prior * down)
        else:
            w = w - rate * (prior * up + side - prior * down + ridge @ w / 2)
    return w


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 1024, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, B.Block]]:
    """Batches of (id, text, ...) as blocks of some MB in memory."""
    for whole in batches:
        lens = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in whole.column(1).cast(pa.large_binary())], np.int64)
        at = 0
        while at < whole.num_rows:
            room = np.searchsorted(np.cumsum(lens[at : at + rows]), most) + 1
            part = whole.slice(at, min(room, rows))
            texts = part.column(1).cast(pa.large_binary()).to_pylist()
            size = lens[at : at + part.num_rows]
            yield part, B.Block(0, np.zeros(len(texts), np.int64), np.concatenate(([0], np.cumsum(size))), np.frombuffer(b"".join(x or b"" for x in texts), np.uint8), np.array([x is None for x in texts]))
            at += part.num_rows


class Scorer(NamedTuple):
    basis: Basis
    w: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """f from -1 and 1 to 0 and 1."""
        return np.clip((1 + self.basis(x) @ self.w) / 2, 0, 1)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    raw = batch.column(name)
    return np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64)


def _added(rows: DataFrame, per_task) -> dict[int, np.ndarray]:
    """Sums over all rows of what ``per_task`` makes of batches: {kind: matrix}; a task sends each row of its sums once, and owners of rows add them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for kind, x in per_task(batch).items():
                total[kind] = total[kind] + x if kind in total else x
        task = TaskContext.get().partitionId()
        for kind, x in total.items():
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(x), pa.int32()), "i": pa.array(range(len(x)), pa.int32()), "task": pa.array([task] * len(x), pa.int32()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")  # so that reruns agree to the last bit
        x = np.array(group.column("x").to_pylist()).sum(axis=0)
        return pa.table({"kind": group.column("kind").slice(0, 1), "i": group.column("i").slice(0, 1), "x": pa.array([x.tolist()], pa.list_(pa.float64()))})

    got = rows.mapInArrow(run, "kind int, i int, task int, x array<double>").groupBy("kind", "i").applyInArrow(add, "kind int, i int, x array<double>").collect()  # the rows of one matrix a kind
    return {k: np.array([r["x"] for r in sorted((r for r in got if r["kind"] == k), key=lambda r: r["i"])]) for k in {r["kind"] for r in got}}


def fitted(rows: DataFrame) -> Scorer | None:
    """Fit on rows (kind, x): unlabelled text and two halves of trusted positives. None if either is missing."""

    def squares(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x = _matrix(batch, "x")
        return {0: np.array([np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])} if len(x) else {}

    got = _added(rows, squares)
    if not got:
        return None
    n, total, square = got[0]
    mean = total / n
    basis = Basis(mean, np.sqrt(np.maximum(0, square / n - mean * mean)) + 1e-3)

    def products(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        kind, phi = np.array(batch.column("kind")), basis(_matrix(batch, "x"))
        # the first column of phi is 1, so the first row has the number and sums
        return {k: phi[kind == k].T @ phi[kind == k] for k in np.unique(kind).tolist()}

    sums = _added(rows, products)
    by = {k: Moments(x[0, 0], x[0] / x[0, 0], x / x[0, 0]) for k, x in sums.items()}
    positive = [by[k] for k in (TRUSTED, OTHER) if k in by]
    if not positive or UNLABELLED not in by:
        return None
    g = told_apart(positive[0], by[UNLABELLED])

    def histogram(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        kind, z = np.array(batch.column("kind")), basis(_matrix(batch, "x")) @ g
        cell = np.clip((z + 2) / 4 * BINS, 0, BINS - 1).astype(int)
        return {k: np.bincount(cell[kind == k], minlength=BINS)[None, :].astype(float) for k in np.unique(kind).tolist()}

    bins = _added(rows, histogram)
    of_p = bins[OTHER if OTHER in by else TRUSTED][0]
    above = lambda x: np.cumsum(x[::-1])[::-1] / x.sum()
    prior = prior_of(above(bins[UNLABELLED][0]), above(of_p), by[UNLABELLED].n, of_p.sum())
    p = together(*positive) if len(positive) > 1 else positive[0]
    return Scorer(basis, train(p, by[UNLABELLED], prior))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """Score every text; returns doc_id, held_out, score (0 to 1), predicted.

    ``labels`` has ids and qualities (0 or 1); an id with both is no trusted
    positive. Labels of the held-out fold of crc32(id as text) are not used; all
    texts outside it are the unlabelled ones. A null text counts as empty, which
    has features of its own. Without positive labels in the training folds the
    score is 0.5 everywhere. Rows that repeat, and null ids (which fold as the
    empty text and have no label), are rows of their own. An empty table gives
    an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(quality_col).alias("quality"))
    good = marks.where((fold_of("doc_id", folds) != fold) & (F.col("quality") == 1)).select("doc_id", F.lit(True).alias("good"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches):
            x = features(block).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])
        B.trim()

    # measured once: a third of a kilobyte for each text
    rows = written(texts.mapInArrow(measure, "doc_id long, x binary"), block_mb=16)
    learn = rows.where(fold_of("doc_id", folds) != fold)
    half = F.when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0, TRUSTED).otherwise(OTHER)
    trusted = learn.join(good, "doc_id", "left_semi").select(half.cast("int").alias("kind"), "x")
    model = fitted(written(learn.select(F.lit(UNLABELLED).cast("int").alias("kind"), "x").unionByName(trusted), block_mb=16)) if good.limit(1).count() else None
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = sent.value
        for batch in batches:
            got = scores(_matrix(batch, "x")) if scores and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    found = rows.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", (fold_of("doc_id", folds) == fold).alias("held_out"), "score", (F.col("score") >= PASS_SCORE).cast("int").alias("predicted"))
