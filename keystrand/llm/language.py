"""Language identification by string kernels.

The kernel of two texts is the number of distinct n-grams (bytes of the
lower-cased text, n from 1 to ``MOST``, so the blended spectrum, by presence)
that both hold, over the geometric mean of how many each holds. A sample of
labelled texts gives Nyström landmarks; on their kernel features, kernel ridge
regressions tell each language from the rest. Scoring multiplies the batch's
n-gram incidence matrix with the landmarks' incidence matrix, already
multiplied with the regressions' coefficients: (X L') A is X (L' A), and L' A
has a row for each landmark n-gram only.

The model is fitted on at most ``sample`` labelled texts. Executors find their
n-grams and their rows of the kernel matrix; the driver gets the landmarks'
n-grams and these rows, and solves the regressions. The model is the landmarks'
n-grams by languages, sent to all executors, and does not grow with the input.
Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..shipping import ship
from .blocks import trim
from .shared import columns, fold_of, fresh, written

MOST = 4
#: n-grams fall into 2 ** CELL_BITS cells by a hash.
CELL_BITS = 22
SAMPLE = 1600
LANDMARKS = 240
RIDGE = 0.1
UNKNOWN = "und"
#: Below this score :func:`accepted` takes a text to be in none of the learned languages. Half of what the
#: shortest and most broken texts of the test tables score (0.24); texts in other scripts score below 0.1.
FLOOR = 0.12
_GRAM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Grams:
    """Finds the distinct n-gram cells of a text; holds a table that is written over from text to text."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << CELL_BITS, np.int32)

    def __call__(self, text: str, piece: int = 1 << 20) -> np.ndarray:
        data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        found = [self._piece(data[a : a + piece + MOST - 1], min(piece, len(data) - a)) for a in range(0, len(data), piece)]
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def _piece(self, data: np.ndarray, starts: int) -> np.ndarray:
        cells, gram = [], np.zeros(len(data), np.uint64)
        for n in range(MOST):
            width = len(data) - n
            if width <= 0:
                break
            gram = (gram[:width] << np.uint64(8)) | data[n:]
            cells.append(((gram[: min(starts, width)] + np.uint64(n + 1)) * _GRAM[n] >> np.uint64(64 - CELL_BITS)).astype(np.int64))
        cells = np.concatenate(cells)
        at = np.arange(len(cells), dtype=np.int32)
        self.last[cells] = at
        return cells[self.last[cells] == at]


class Model:
    """Landmark n-grams by languages, and what scoring needs."""

    def __init__(self, languages: list[str], cells: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.cells, self.weights, self.bias = languages, cells, weights, bias

    def scorer(self):
        place = np.full(1 << CELL_BITS, -1, np.int32)
        place[self.cells] = np.arange(len(self.cells), dtype=np.int32)
        grams = Grams()

        def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """For each text one row: the incidence row times the weight matrix, over the text's norm; and the share of its n-grams that landmarks hold."""
            rows, norms, known = [], [], []
            for text in texts:
                cells = grams(text)
                at = place[cells]
                rows.append(at[at >= 0])
                norms.append(max(1.0, len(cells) ** 0.5))
                known.append(len(rows[-1]) / max(1, len(cells)))
            lens = np.array([len(x) for x in rows])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            sums = np.zeros((len(texts), len(self.languages)))
            heads = np.concatenate(([0], np.cumsum(lens)))
            some = np.flatnonzero(lens)
            if len(some):
                sums[some] = np.add.reduceat(self.weights[flat], heads[some], axis=0)
            return sums / np.array(norms)[:, None] + self.bias, np.array(known)

        return run


class Landmarks:
    """The landmarks' n-gram cells: for each cell of any, the landmarks that hold it."""

    def __init__(self, found: list[np.ndarray]) -> None:
        cell = np.concatenate(found) if found else np.zeros(0, np.int64)
        mark = np.repeat(np.arange(len(found)), [len(x) for x in found])
        order = np.argsort(cell, kind="stable")
        self.number, self.norms = len(found), np.array([max(1.0, len(x) ** 0.5) for x in found])
        self.cells, self.heads = np.unique(cell[order], return_index=True)
        self.marks = mark[order].astype(np.int32)
        self.ends = np.append(self.heads[1:], len(cell))

    def row(self, cells: np.ndarray) -> np.ndarray:
        """A text's kernel with each landmark."""
        at = np.minimum(np.searchsorted(self.cells, cells), max(0, len(self.cells) - 1))
        at = at[self.cells[at] == cells] if len(self.cells) else at[:0]
        lens = self.ends[at] - self.heads[at]
        places = np.repeat(self.heads[at] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        shared = np.bincount(self.marks[places], minlength=self.number)
        return shared / self.norms / max(1.0, len(cells) ** 0.5)

    def times(self, coefficients: np.ndarray) -> np.ndarray:
        """The incidence of cells by landmarks (over the landmarks' norms) times a matrix with a row for each landmark."""
        if not len(self.cells):
            return np.zeros((0, coefficients.shape[1]), np.float32)
        return np.add.reduceat((coefficients / self.norms[:, None])[self.marks], self.heads, axis=0).astype(np.float32)


def solve(landmarks: Landmarks, own: np.ndarray, kernel: np.ndarray, labels: list[str], ridge: float = RIDGE) -> Model:
    """Nyström features from the landmarks' kernel (``own``) and the sample's rows, then one ridge regression for each language."""
    languages = sorted(set(labels))
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-8 * max(1e-12, values.max(initial=0))
    root = vectors[:, keep] / np.sqrt(values[keep])  # kernel to the power -1/2 on the landmarks
    features = kernel @ root
    goal = np.array([[1.0 if y == lang else -1.0 for lang in languages] for y in labels])
    count = goal.clip(0).sum(axis=0)
    bias = np.zeros(len(languages))
    weights = np.zeros((features.shape[1], len(languages)))
    for k in range(len(languages)):  # rare languages weigh as much as frequent ones
        balance = np.where(goal[:, k] > 0, len(goal) / (2 * count[k]), len(goal) / (2 * max(1, len(goal) - count[k])))
        x = np.concatenate((features, np.ones((len(goal), 1))), axis=1)
        gram = (x * balance[:, None]).T @ x + ridge * np.diag([1.0] * features.shape[1] + [0.0])
        solved = np.linalg.lstsq(gram, (x * balance[:, None]).T @ goal[:, k], rcond=None)[0]
        weights[:, k], bias[k] = solved[:-1], solved[-1]
    return Model(languages, landmarks.cells, landmarks.times(root @ weights), bias)


def chosen(labels: list[str], landmarks: int = LANDMARKS) -> list[int]:
    """The landmarks among a sample: the first of each language, as many for each."""
    languages = sorted(set(labels))
    each = max(1, landmarks // max(1, len(languages)))
    return [i for lang in languages for i in [j for j, y in enumerate(labels) if y == lang][:each]]


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on texts in memory."""
    grams = Grams()
    found = [grams(t) for t in texts]
    marks = Landmarks([found[i] for i in chosen(labels, landmarks)])
    kernel = np.array([marks.row(x) for x in found])
    return solve(marks, kernel[chosen(labels, landmarks)], kernel, labels, ridge)


def sampled(docs: DataFrame, folds: int, fold: int, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most ``sample`` labelled texts of the training folds, evenly over languages, by a hash of text and id: (label, key, text), written.

    Texts of any length teach alike; rows that repeat teach once.
    """
    usable = docs.where((fold_of(id_col, folds) != fold) & F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    usable = usable.select(F.col(label_col).cast("string").alias("label"), F.pmod(F.xxhash64(text_col, id_col, F.lit(3)), F.lit(1 << 40)).alias("key"), F.col(text_col).alias("text"))
    sizes = usable.groupBy("label").agg(F.approx_count_distinct("key").alias("n")).collect()  # one row for each language
    each = max(2, sample // max(1, len(sizes)))
    # a hash bound lets through a few times what is wanted of each language, so that no task ranks them all
    bounds = [(r["label"], int((1 << 40) * min(1.0, (4 * each + 100) / max(1, r["n"])))) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(bounds, "label string, bound long")
    few = usable.join(F.broadcast(bounds), "label").where(F.col("key") < F.col("bound")).select("label", "key", "text").distinct()
    first = Window.partitionBy("label").orderBy("key", "text")
    return written(few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= each).drop("rank"))


def trained(docs: DataFrame, folds: int, fold: int, sample: int, id_col: str, text_col: str, label_col: str) -> Model | None:
    """Fit on a sample; texts stay with the executors."""
    spark = docs.sparkSession
    rows = sampled(docs, folds, fold, sample, id_col, text_col, label_col)
    listed = sorted(tuple(r) for r in rows.groupBy("label", "key").count().select("label", "key").collect())  # at most ``sample`` rows
    if not listed:
        return None
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(listed))
    listed = [listed[i] for i in order]
    marks = [listed[i] for i in chosen([x for x, _ in listed])]
    wanted = spark.createDataFrame(marks, "label string, key long")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for i in range(batch.num_rows):
                found = grams(batch.column(2)[i].as_py()).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"label": batch.column(0).slice(i, 1), "key": batch.column(1).slice(i, 1), "cells": pa.array([found.tobytes()], pa.binary())})

    # of each of at most LANDMARKS texts (or as many as there are languages), at most 2 ** CELL_BITS cells
    got = rows.join(F.broadcast(wanted), ["label", "key"], "left_semi").mapInArrow(cells, "label string, key long, cells binary").collect()
    by = {(r["label"], r["key"]): np.frombuffer(r["cells"], np.int32).astype(np.int64) for r in got}
    landmarks = Landmarks([by[m] for m in marks])
    sent = spark.sparkContext.broadcast(landmarks)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, to = Grams(), sent.value
        for batch in batches:
            rows = [to.row(grams(batch.column(2)[i].as_py())).tolist() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({"label": batch.column(0), "key": batch.column(1), "row": pa.array(rows, pa.list_(pa.float64()))})
        trim()

    by = {(r["label"], r["key"]): r["row"] for r in rows.mapInArrow(kernel, "label string, key long, row array<double>").collect()}  # ``sample`` times LANDMARKS numbers
    sent.unpersist()
    return solve(landmarks, np.array([by[m] for m in marks]), np.array([by[x] for x in listed]), [x for x, _ in listed])


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """All columns of ``docs``, and then held_out, lang_pred and score (0 to 1).

    Where ``docs`` has a column of such a name, the new one gets an underscore in front.

    The score is the highest regression's output, brought from -1 and 1 to 0 and
    1, times the share of the text's n-grams that the landmarks hold. The model learns from texts and labels of rows outside the held-out fold of
    crc32(id as text) only. A text that is null, or has no letter, is ``und``
    with score 0; so is every text if there is nothing to learn from. Null
    labels teach nothing. Rows that repeat are rows of their own; null ids fold
    as the empty text. An empty table gives an empty result.
    """
    return identified(docs, folds, fold, sample, id_col, text_col, label_col)[0]


def identified(docs: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> tuple[DataFrame, bool]:
    """The rows of :func:`identify`, and whether there was anything to learn from."""
    spark = docs.sparkSession
    ship(spark)
    model = trained(docs, folds, fold, sample, id_col, text_col, label_col)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    held, guess, points = (fresh(docs, x) for x in ("held_out", "lang_pred", "score"))
    rows = docs.withColumn(held, fold_of(id_col, folds) == fold)
    names = [*rows.columns, guess, points]
    plain = [f"c{i}" for i in range(len(names))]  # column names may be such as cannot be referred to
    kinds = [*(f.dataType for f in docs.schema.fields), BooleanType(), StringType(), DoubleType()]
    schema = StructType([StructField(c, kind) for c, kind in zip(plain, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, model = regex.compile(r"\p{L}"), sent.value
        scorer = model.scorer() if model else None
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                texts = batch.column(at).to_pylist()
                some = [i for i, t in enumerate(texts) if t and model and letter.search(t)]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if some:
                    got, known = scorer([texts[i] for i in some])
                    points_of = np.clip((1 + got.max(axis=1)) / 2, 0, 1) * known
                    for i, k, x in zip(some, got.argmax(axis=1).tolist(), points_of.tolist(), strict=True):
                        lang[i], score[i] = model.languages[k], x
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=plain)
        trim()

    return rows.toDF(*plain[:-2]).mapInArrow(run, schema).toDF(*names), model is not None


def accepted(docs: DataFrame, languages: list[str] | None = None, floor: float = FLOOR, label_col: str = "lang", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in a learned language (or in one of ``languages``), with their columns only; the label column gets the prediction.

    Rejected are texts without a letter, and those that score below ``floor``:
    few of their n-grams occur in any language that was learned.
    Where no label teaches anything, only texts without a letter are rejected,
    and labels stay.
    """
    found, learned = identified(docs, label_col=label_col, text_col=text_col, **how)
    if not learned:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    guess, score = (F.col(c) for c in found.columns[len(docs.columns) + 1 :])
    kept = found.where((guess.isin(languages) if languages else guess != UNKNOWN) & (score >= floor))
    return kept.withColumn(label_col, guess.cast(docs.schema[label_col].dataType)).select(*columns(docs))
