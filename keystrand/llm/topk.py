"""Exact top-k search by distributed histogram selection.

Queries come in blocks of bounded size. For each block, every candidate is
scored in each round; a round's histogram over the current interval of each
query tells which bin holds its k-th highest score, and the next round looks at
that bin only, until it is one value wide. Then the scores at or above that
value are kept, and ties fall to the smaller id.

A task need only report the bins from its own k-th highest score upwards: the
k-th highest of all is no lower. So it sends at most k bins for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import shared_folder, written

#: Queries in a block: with 64 dimensions, 1 MB are sent to each executor.
QUERY_BLOCK = 2048
BINS = 1 << 10
SCALE = 256
LEAST, GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Vectors with a component above this are scored apart from the others.
LARGE = float(1 << 16)
_TOP = np.uint64(1 << 63)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, dim): vectors that are null, empty, or hold null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN is above infinity
    return vectors.where(fine & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.size(vector_col).alias("dim"))


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): exact in float64, a power of two apart; as Python integers (of any size) where a component is too large for it."""
    if np.abs(x).max(initial=0) < 2.0**62 / SCALE:
        return np.floor(SCALE * x)
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**52 else int(np.floor(SCALE * v)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products (candidate by query) as int64, exact; one beyond int64 stands at its end (LEAST + 1 or GREATEST)."""
    reach = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if reach < 1 << 53:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    if reach < 1 << 62:
        return x.astype(np.int64) @ q.T.astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(x) @ whole(q).T, LEAST + 1, GREATEST).astype(np.int64)


def _scores(batch: pa.RecordBatch, queries: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a batch (and whether they are null), and scores (candidate by query) as int64; a query's own row scores the least int64.

    Rows with large components are multiplied apart, so that they do not slow the others down.
    """
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    own = batch.column(0)
    null = own.is_null().to_numpy(zero_copy_only=False)
    key = own.fill_null(0).to_numpy(zero_copy_only=False)
    scores = np.empty((len(x), len(queries)), np.int64)
    wide = [np.abs(m).max(axis=1, initial=0) >= LARGE for m in (x * 1.0, queries)]
    for rows in (wide[0], ~wide[0]):
        for asked in (wide[1], ~wide[1]):
            if rows.any() and asked.any():
                scores[np.ix_(rows, asked)] = products(scaled(x[rows]), scaled(queries[asked]))
    scores[(key[:, None] == ids[None, :]) & ~null[:, None]] = LEAST
    return key, null, scores


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _best(kept: np.ndarray, k: int) -> np.ndarray:
    return np.partition(kept, len(kept) - k, axis=0)[len(kept) - k :] if len(kept) > k else kept


def _place(scores: np.ndarray) -> np.ndarray:
    """Signed scores as unsigned numbers in the same order, so that differences always fit."""
    return scores.view(np.uint64) ^ _TOP


def _select(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, norm: float) -> np.ndarray:
    """The k-th highest score of each query, or the least int64 if it has fewer candidates; ``norm``: the longest candidate's length."""
    spark = rows.sparkSession
    reach = np.sqrt(((np.abs(queries.astype(np.float64)) + 1) ** 2).sum(axis=1)) * SCALE
    with np.errstate(over="ignore"):
        high = np.array([int(min(float(GREATEST) // 2, x)) for x in reach * norm * 1.0001 + 2], object)  # Cauchy-Schwarz: no score is beyond
    wide = np.array([x >= GREATEST // 4 for x in high])
    low = np.array([0 if w else (1 << 63) - x for x, w in zip(high.tolist(), wide, strict=True)], np.uint64)  # in the order of _place
    width = np.array([(1 << 64) - 1 if w else 2 * x + 1 for x, w in zip(high.tolist(), wide, strict=True)], np.uint64)
    above = np.zeros(len(ids), np.int64)  # candidates with scores above the interval
    over = lambda w: np.maximum(np.uint64(1), w // np.uint64(BINS) + (w % np.uint64(BINS) > 0).astype(np.uint64))
    step, out, done = over(width), np.full(len(ids), LEAST), np.zeros(len(ids), bool)
    sent = spark.sparkContext.broadcast((ids, queries))
    while True:
        state = spark.sparkContext.broadcast((low, step, width, done))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (own, q), (lo, st, wide, over) = sent.value, state.value
            top = np.zeros((0, len(own)), np.int64)
            full = np.zeros((BINS + 1, len(own)), np.int64)
            for batch in _slices(batches):
                _, _, scores = _scores(batch, q, own)
                place = _place(scores)
                from_low = place - lo  # wraps below the interval, and is then not inside
                inside = (place >= lo) & (from_low <= wide - np.uint64(1)) & ~over & (scores > LEAST)
                cell = np.minimum(from_low // st, np.uint64(BINS)).astype(np.int64) * len(own) + np.arange(len(own))
                full += np.bincount(cell[inside], minlength=full.size).reshape(full.shape)
                top = _best(np.concatenate((top, scores)), k)
            if len(top):
                mine = np.zeros(len(own), np.int64)
                if len(top) >= k:
                    least = _place(np.ascontiguousarray(np.partition(top, 0, axis=0)[0]))
                    mine = np.where(least >= lo, np.minimum((least - lo) // st, np.uint64(BINS)).astype(np.int64), 0)
                b, at = np.nonzero(full)
                keep = b >= mine[at]
                yield pa.RecordBatch.from_pydict({"q": pa.array(at[keep], pa.int32()), "bin": pa.array(b[keep], pa.int32()), "n": pa.array(full[b[keep], at[keep]], pa.int64())})

        # of each query, the bins from the top until k candidates are counted: at most k rows
        counted = rows.mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.col("bin").desc())
        goal = spark.createDataFrame([(i, int(k - a)) for i, a in enumerate(above)], "q int, goal long")
        run = counted.withColumn("run", F.sum("n").over(down)).join(F.broadcast(goal), "q")  # one row for each query of the block
        hit = run.where(F.col("run") >= F.col("goal")).groupBy("q").agg(F.max_by(F.struct("bin", "n", "run"), "bin").alias("at")).select("q", "at.*").collect()
        state.unpersist()
        found = np.zeros(len(ids), bool)
        for r in hit:
            found[r["q"]] = True
            low[r["q"]] += np.uint64(r["bin"]) * step[r["q"]]
            above[r["q"]] += r["run"] - r["n"]
        width = np.where(found, step, width)
        narrow = found & (width <= 1)
        out[narrow] = (low[narrow] ^ _TOP).view(np.int64)
        done |= narrow | ~found  # a query without so many candidates takes all
        if done.all():
            sent.unpersist()
            return out
        step = over(width)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of ``vectors`` with the highest integer inner product for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score. Candidates are all rows but
    those with the query's own id; a query with fewer gets all. Only vectors of
    one length are compared. Ties go to the smaller id, null ids last among
    candidates; null ids ask nothing. Rows that repeat an id with one vector ask
    once, and are candidates each. Vectors that are null, empty, or hold null or
    non-finite components take no part; all others do, however large: scores are
    exact integers, and one of the k highest that does not fit in 64 bits is an
    error. Empty tables give an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    folder, schema, n = shared_folder(spark), "query_id long, rank int, vec_id long, score long", 0
    asking = written(usable(queries, id_col, vector_col).where("id is not null").distinct())
    everything = written(usable(vectors, id_col, vector_col), block_mb=16)  # each round scans it
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (F.abs(v) + 1) * (F.abs(v) + 1)))
    norms = {r["dim"]: r["norm"] for r in everything.groupBy("dim").agg(F.max(length).alias("norm")).collect()}  # one row for each length of vectors
    for dim in sorted(r["dim"] for r in asking.select("dim").distinct().collect()):
        rows = everything.where(F.col("dim") == dim).select("id", "x")
        block: list = []

        def run(block: list) -> DataFrame:
            ids, q = np.array([r["id"] for r in block], np.int64), np.array([r["x"] for r in block], np.float64)
            kth = _select(rows, ids, q, k, norms.get(dim, 0.0) * SCALE)
            sent = spark.sparkContext.broadcast((ids, q, kth))

            def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own, qs, least = sent.value
                best: dict[int, list] = {}
                for batch in _slices(batches):
                    key, null, scores = _scores(batch, qs, own)
                    i, at = np.nonzero((scores >= least) & (scores > LEAST))
                    for a, b in zip(i.tolist(), at.tolist(), strict=True):
                        best.setdefault(b, []).append((-int(scores[a, b]), bool(null[a]), int(key[a])))
                    for b, x in best.items():
                        if len(x) > k:
                            best[b] = sorted(x)[:k]
                out = [(b, -s, None if null else v) for b, x in best.items() for s, null, v in sorted(x)[:k]]
                yield pa.RecordBatch.from_pydict({"q": pa.array([x[0] for x in out], pa.int32()), "score": pa.array([x[1] for x in out], pa.int64()), "vec_id": pa.array([x[2] for x in out], pa.int64())})

            order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
            ranked = rows.mapInArrow(keep, "q int, score long, vec_id long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            fits = F.col("score").between(LEAST + 2, GREATEST - 1)
            ranked = ranked.withColumn("score", F.when(fits, F.col("score")).otherwise(F.raise_error(F.lit("a score among the highest does not fit in 64 bits")).cast("long")))
            name = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q int, query_id long")
            return ranked.join(F.broadcast(name), "q").select("query_id", "rank", "vec_id", "score")  # one row for each query of the block

        for r in asking.where(F.col("dim") == dim).orderBy("id", "x").toLocalIterator():
            block.append(r)
            if len(block) == query_block:
                written(run(block), f"{folder}/part={n}")
                block, n = [], n + 1
        if block:
            written(run(block), f"{folder}/part={n}")
            n += 1
    if not n:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/part={i}" for i in range(n)])
