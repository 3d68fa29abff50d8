"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Two sets of sizes m <= n with Jaccard similarity of at least t share at least
ceil(t * n) members. So if each set's members are put in one common order, the
first n - ceil(t * n) + 1 of linked sets share a member. The order is by rising
document frequency, so what many documents hold comes last; members of one
document only need no posting at all. Frequencies are counted over all
documents, exactly, by the packed exchange of :mod:`.blocks`.

Equal sets are one class from the start. Classes that share a posting form
clusters; a cluster's incidence rows meet in tiles (pairs of bounded doc
blocks), where overlap counts are accumulated by n-gram, sets that have too few
shared members for their size are discarded, and links are followed depth
first, so that a tile returns its components as stars, never all pairs of a group. A
cluster too large for one tile is cut in sides by the smallest posting of each
set, so that near copies tend to share a side, and two sides meet in a tile
only if they share a posting: the other blocks of the product are zero.
Where links are counted, every pair of a tile is evaluated; a tile then returns
one number for each class besides its stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import components
from .shared import columns, fresh, looked_up, written

SETS = "row long, doc_id long, n long, sig1 long, sig2 long, postings array<long>, members binary"
#: Bytes of members in a tile's side, about; a larger cluster is cut into so many sides.
TILE_BYTES = 8 << 20


def shingle_sets(block: B.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct k-word shingles as sorted 64-bit hashes: (document, hash), by document.

    A document of 1 to k - 1 words has its whole sequence as its one shingle.
    """
    words = B.words_of(block, lower=True)
    count, doc_of = np.diff(words.first), words.doc()
    at = np.flatnonzero(B.windows(words, k))
    docs, keys = [doc_of[at]], [B.mixed_bits(B.rolling(words.hashes, k))[at]]
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            docs.append(short.astype(np.int32))
            keys.append(B.mixed_bits(B.rolling(words.hashes, m)[words.first[short]] ^ np.uint64(m)))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        doc, key = doc[order], key[order]
    bounds = np.searchsorted(doc, np.arange(len(block.ids) + 1))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        key[a:z].sort()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], key[new]


def narrowed(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The incidence of sets that may have links: sizes of all sets, and (set, member) by set."""
    size = np.array([len(x) for x in sets], np.int64)
    need = -(-percent * size // 100)
    doc = np.repeat(np.arange(len(sets)), size)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    while True:  # discard sets with too few shared members, then members that are shared no more
        shared = np.bincount(col)[col] > 1
        ample = np.bincount(doc[shared], minlength=len(sets)) >= need
        keep = shared & ample[doc]
        if keep.all():
            break
        doc, col = doc[keep], col[keep]
    return size, doc, np.unique(col, return_inverse=True)[1]


def counted(sets: list[np.ndarray], percent: int, copies: np.ndarray, side: np.ndarray | None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links, and for each set the copies of all sets that it links to.

    With sides, only sets of the other side count.
    """
    size, doc, col = narrowed(sets, percent)
    links, total = [], np.zeros(len(sets), np.int64)
    if not len(doc):
        return links, total
    rows = np.searchsorted(doc, np.arange(len(sets) + 1))
    order = np.argsort(col, kind="stable")
    listed, heads = doc[order], np.concatenate(([0], np.cumsum(np.bincount(col))))
    outside = np.diff(rows) > 0
    for seed in np.flatnonzero(outside):
        if not outside[seed]:
            continue
        outside[seed], queue = False, [int(seed)]
        while queue:
            x = queue.pop()
            mine = col[rows[x] : rows[x + 1]]
            starts, lens = heads[mine], heads[mine + 1] - heads[mine]
            at = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(int(lens.sum()))
            overlap = np.bincount(listed[at], minlength=len(sets))
            overlap[x] = 0
            near = np.flatnonzero((overlap > 0) & ((100 + percent) * overlap >= percent * (size[x] + size)))
            total[x] = copies[near if side is None else near[side[near] != side[x]]].sum()
            new = near[outside[near]]
            outside[new] = False
            queue.extend(new.tolist())
            links.extend((x, y) for y in new.tolist())
    return links, total


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted distinct members), as pairs of indices."""
    size, doc, col = narrowed(sets, percent)
    if not len(doc):
        return []
    rows = np.searchsorted(doc, np.arange(len(sets) + 1))
    outside = np.bincount(doc, minlength=len(sets)) > 0

    def columns():
        live = outside[doc]
        c, d = col[live], doc[live]
        order = np.argsort(c, kind="stable")
        return d[order], np.concatenate(([0], np.cumsum(np.bincount(c, minlength=col.max() + 1)))), int(outside.sum())

    listed, heads, fresh = columns()
    links, left = [], fresh
    for seed in np.flatnonzero(outside):
        if not outside[seed]:
            continue
        outside[seed], left, queue = False, left - 1, [seed]
        while queue and left:
            x = queue.pop()
            if left < fresh // 2:
                listed, heads, fresh = columns()
            mine = col[rows[x] : rows[x + 1]]
            starts, lens = heads[mine], heads[mine + 1] - heads[mine]
            total = int(lens.sum())
            if not total:
                continue
            at = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(total)
            overlap = np.bincount(listed[at], minlength=len(sets))
            near = np.flatnonzero(outside & (overlap > 0) & ((100 + percent) * overlap >= percent * (size[x] + size)))
            outside[near] = False
            left -= len(near)
            queue.extend(near.tolist())
            links.extend((int(x), int(y)) for y in near)
    return links


def _postings(doc: np.ndarray, key: np.ndarray, df: np.ndarray, count: np.ndarray, percent: int):
    """Members that others share, within each set's prefix."""
    prefix = count - -(-percent * count // 100) + 1
    single = np.bincount(doc[df < 2], minlength=len(count))
    many = np.flatnonzero(df > 1)
    order = many[np.lexsort((key[many], df[many], doc[many]))]
    d = doc[order]
    rank = np.arange(len(d)) - np.searchsorted(d, d)
    keep = rank < (prefix - single)[d]
    return d[keep], key[order][keep]


def tiles_of(held: DataFrame) -> DataFrame:
    """``held``: (key, side), which sides hold a posting. Returns (side, tile, apart): each side's own tile, and one for each two sides that share a posting."""
    others = held.groupBy("key").agg(F.collect_set("side").alias("others")).where(F.size("others") > 1)
    pairs = held.join(others, "key").select("side", F.explode("others").alias("other")).where("side < other").distinct()
    both = pairs.select("side", "other").unionByName(pairs.select(F.col("other").alias("side"), F.col("side").alias("other")))
    both = both.select("side", F.xxhash64(F.least("side", "other"), F.greatest("side", "other")).alias("tile"), F.lit(True).alias("apart"))
    return both.unionByName(held.select("side", F.xxhash64("side").alias("tile"), F.lit(False).alias("apart")).distinct())


def classes(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Sets, equal-set classes and their components; returns (row, doc_id, n, class, component), and n_links if counted, one row per document."""
    spark = docs.sparkSession
    table, parts = B.block_table(docs, id_col, text_col, block_bytes)

    def ask(block: B.Block) -> Iterator[pa.RecordBatch]:
        _, key = shingle_sets(block, k)
        key = np.sort(key)
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(heads, len(key))).astype(np.uint32)
        yield from B.requests(block.block, key[heads], parts, lambda a, z: B.squeeze(times[a:z]))

    def total(g: B.Gathered) -> list[bytes]:
        times = np.concatenate([B.stretch(x, n, np.uint32) for x, n in zip(g.extras, np.diff(g.bounds), strict=True)])
        order, heads = B.distinct(g.keys)
        df = np.zeros(len(order), np.uint32)
        df[order] = np.repeat(np.add.reduceat(times[order], heads), np.diff(np.append(heads, len(order))))
        return [B.squeeze(df[a:z]) for a, z in zip(g.bounds[:-1], g.bounds[1:], strict=True)]

    def finish(block: B.Block, blobs: dict) -> pa.Table:
        doc, key = shingle_sets(block, k)
        every = np.unique(key)
        df = B.aligned(every, parts, blobs, 0, np.uint32)[np.searchsorted(every, key)]
        count = np.bincount(doc, minlength=len(block.ids))
        d, postings = _postings(doc, key, df, count, percent)
        bounds, at = np.searchsorted(doc, np.arange(len(block.ids) + 1)), np.searchsorted(d, np.arange(len(block.ids) + 1))
        sums = np.concatenate(([0], np.cumsum(key, dtype=np.uint64))).astype(np.uint64)[bounds]
        other = np.concatenate(([np.uint64(0)], np.cumsum(B.mixed_bits(key * B._Q), dtype=np.uint64)))[bounds]
        has = np.diff(at) > 0
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(postings.view(np.int64)))
        return pa.table({
            "row": pa.array((np.int64(block.block) << 16) + np.arange(len(block.ids)), pa.int64()),
            "doc_id": pa.array(block.ids, pa.int64(), mask=block.ids == B.NO_ID), "n": pa.array(count, pa.int64()),
            "sig1": pa.array(np.diff(sums).view(np.int64)), "sig2": pa.array(np.diff(other).view(np.int64)),
            "postings": lists, "members": pa.array([key[a:z].tobytes() if h else None for a, z, h in zip(bounds[:-1], bounds[1:], has, strict=True)], pa.binary()),
        })

    answers = written(B.answered(B.asked(table, ask), total))
    sets = written(B.with_answers(table, answers, finish, SETS), block_mb=16)

    # rows of equal sets share the smallest row as their class; a set without members is a class of its own
    total = sets.count()
    rep = sets.where("n > 0").groupBy("sig1", "sig2", "n").agg(F.min("row").alias("class"), F.count("*").alias("copies"), F.count("*").alias("times"))
    rows = written(
        looked_up(sets.where("n > 0").select("row", "doc_id", "n", "sig1", "sig2"), rep, ["sig1", "sig2", "n"], "times", total, "row").select("row", "doc_id", "n", "class", "copies")
        .unionByName(sets.where("n = 0").select("row", "doc_id", "n", F.col("row").alias("class"), F.lit(1).cast("long").alias("copies")))
    )
    heads = rows.where("row = class").select("row")
    posted = written(sets.select("row", "postings").where(F.size("postings") > 0).join(heads, "row").select("row", F.array_min("postings").alias("anchor"), F.explode("postings").alias("key")))
    least = posted.groupBy("key").agg(F.min("row").alias("b"), F.count("*").alias("times"))
    edges = looked_up(posted.select("row", "key"), least, ["key"], "times", total, "row").where("row != b").select(F.col("row").alias("a"), "b").distinct()

    # where each set goes is settled on narrow rows; the members themselves move to their cluster only then
    clusters = components(edges).withColumnRenamed("node", "row").join(rows.where("row = class").select("row", "n", "copies"), "row").join(posted.select("row", "anchor").distinct(), "row")
    clusters = written(clusters.select("row", "root", "n", "copies", "anchor"))
    weigh = clusters.groupBy("root").agg(F.sum("n").alias("size"), F.ceil(F.sum("n") * 8 / TILE_BYTES).cast("int").alias("sides"), F.count("*").alias("times"))
    size, most = weigh.agg(F.sum("size"), F.max("sides")).first()
    buckets = max(1, -(-(size or 0) * 8 // TILE_BYTES))
    # of a cluster in one tile, the tile is its root; else every pair of sides that share a posting has one, and every side by itself
    goal, tiles = clusters.select("row", "copies", "root", F.lit(None).cast("long").alias("side")), None
    if most and most > 1:
        heap = clusters.groupBy("root", "anchor").agg(F.ceil(F.sum("n") * 8 / TILE_BYTES).cast("int").alias("pieces"), F.count("*").alias("times"))
        goal = looked_up(looked_up(clusters, weigh.drop("size"), ["root"], "times", total, "row"), heap, ["root", "anchor"], "times", total, "row")
        side = F.when(F.col("pieces") > 1, F.xxhash64("root", "anchor", F.pmod(F.xxhash64("row"), F.col("pieces")))).otherwise(F.xxhash64("root", F.pmod(F.xxhash64("anchor"), F.col("sides"))))
        goal = written(goal.withColumn("side", F.when(F.col("sides") > 1, side)).select("row", "copies", "root", "side"))
        cut = goal.where("side IS NOT NULL").select("row", "side")
        tiles = written(tiles_of(written(posted.select("row", "key").join(cut, "row").select("key", "side").distinct())))
    member = sets.where("members is not null").select("row", "members").join(goal, "row")
    whole = member.where("side IS NULL").select(F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("task"), F.xxhash64("root").alias("tile"), "row", "copies", F.lit(0).cast("long").alias("side"), F.lit(False).alias("apart"), F.lit(True).alias("whole"), "members")
    member = whole if tiles is None else whole.unionByName(member.where("side IS NOT NULL").join(tiles, "side").select(F.col("tile").alias("task"), "tile", "row", "copies", "side", "apart", F.lit(False).alias("whole"), "members"))

    def link(group: pa.Table) -> pa.Table:
        tiles = np.array(group.column("tile"))
        row, members, found = np.array(group.column("row")), group.column("members"), []
        copies, side, apart, whole = (np.array(group.column(c)) for c in ("copies", "side", "apart", "whole"))
        linked, total, final = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        order = np.lexsort((row, tiles))
        for at in np.split(order, np.flatnonzero(np.diff(tiles[order])) + 1):
            if len(at) > 1:
                sets = [np.frombuffer(members[int(i)].as_py(), np.uint64) for i in at]
                if count_links:  # two sides meet in one tile only, a side meets itself in its own tile only
                    tree, degree = counted(sets, percent, copies[at], side[at] if apart[at[0]] else None)
                    linked.append(row[at[degree > 0]])
                    total.append(degree[degree > 0])
                else:
                    tree = forest(sets, percent)
                root: dict[int, int] = {}
                for x, y in tree:  # a tree begins at its smallest row, and has x before y
                    root[y] = root.get(x, x)
                found += [(int(row[at[y]]), int(row[at[x]])) for y, x in root.items()]
                final += [bool(whole[at[0]])] * len(root)
        B.trim()
        a, b, none = np.array([x for x, _ in found], np.int64), np.array([y for _, y in found], np.int64), np.zeros(len(found), np.int64)
        own, more = np.concatenate(linked), np.concatenate(total)
        return pa.table({"a": np.concatenate((a, own)), "b": np.concatenate((b, own)), "links": np.concatenate((none, more)), "whole": np.concatenate((np.array(final, bool), np.ones(len(own), bool)))})

    # a row of a class and itself carries links of the class, in part
    links = written(member.groupBy("task").applyInArrow(link, "a long, b long, links long, whole boolean"))
    # the stars of a cluster in one tile are its components; those of several tiles are put together
    roots = links.where("whole AND a != b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if tiles is not None:
        roots = roots.unionByName(components(links.where("NOT whole").select("a", "b")))
    placed = rows.where("row = class").select("class", "copies").join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    if count_links:
        degree = links.where("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
        placed = placed.join(degree, "class", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0))).drop("links")
    placed = placed.withColumn("component", F.coalesce("root", "class")).drop("root").withColumnRenamed("copies", "times")
    placed = looked_up(rows.select("row", "doc_id", "n", "class"), written(placed), ["class"], "times", total, "row")
    return placed.select("row", "doc_id", "n", "class", "component", *(["n_links"] if count_links else []))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links); and n_links (other documents it links to), if counted.

    Documents link when 100 * |intersection| >= percent * |union| of their sets
    of k-word shingles (A-Z lower-cased). A null text, or one without words, has
    no shingles and no links; its component is itself. Rows that repeat are rows of their own, and link.
    Null ids never name a component that has another id. An empty table gives
    an empty result. Members are 64-bit hashes; other columns are not read.
    """
    found = written(classes(docs, k, percent, id_col, text_col, count_links, block_bytes))
    low = found.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("times"))
    return looked_up(found, low, ["component"], "times", found.count(), "row").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *(["n_links"] if count_links else []))


def survivors(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all columns.

    Rows that share an id (or have none) stay together if one of them stays.
    """
    key = fresh(docs, "kept_id")
    found = written(jaccard_join(docs, k, percent, id_col, text_col))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi").select(*columns(docs))
