"""Exact dedup through an extendible-hash index on shared files.

Built from DataFrame operations only. Keys are 64-bit hashes of the normalised
text; a bucket is a key prefix of a depth of its own, and the directory tells
which bucket a key is in. It doubles (looks at one more bit) as long as some
bucket of more than one key is overfull; the others keep their shorter prefix.

Every row is inserted: (key, id, text) goes to the owner task of its bucket,
which sorts each key's chain by its bytes, and compares each entry's bytes with
those of the entry before. So texts whose keys collide are told apart, and the
chain's entries get the id that stays. The index on shared files has an entry
for each inserted row, and the result is read from it. A text that very many
rows share is inserted once, with their number and smallest id, after the map
side has joined its copies; its rows look their entry up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, columns, fresh, written

#: Bytes of distinct keys' texts in a bucket. A directory has about MOST_BUCKETS entries at most: at larger inputs buckets are larger.
CAPACITY = 8 << 20
MOST_BUCKETS = 1 << 18
KEY_BITS = 64
#: Prefix bits that the directory looks at beyond what it needs at an even load, in one pass over the keys.
AHEAD = 3


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def prefix_of(key: Column, depth: Column | int) -> Column:
    """The top ``depth`` bits (0 to 63) of a 64-bit key."""
    shift = F.lit(64) - (F.lit(depth) if isinstance(depth, int) else depth)
    return F.when(shift >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, shift.cast("int")))


def directory(keys: DataFrame, capacity: int) -> dict[tuple[int, int], int]:
    """Double until no bucket of several keys is overfull; ``keys``: (key, bytes), a row for each key.

    Returns the buckets as (depth, prefix) with their bytes. A pass adds up the
    keys by prefix, some bits ahead, for the buckets that are still overfull;
    the driver gets at most 2 ** AHEAD numbers for each ``capacity`` bytes.
    """
    total = keys.agg(F.sum("bytes"), F.count("*")).first()
    buckets, open_, ahead = {}, {(0, 0): (total[0] or 0, total[1])}, AHEAD + max(0, (total[0] or 0) // capacity).bit_length()
    depth = 0
    while True:
        over = {b: x for b, x in open_.items() if x[0] > capacity and x[1] > 1 and b[0] < KEY_BITS - 1}
        buckets |= {b: x[0] for b, x in open_.items() if b not in over}
        if not over:
            return buckets
        deepest = min(KEY_BITS - 1, depth + ahead)
        rows = keys
        if depth:
            split = keys.sparkSession.createDataFrame([(b[1],) for b in over], "top long")
            rows = keys.withColumn("top", prefix_of(F.col("key"), depth)).join(F.broadcast(split), "top", "left_semi")  # fewer than total / capacity rows
        cells = {r["cell"]: (r["bytes"], r["n"]) for r in rows.groupBy(prefix_of(F.col("key"), deepest).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()}
        while over and depth < deepest:  # double
            depth += 1
            loads: dict[int, tuple[int, int]] = {}
            for cell, (size, n) in cells.items():
                at = loads.get(cell >> (deepest - depth), (0, 0))
                loads[cell >> (deepest - depth)] = at[0] + size, at[1] + n
            halves = {(depth, 2 * p + k): loads.get(2 * p + k, (0, 0)) for _, p in over for k in (0, 1)}
            over = {b: x for b, x in halves.items() if x[0] > capacity and x[1] > 1 and depth < KEY_BITS - 1}
            buckets |= {b: x[0] for b, x in halves.items() if b not in over}
            cells = {c: x for c, x in cells.items() if (depth, c >> (deepest - depth)) in over}
        open_, ahead = over, 8


class Directory:
    """Which bucket a key is in: for each depth that buckets have, its prefixes; a table of bounded size, sent to all tasks."""

    def __init__(self, docs: DataFrame, buckets: dict[tuple[int, int], int]) -> None:
        self.depths = sorted({d for d, _ in buckets})
        self.table = docs.sparkSession.createDataFrame([(d, p) for d, p in buckets], "depth int, prefix long")

    def routed(self, rows: DataFrame) -> DataFrame:
        """Add the bucket (depth, prefix) of each row's key; at most MOST_BUCKETS times a small factor of them are broadcast."""
        if len(self.depths) == 1:
            return rows.withColumn("depth", F.lit(self.depths[0])).withColumn("prefix", prefix_of(F.col("key"), self.depths[0]))
        names = [f"bucket{d}" for d in self.depths]
        for d, name in zip(self.depths, names, strict=True):
            mine = self.table.where(F.col("depth") == d).select(F.col("prefix").alias(name), F.lit(True).alias(f"in_{name}"))
            rows = rows.withColumn(name, prefix_of(F.col("key"), d)).join(F.broadcast(mine), name, "left")
        found = F.coalesce(*[F.when(F.col(f"in_{n}"), F.struct(F.lit(d).alias("depth"), F.col(n).alias("prefix"))) for d, n in zip(self.depths, names, strict=True)])
        rows = rows.withColumn("bucket", found)
        return rows.withColumn("depth", F.col("bucket.depth")).withColumn("prefix", F.col("bucket.prefix")).drop("bucket", *names, *[f"in_{n}" for n in names])


def hashed(norm: str = "norm", key_bits: int = KEY_BITS) -> Column:
    """The key: the top ``key_bits`` bits of a hash of the text (fewer than 64 make keys collide, for tests)."""
    return F.shiftleft(F.call_function("shiftrightunsigned", F.xxhash64(norm), F.lit(64 - key_bits)), 64 - key_bits) if key_bits < 64 else F.xxhash64(norm)


def indexed(docs: DataFrame, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """Build the index; returns it and the rows of shared texts that look themselves up in it.

    Index: depth, prefix, key, chain (place among the texts of a key), doc_id,
    copies (rows inserted at once), shared (whether its rows look it up), sha,
    keep_id, group_size; ordered by bucket and key. Rows: doc_id, key, sha.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).withColumn("key", hashed("norm", key_bits))
    digests = written(texts.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").cast("long").alias("bytes")))
    keys = written(digests.groupBy("key").agg(F.max("bytes").alias("bytes"), F.sum("bytes").alias("all"), F.count("*").alias("n")))
    total = keys.agg(F.sum("bytes"), F.sum("all")).first()
    capacity = capacity or max(CAPACITY, (total[0] or 0) // MOST_BUCKETS)
    buckets = directory(keys.select("key", "bytes"), capacity)
    route = Directory(docs, buckets)
    # keys whose rows together would fill a good part of a bucket: at most 16 for each bucket's capacity, and 2 * MOST_BUCKETS
    bound = max(capacity // 16, (total[1] or 0) // (2 * MOST_BUCKETS))
    hot = keys.where((F.col("n") > 1) & ((F.col("all") > bound) | (F.col("n") > max(1000, bound // 64)))).select("key", F.lit(True).alias("hot"))
    shared = F.broadcast(written(hot))
    tagged = texts.join(shared, "key", "left")
    single = tagged.where("hot IS NULL").select("key", "norm", "doc_id", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("shared"))
    # copies of a shared text meet on the map side, so that one entry a task is sent
    joined = tagged.where("hot").groupBy("key", "norm").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    entries = route.routed(single.unionByName(joined.select("key", "norm", "doc_id", "copies", F.lit(True).alias("shared"))))
    # an owner has whole buckets: each key's chain in the order of its bytes, an entry being new where its bytes differ from those before
    chain = Window.partitionBy("depth", "prefix", "key").orderBy("norm", F.col("doc_id").asc_nulls_last())
    owned = entries.repartition("depth", "prefix").withColumn("new", F.coalesce(F.col("norm") != F.lag("norm").over(chain), F.lit(True)).cast("int"))
    owned = owned.withColumn("chain", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    owned = owned.withColumn("sha", F.unhex(F.sha2("norm", 256))).drop("norm", "new")
    equal = Window.partitionBy("depth", "prefix", "key", "chain")
    owned = owned.withColumn("keep_id", F.min("doc_id").over(equal)).withColumn("group_size", F.sum("copies").over(equal))
    index = written(owned.select("depth", "prefix", "key", "chain", "doc_id", "copies", "shared", "sha", "keep_id", "group_size"))
    return index, digests.join(shared, "key", "left_semi").select("doc_id", "key", "sha")


def dedup(docs: DataFrame, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of ASCII white space
    became one space; null counts as empty. The smallest id stays; null ids come
    last, and stay if a group has no other. Rows that repeat are rows of their
    own: where the id that stays is repeated with its text, all its rows are
    ``kept``. An empty table gives an empty result. Other columns are not read.
    """
    index, shared = indexed(docs, capacity, id_col, text_col, key_bits)
    single = index.where(~F.col("shared")).select("doc_id", "keep_id", "group_size", "sha")
    # fewer shared texts than 32 for each bucket
    answer = F.broadcast(index.where("shared").select("key", "sha", "keep_id", "group_size"))
    looked_up = shared.join(answer, ["key", "sha"]).select("doc_id", "keep_id", "group_size", "sha")
    return single.unionByName(looked_up).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text one stays."""
    sha, key, many = fresh(docs, "sha"), fresh(docs, "kept_id"), fresh(docs, "kept_rows")
    rows = dedup(docs, id_col=id_col, text_col=text_col).where("kept")
    found = written(rows.groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(f"{sha}_kept")).agg(F.count("*").alias(many)))
    rows = docs.withColumn(sha, F.sha2(normalised(text_col), 256)).join(found, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(f"{sha}_kept")))
    if found.where(F.col(many) > 1).limit(1).count():
        rows = rows.dropDuplicates([key, sha])
    return rows.select(*columns(docs))
