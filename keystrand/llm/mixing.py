"""Mixing sources to target weights by distributed prefix sums.

Each row gets a hash-random key. Within a source, rows are cut by the key's
high bits into ranges of equal expectation and sorted by key within a range
(rows alike in all columns count as one item with its number of copies);
range sums, prefix-summed over the small range table, and running sums within
each range give every row its place on the source's line of words. A source's
budget is cut on that line exactly: whole epochs for all rows, one more for the
rows before the cut, and the first words of the row that the cut meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, WORD, columns, fresh, word_count, written

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; none gets above ``most`` times its size, the excess goes to the rest by weight."""
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        whole = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not above:
            for i in free:
                targets[i] = left * weights[i] / whole
            break
        for i in above:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return targets


def items(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows that are alike in id, source, text and all other columns as one item, with their number: (doc_id, source, key, other, size, copies).

    The key is hashed from id and text, so neither rows that share an id nor
    those without one meet in a range; rows that are alike meet before the shuffle.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), hashed_key(seed, id_col, text_col).alias("key"),
        others(docs, id_col, text_col, source_col).alias("other"), word_count(text_col).alias("size"),
    ).groupBy("doc_id", "source", "key", "other", "size").agg(F.count("*").alias("copies"))


def others(docs: DataFrame, *but: str) -> Column:
    """A hash of all columns but these; columns of a map or variant type, which have no hash, are left out."""
    rest = [c for f, c in zip(docs.schema.fields, columns(docs), strict=True) if f.name not in but and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*rest, *[F.isnull(c) for c in but])


def hashed_key(seed: int, id_col: str, text_col: str) -> Column:
    """md5 of seed, id and the text's md5; a null id or text counts as the empty one."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))


def placed(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int, digits: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The items with source_size, target, epochs (whole ones), rest (words of the further, partial epoch) and start (place on the source's line)."""
    spark = docs.sparkSession
    rows = written(items(docs, seed, id_col, text_col, source_col))
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).collect()
    found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r["size"] for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], sum(sizes), most)
    plan = []
    for i, r in enumerate(found):
        budget = min(round(targets[i]), most * sizes[i])
        plan.append((i, r.source, sizes[i], targets[i], *(divmod(budget, sizes[i]) if sizes[i] else (0, 0))))
    table = spark.createDataFrame(plan, "s int, source string, source_size long, target double, epochs long, rest long")
    # one row for each source, as collected just above
    rows = rows.withColumnRenamed("source", "own").join(F.broadcast(table), F.col("own").eqNullSafe(F.col("source"))).drop("own")
    rows = rows.withColumn("range", F.substring("key", 1, digits))  # the digest is uniform, so ranges by its first digits are even
    words = F.col("size") * F.col("copies")
    sums = rows.groupBy("s", "range").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("s", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "other").rowsBetween(Window.unboundedPreceding, -1)
    lined = rows.withColumn("start", F.coalesce(F.sum(words).over(within), F.lit(0)))
    return lined.join(sums, ["s", "range"]).withColumn("start", F.col("start") + F.col("offset"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 17, digits: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Plan a mix; one row per document: doc_id, source, size, source_size, target, taken.

    Sources by code point (null last, a source of its own) weigh ``weights``,
    repeating; they share as many words as there are. A null or empty text has
    size 0 and is taken with 0 words. Rows that repeat are rows of their own;
    null ids are told apart by their text. An empty table gives an empty
    result. The order within a source depends on seed, id and text only, so
    reruns agree. One row for each source comes to the driver: sources are what
    the weights are set for.
    """
    rows = placed(docs, weights, most, seed, digits, id_col, text_col, source_col)
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("at") * F.col("size")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"(?:{SPACES})?{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 17, digits: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Carry out the plan of :func:`mix`: each row as often as it is taken, the one at a source's cut with its first words.

    The words that come out are those of the plan, also where rows repeat: rows
    that are alike in all columns share their copies. Rows that no epoch takes
    go, but rows without words stay once: they cost nothing. All columns of
    ``docs`` are kept; those of map or variant type may come from a row that is alike in the others.
    """
    names = {c: fresh(docs, f"plan_{c}") for c in ("doc_id", "source", "key", "other", "times", "cut", "copies", "words")}
    own = placed(docs, weights, most, seed, digits, id_col, text_col, source_col)
    further = F.greatest(F.lit(0), F.least(F.col("size") * F.col("copies"), F.col("rest") - F.col("start")))
    whole = F.when(F.col("size") == 0, F.col("copies")).otherwise(F.col("epochs") * F.col("copies") + F.floor(further / F.greatest(F.col("size"), F.lit(1))).cast("long"))
    cut = F.when(F.col("size") == 0, 0).otherwise(F.pmod(further, F.greatest(F.col("size"), F.lit(1))))
    plan = own.withColumn("times", whole).withColumn("cut", cut).where("times > 0 OR cut > 0")
    plan = written(plan.select(*[F.col(c).alias(names[c]) for c in ("doc_id", "source", "key", "other", "times", "cut", "copies")]))
    key, other = fresh(docs, "mix_key"), fresh(docs, "mix_other")
    rows = docs.withColumns({key: hashed_key(seed, id_col, text_col), other: others(docs, id_col, text_col, source_col)})
    rows = rows.join(plan, (F.col(key) == F.col(names["key"])) & (F.col(other) == F.col(names["other"])) & F.col(id_col).eqNullSafe(F.col(names["doc_id"])) & F.col(source_col).cast("string").eqNullSafe(F.col(names["source"])))
    if plan.where(F.col(names["copies"]) > 1).limit(1).count():  # one of several rows that are alike stands for all of them
        rows = rows.dropDuplicates([names["key"], names["other"], names["doc_id"], names["source"]])
    times, part, n = F.col(names["times"]), F.col(names["cut"]), names["words"]
    rows = rows.withColumn(n, F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), times.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))))
    text = F.when(F.col(n) < 0, F.col(text_col)).otherwise(first_words(F.col(text_col), F.col(n)))
    return rows.withColumn(text_col, text).select(*columns(docs))
