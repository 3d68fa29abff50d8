"""Fixtures: odd documents, as tables with nulls, ties, repeats and extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators might use themselves
    *[T.StructField(x, T.StringType()) for x in ("sha", "kept_id", "score", "key", "h", "_n", "Row", "plan_id", "held_out", "a.b")],
])


def words(rng: random.Random, n: int, kinds: int = 400) -> str:
    return " ".join(f"{rng.choice('bcdfghklmnprstvwz')}{rng.choice('aeiou')}{rng.choice('bcdlmnrst')}{rng.randrange(kinds)}" for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base, passage = words(rng, 200), words(rng, 70)
    edited = base.split()
    edited[90] = "changed"
    texts = [
        None, "", " \t\n", "One", "one two three", "ONE two  three", base, base, base.upper(), " ".join(edited), "  ".join(base.split()), f"{words(rng, 40)} {passage} {words(rng, 30)}", f"{passage}", f"{passage} tail",
        "é ü ß 漢字     x", "123 456 !!!", words(rng, 6000), "a" * 50_000, "aaaa " * 3000, *[words(rng, rng.randrange(1, 120)) for _ in range(25)],
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "S3"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, "en", "s1", 3), (None, None, None, None, None), (-5, passage, "en", "s2", 1), (8, "another text with id eight", "de", "s1", 2)]
    rng.shuffle(rows)
    return [(*r, *["x"] * 10) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
