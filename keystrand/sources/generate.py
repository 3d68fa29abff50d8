"""Synthetic records, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import ord_of_bits

LEAST_PAYLOAD = 8


def generate_records(spark: SparkSession, n: int, max_payload: int = 64, seed: int = 42, wide_keys: bool = False) -> DataFrame:
    """``n`` records (id, key_ord, len, payload): uniform keys of 32 bits (64 if ``wide_keys``), payloads of 8 to max_payload - 1 random bytes."""
    if n < 0 or max_payload <= LEAST_PAYLOAD:
        raise ValueError(f"n must not be negative, max_payload must be above {LEAST_PAYLOAD}")
    draw = lambda k: F.xxhash64("id", F.lit(seed), F.lit(k))
    bits = draw(0) if wide_keys else F.shiftrightunsigned(draw(0), 32)
    length = F.pmod(draw(1), F.lit(max_payload - LEAST_PAYLOAD)) + LEAST_PAYLOAD
    words = F.sequence(F.lit(0), F.lit(-(-max_payload // 8)))
    text = F.array_join(F.transform(words, lambda k: F.lpad(F.hex(F.xxhash64("id", F.lit(seed), k + 2)), 16, "0")), "")
    rows = spark.range(n).select("id", ord_of_bits(bits).alias("key_ord"), length.cast("long").alias("len"), F.unhex(text).alias("payload"))
    return rows.withColumn("payload", F.expr("substring(payload, 1, CAST(len AS INT))"))
