"""Keys, sizes and formatting of records.

Spark has no unsigned 64-bit type. A key is held as ``key_ord``, the key with
its top bit flipped: signed order of ``key_ord`` is unsigned order of the key,
and sorting a BIGINT can use radix sort. ``key`` is its value as DECIMAL(20,0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP_BIT = -(1 << 63)
HEADER_BYTES = 12


def ord_of_bits(bits: Column) -> Column:
    """``key_ord`` of a BIGINT that holds the 64 bits of an unsigned key."""
    return bits.bitwiseXOR(F.lit(TOP_BIT))


def key_of(key_ord: Column) -> Column:
    """The unsigned value."""
    return (key_ord.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)")


def record_bytes(payload: Column) -> Column:
    return F.octet_length(payload).cast("long") + HEADER_BYTES


def formatted(key_ord: Column, payload: Column) -> Column:
    """``key len hex`` as one line of text."""
    return F.concat_ws(" ", key_of(key_ord).cast("string"), F.octet_length(payload).cast("string"), F.hex(payload))
