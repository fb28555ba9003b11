"""Hashes that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 64-bit FNV-1a hash: offset basis as two halves; the prime is 2**40 + 0x1B3.
_HIGH, _LOW, _PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
_MASK = 0xFFFFFFFF


def fnv1a64(value: Column) -> Column:
    """16 lowercase hex digits of the FNV-1a hash of a string's UTF-8 bytes or of binary; null for null. A fold over the bytes in halves of 32 bits,
    so that no product overflows a long."""
    digits = F.hex(value.cast("binary"))
    start = F.struct(F.lit(_HIGH).cast("long").alias("high"), F.lit(_LOW).cast("long").alias("low"))

    def step(acc: Column, at: Column) -> Column:
        low = acc["low"].bitwiseXOR(F.conv(F.substring(digits, 2 * at - 1, 2), 16, 10).cast("long"))
        product = low * _PRIME_LOW
        high = acc["high"] * _PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_MASK).cast("long")).alias("high"), product.bitwiseAND(F.lit(_MASK).cast("long")).alias("low"))

    length = F.octet_length(value)
    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(places, start, step)
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.when(value.isNotNull(), F.concat(half(done["high"]), half(done["low"])))
