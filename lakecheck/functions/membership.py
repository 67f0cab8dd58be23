"""Sets of keys as bits: a Bloom filter out of built-in functions, handed to a plan as one scalar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS_PER_KEY = 12
#: 16 MB, what a plan may carry; beyond it a filter is not worth its size.
MAX_BITS = 1 << 27


def filter_bits(expected: int) -> int | None:
    """Bits for so many distinct keys, a power of two; None where that would be more than ``MAX_BITS``.

    One key in about 200 that is not in the set passes the filter.
    """
    bits = 1 << max(12, (expected * BITS_PER_KEY - 1).bit_length())
    return bits if bits <= MAX_BITS else None


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits).cast("bigint")) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, key: Column, bits: int) -> Column:
    """The bits of all values of ``key``, as an array of 64-bit words; a scalar subquery of the plan that uses it."""
    places = keys.select(F.explode(F.array(*_places(key, bits))).alias("p"))
    words = places.select(F.shiftright("p", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int")).alias("b"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    whole = words.unionByName(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    # at most MAX_BITS / 64 words, whatever the number of keys
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words")).scalar()


def may_hold(words: Column, key: Column, bits: int) -> Column:
    """False for keys that are surely not in the set."""
    passed = F.lit(True)
    for place in _places(key, bits):
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        passed = passed & (F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return passed
