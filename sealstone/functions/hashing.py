"""Perceptual-hash functions over arrays: bits, hex, Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_to_long(bits: Column, n: int) -> Column:
    """The first `n` (up to 64) booleans as one long, first bit highest."""
    return F.aggregate(F.slice(bits, 1, n), F.lit(0).cast("long"), lambda word, b: F.shiftleft(word, 1).bitwiseOR(F.coalesce(b, F.lit(False)).cast("long")))


def to_hex(word: Column, digits: int = 16) -> Column:
    return F.lpad(F.lower(F.hex(word)), digits, "0")


def from_hex(text: Column) -> Column:
    """Signed long of up to 16 hex digits."""
    return F.conv(text, 16, -10).cast("long")


def median_bits(values: Column, n: int) -> Column:
    """Bit i: value i above the median of all values but the first (an image's mean brightness)."""
    ordered = F.array_sort(F.slice(values, 2, n - 1))
    middle = (n - 1) // 2
    median = F.get(ordered, F.lit(middle)) if (n - 1) % 2 else (F.get(ordered, F.lit(middle - 1)) + F.get(ordered, F.lit(middle))) / 2
    return F.transform(F.array(median), lambda m: F.transform(values, lambda x: x > m))[0]


def gradient_bits(values: Column, n: int) -> Column:
    """Bit i: value i + 1 above value i."""
    return F.zip_with(F.slice(values, 2, n - 1), F.slice(values, 1, n - 1), lambda b, a: b > a)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs, or of two arrays of longs of one size (null if sizes differ)."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)
