"""Vector functions, Column to Column, on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sign_bits(a: Column) -> Column:
    """The signs of up to 64 components as a string of 0 and 1."""
    return F.array_join(F.transform(a, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def int8(a: Column, lo: Column, hi: Column) -> Column:
    """Components scaled to -128..127 by the range of their dimension."""
    scaled = F.zip_with(F.zip_with(a, lo, lambda x, l: x.cast("double") - l), F.zip_with(hi, lo, lambda h, l: (h - l) / 255), lambda d, s: F.when(s == 0, 0.0).otherwise(d / s) - 128)
    return F.transform(scaled, lambda x: F.greatest(F.least(x, F.lit(127.0)), F.lit(-128.0)).cast("int"))


def words64(a: Column) -> Column:
    """The signs as 64-bit words, the first component the lowest bit; the last word is filled with 0."""
    word = lambda at: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda w, i: F.when(F.coalesce(F.get(a, at * 64 + i) > 0, F.lit(False)), w.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(w))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / 64).cast("int") - 1), word)


def hamming(a: Column, b: Column) -> Column:
    """Differing signs of two vectors given as words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector of length 1; a vector of zeros as it is."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size == 0, x.cast("double")).otherwise(x / size))
