"""Integer arithmetic of fixed widths, in longs, without casts that fail or wrap by themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1)


def unsigned(x: Column, bits: int) -> Column:
    return x.bitwiseAND(mask(bits))


def wrap(x: Column, bits: int) -> Column:
    """Two's complement of the low bits."""
    half = 1 << (bits - 1)
    return (x + F.lit(half)).bitwiseAND(mask(bits)) - F.lit(half)


def gray_to_binary(u: Column, bits: int) -> Column:
    k = 1
    while k < bits:
        u = u.bitwiseXOR(F.shiftright(u, k))
        k *= 2
    return u
