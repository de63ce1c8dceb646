"""Bloom filters as sparse maps of 64-bit words, by built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(ndv: int, fpp: float) -> tuple[int, int]:
    """(bits, hash functions)."""
    m = max(64, math.ceil(-ndv * math.log(fpp) / math.log(2) ** 2))
    return m, max(1, round(m / ndv * math.log(2)))


def digest(value: Column, dtype: str) -> Column:
    """The hash of a value; integers of every width hash alike."""
    return F.xxhash64(value if dtype == "string" else value.cast("bigint"))


def positions(h: Column, m: int, k: int) -> Column:
    """The k bit positions of a hash."""
    h1 = h.bitwiseAND(F.lit(0x7FFFFFFF))
    h2 = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), lambda i: F.pmod(h1 + i * h2, F.lit(m).cast("bigint")))


def might_contain(words: Column, h: Column, m: int, k: int) -> Column:
    """Whether all bits of a hash are set in the map of words."""

    def has(p: Column) -> Column:
        word = F.try_element_at(words, F.shiftright(p, 6).cast("int"))
        return F.coalesce(F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1, F.lit(False))

    return F.forall(positions(h, m, k), has)
