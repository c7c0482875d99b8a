"""Column helpers for operators that stay inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row: bound as a lambda variable, so that merging projections can't
    move it into an inner loop."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """1..n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


#: Bits of a bitmap of hashes, a constant of a plan.
BITS = 1 << 20


def bitmap(hashes: DataFrame, column: str) -> Column | None:
    """The set of ``column``'s 64-bit hashes by their lowest bits, as a constant array of longs; None for no rows."""
    place = F.col(column).bitwiseAND(F.lit(BITS - 1))
    words = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")).alias("bits"))
    rows = words.collect()  # at most BITS / 64
    if not rows:
        return None
    table = ["0"] * (BITS // 64)
    for w, bits in rows:
        table[w] = str(bits)
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")  # folded to a constant by the optimizer


def in_bitmap(bits: Column, h: Column) -> Column:
    """False for hashes that the bitmap's set doesn't hold; true for those that it does, and for some others."""
    word = F.get(bits, F.shiftright(h.bitwiseAND(F.lit(BITS - 1)), 6).cast("int"))
    return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1
