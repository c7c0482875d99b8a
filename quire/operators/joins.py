"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` in its group ``by`` whose ``on`` isn't greater; null before the
    first. One shuffle on ``by`` of both sides together, then a running window: no pairs are made."""
    rows = left.select(*by, on, F.lit(1).alias("_mine"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    marks = right.select(*by, on, F.lit(0).alias("_mine"), F.col(value).alias("_value"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*by).orderBy(on, "_mine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(marks).withColumn("_value", F.last("_value", ignorenulls=True).over(order))
    return both.filter("_mine = 1").select("_row.*", F.col("_value").alias(value))


def overlapping(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of rectangles of one group with a common area: an equi-join on ``by``, then ranges. Columns x0..y1 on both
    sides, the right's named rx0..ry1; rows of ``left`` without a partner stay, with nulls."""
    cross = (F.least("x1", "rx1") > F.greatest("x0", "rx0")) & (F.least("y1", "ry1") > F.greatest("y0", "ry0"))
    named = right.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in right.columns if c not in by))
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    return left.join(named, [*same, cross], "left").drop(*(f"_{c}" for c in by))
