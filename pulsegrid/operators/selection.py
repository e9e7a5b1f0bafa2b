"""Exact medians of whole tables without a task that sees all values.

Values are counted, so repeated ones are one row each however often they occur. The distinct values are cut into slices of the order, a slice's rows
are added up, and only the slices that hold the middle ranks are sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ordering import MOST_SLICES, ROWS_PER_SLICE, _with_slice


def median(df: DataFrame, column: str, name: str = "median", rows_per_slice: int | None = None) -> DataFrame:
    """One row with the exact median as a double: the middle value, or the mean of the two middle ones. Nulls take no part; null without values."""
    counted = written(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")), "median-values")
    n = counted.count()
    slices = max(1, min(MOST_SLICES, math.ceil(n / (rows_per_slice or ROWS_PER_SLICE))))
    rows = _with_slice(counted.withColumn("_place", F.struct("_v")), slices, n)
    sums = rows.groupBy("_slice").agg(F.sum("_n").alias("_of_slice"))  # a row per slice
    upto = F.sum("_of_slice").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    every = F.sum("_of_slice").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = sums.select("_slice", F.coalesce(upto, F.lit(0)).alias("_before"), "_of_slice", every.alias("_all"))
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")  # ranks from 0
    held = sums.where((F.col("_before") <= high) & (F.col("_before") + F.col("_of_slice") > low))  # two slices at most
    near = rows.join(F.broadcast(held), "_slice")
    at = F.col("_before") + F.sum("_n").over(Window.partitionBy("_slice").orderBy("_v")) - F.col("_n")
    ends = lambda rank: (F.col("_at") <= rank) & (F.col("_at") + F.col("_n") > rank)
    pick = lambda rank: F.max(F.when(ends(rank), F.col("_v").cast("double")))
    return near.withColumn("_at", at).agg(((pick(low) + pick(high)) / 2).alias(name))
