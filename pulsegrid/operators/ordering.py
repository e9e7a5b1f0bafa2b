"""Positions and running sums in an order, with no task that holds a whole group."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

ROWS_PER_SLICE = 200_000
MOST_SLICES = 4_096
SAMPLE_PER_SLICE = 32


def _splits(df: DataFrame, slices: int, n: int | None = None) -> DataFrame:
    """One row with at most slices - 1 places, in order, taken from the places whose hash is smallest: the same places in every run.

    They only say where slices are cut; which rows are counted does not depend on them. With n, the number of rows, a share
    of the hashes is cut off before the sort.
    """
    wanted = slices * SAMPLE_PER_SLICE
    if n and 2 * wanted < n:
        df = df.where(F.xxhash64("_place") < F.lit(int((4 * wanted / n - 1) * 2**63)))
    sample = df.select("_place").distinct().orderBy(F.xxhash64("_place"), "_place").limit(wanted)
    places = sample.agg(F.sort_array(F.collect_list("_place")).alias("p"))
    step = F.greatest(F.ceil(F.size("p") / slices), F.lit(1)).cast("int")
    return places.select(F.filter("p", lambda x, i: (i > 0) & (i % step == 0)).alias("_splits"))


def _with_slice(placed: DataFrame, slices: int, n: int | None = None) -> DataFrame:
    """placed with _slice, how many splits are at or before its _place: a binary search, a projection per step."""
    rows = placed.join(F.broadcast(_splits(placed, slices, n)), F.lit(True)).withColumn("_slice", F.lit(0))
    for k in reversed(range(slices.bit_length())):
        reached = F.get("_splits", F.col("_slice") + ((1 << k) - 1)) <= F.col("_place")
        rows = rows.withColumn("_slice", F.col("_slice") + F.when(reached, 1 << k).otherwise(0))
    return rows.drop("_splits", "_place")


def _inside(own, order: list[Column], amount: str | None) -> Column:
    """Position from 0 or running sum before the row, in a window partition."""
    w = own.orderBy(*order)
    return F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if amount else (F.row_number().over(w) - 1).cast("long")


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))


def _sliced(df: DataFrame, name: str, order: list[Column], keys: list[str], amount: str | None, slices: int, n: int) -> DataFrame:
    placed = df.withColumn("_place", F.struct(*keys, *[c.alias(f"_o{i}") for i, c in enumerate(order)]))
    rows = _with_slice(placed, slices, n)

    counted = rows.groupBy(*keys, "_slice").agg((F.coalesce(F.sum(amount), F.lit(0)) if amount else F.count("*")).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), earlier.alias("_earlier")).where("_earlier IS NOT NULL")

    inside = _inside(Window.partitionBy(*keys, "_slice"), order, amount)
    out = rows.withColumn("_inside", inside).join(F.broadcast(offsets), _same(keys) & (F.col("_slice") == F.col("_s")), "left")
    return out.select(*df.columns, (F.col("_inside") + F.coalesce("_earlier", F.lit(0))).alias(name))


def ahead(df: DataFrame, name: str, order: list[Column], within: tuple[str, ...] = (), amount: str | None = None, slices: int | None = None, n: int | None = None) -> DataFrame:
    """df with the column `name`: how many rows of the same group come before a row, or the sum of their `amount`.

    order holds ascending columns, nulls first. Groups are the values of `within` (null is a value), or the whole table.
    df is written once, so what it takes is not done again for counts, samples and rows; with n, about how many rows it
    has, it is not, which is for frames that take little more than a scan.

    Groups of at most `ROWS_PER_SLICE` rows are a task's worth each: one window. The rows of larger groups are cut into slices of about that
    size by group and order (`MOST_SLICES` at most, and all rows if `slices` is given), windows run inside a slice, and what lies in a
    group's earlier slices is added: fewer rows than splits, hence the broadcast. A null amount counts as 0. Rows that are
    equal in group and order share a slice and get their positions in any order. An empty table gives no rows.
    """
    keys = list(within)
    if n is None:
        df = written(df, "ordered")
        n = df.count()  # from the files' footers
    if slices:
        return _sliced(df, name, order, keys, amount, slices, n)
    plain = lambda rows: rows.withColumn(name, _inside(Window.partitionBy(*keys), order, amount))
    cut = lambda rows, size: _sliced(rows, name, order, keys, amount, min(MOST_SLICES, math.ceil(size / ROWS_PER_SLICE)), size)
    if n <= ROWS_PER_SLICE:
        return plain(df)
    if not keys:
        return cut(df, n)
    large = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_size")).where(F.col("_size") > ROWS_PER_SLICE)
    large = written(large, "large-groups")
    size = large.agg(F.sum("_size")).first()[0] or 0
    if not size:
        return plain(df)
    return plain(df.join(large, _same(keys), "left_anti")).unionByName(cut(df.join(large, _same(keys), "left_semi"), size))


def positions(df: DataFrame, name: str, order: list[Column], within: tuple[str, ...] = (), slices: int | None = None, n: int | None = None) -> DataFrame:
    """df with its position from 1, as `ahead` says."""
    return ahead(df, name, order, within, slices=slices, n=n).withColumn(name, (F.col(name) + 1).cast("int"))
