"""Numbers with guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """Round half to even on the decimal text of the value."""
    return F.bround(x, digits)


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def first_nonzero(*values: Column) -> Column:
    """The first value that is neither null nor 0; 0 if there is none."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values], F.lit(0))


def scale_to_max(value: Column, other: Column) -> Column:
    """A value as percent of the larger of two, the scale never below 1."""
    return value.cast("double") / F.greatest(value, other, F.lit(1)) * 100


def trend(change: Column, inverse: bool = False) -> Column:
    """up, down or neutral; inverse where less is better."""
    up, down = ("down", "up") if inverse else ("up", "down")
    return F.when(change > 0, up).when(change < 0, down).otherwise("neutral")
