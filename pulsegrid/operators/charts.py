"""Series for charts, from weekly counts (metric_key, period, login, count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import first_nonzero
from ..functions.times import period_to_date
from .ordering import ahead
from .selection import median


def _of(*metrics: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("metric_key").isin(*metrics), F.col("count"))), F.lit(0))


def _dated(weekly: DataFrame) -> DataFrame:
    return weekly.where(F.coalesce("period", F.lit("")) != "").withColumn("date", period_to_date(F.col("period"))).where("date IS NOT NULL")


def active_people(weekly: DataFrame) -> DataFrame:
    """date, contributors: distinct people a week, two plain groupings instead of a distinct aggregate."""
    people = _dated(weekly).where(F.coalesce("login", F.lit("")) != "").select("date", "login").distinct()
    return people.groupBy("date").agg(F.count("*").alias("contributors"))


def collaboration(weekly: DataFrame) -> DataFrame:
    return _dated(weekly).where(F.col("metric_key").isin("reviews_submitted", "comments_total")).groupBy("date").agg(_of("reviews_submitted").alias("reviews"), _of("comments_total").alias("comments"), F.lit(0).cast("long").alias("cross_team"))


def velocity(weekly: DataFrame, health: DataFrame) -> DataFrame:
    """date, opened, merged, and one mean merge time for all points, cut to whole hours. Of health only median_time_to_merge is read."""
    mean = health.agg(F.coalesce(F.avg(F.when(F.col("median_time_to_merge") > 0, F.col("median_time_to_merge"))), F.lit(0.0)).cast("long").alias("avg_merge_hours"))
    points = _dated(weekly).where(F.col("metric_key").isin("prs_opened", "prs_merged")).groupBy("date").agg(_of("prs_opened").alias("opened"), _of("prs_merged").alias("merged"))
    return points.join(F.broadcast(mean), F.lit(True))


def weekly_total(weekly: DataFrame, *metrics: str) -> DataFrame:
    """date, total over the metrics (all if none is named)."""
    kept = weekly.where(F.col("metric_key").isin(*metrics)) if metrics else weekly
    return _dated(kept).groupBy("date").agg(F.sum("count").alias("total"))


#: A contribution's type by its metric; only openings, so that nothing counts twice.
TYPES = {"prs_opened": "PRs", "reviews_submitted": "Reviews", "issues_opened": "Issues", "comments_total": "Comments"}


def contribution_types(weekly: DataFrame) -> DataFrame:
    """type, count; a type without any keeps its 0."""
    sums = weekly.agg(*[_of(m).alias(t) for m, t in TYPES.items()])
    return sums.unpivot([], list(TYPES.values()), "type", "count")


def series_stats(series: DataFrame, value: str = "count") -> DataFrame:
    """total, mean (2 decimals), median, min, max; zeros for no points."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    v = F.col(value)
    sums = series.agg(F.sum(v).alias("total"), F.round(F.avg(v), 2).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")).join(median(series, value), F.lit(True))
    return sums.select(*[zero(F.col(c)).alias(c) for c in ("total", "mean", "median", "min", "max")])


def date_range(series: DataFrame, column: str = "date") -> DataFrame:
    return series.agg(F.min(column).alias("first"), F.max(column).alias("last"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def calendar(days: DataFrame, date: str = "date", value: str = "value", week_start: int = 1) -> DataFrame:
    """date, week (its first day), weekday (0 on the first day), value: every day of the range, zeros in between.

    week_start: 1 Monday ... 7 Sunday.
    """
    span = days.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a IS NOT NULL")
    spine = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    offset = F.pmod(F.weekday("day") + 1 - week_start, F.lit(7))
    found = days.groupBy(F.col(date).alias("day")).agg(F.sum(value).alias("value"))
    return spine.join(found, "day", "left").select(F.col("day").alias("date"), F.date_sub("day", offset).alias("week"), offset.alias("weekday"), F.coalesce("value", F.lit(0)).alias("value"))


def shares(slices: DataFrame, value: str) -> DataFrame:
    """Each slice's share of the total. One total row joined back, no global window."""
    total = slices.agg(F.sum(value).alias("_total"))
    return slices.join(F.broadcast(total), F.lit(True)).withColumn("share", F.coalesce(F.try_divide(F.col(value).cast("double"), F.col("_total").cast("double")), F.lit(0.0))).drop("_total")


def series_points(rows: DataFrame) -> DataFrame:
    """date from date, week or month; value from count or value."""
    return rows.select(F.coalesce("date", "week", "month").alias("date"), first_nonzero(F.col("count"), F.col("value")).alias("value"))


def preferred_scope(series: DataFrame, keys: list[str]) -> DataFrame:
    """Repository series where there are any for the keys, org series otherwise."""
    best = series.groupBy(*keys).agg(F.bool_or(F.col("scope") == "repo").alias("_repo"))
    return series.join(best, keys).where(F.col("scope") == F.when(F.col("_repo"), "repo").otherwise("org")).drop("_repo")


def rows_of_columns(df: DataFrame, *arrays: str) -> DataFrame:
    """Columnar records (an array per field) as rows."""
    return df.select(F.inline(F.arrays_zip(*arrays)))


def running_share(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Cumulative share in descending order, ties by another column."""
    total = df.agg(F.sum(value).alias("_total"))
    summed = ahead(df, "_before", [-F.col(value), F.col(tie)], amount=value).withColumn("cumulative", F.col("_before") + F.col(value))
    return summed.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("cumulative") / F.col("_total")).drop("_before", "_total")
