"""One row per person, comparisons, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import scale_to_max
from .metrics import METRICS, SERIES, TOTAL
from .ordering import positions


def merge_metrics(counts: DataFrame) -> DataFrame:
    """login and a column per metric: one pivoted grouping instead of a chain of outer joins."""
    wide = counts.groupBy("login").pivot("metric_key", list(METRICS)).agg(F.sum("value"))
    return wide.select("login", *[F.coalesce(m, F.lit(0)).alias(m) for m in METRICS])


def with_total(merged: DataFrame) -> DataFrame:
    return merged.withColumn("contributions_total", sum((F.col(m) for m in TOTAL), F.lit(0)))


def contributors(counts: DataFrame, users: DataFrame) -> DataFrame:
    """Merged metrics with total, rank (ties by login) and avatar."""
    ranked = positions(with_total(merge_metrics(counts)), "rank", [-F.col("contributions_total"), F.col("login")])
    return ranked.join(users.select("login", "avatar_url"), "login", "left").withColumn("avatar_url", F.coalesce("avatar_url", F.lit("")))


def sparklines(weekly: DataFrame) -> DataFrame:
    """login, activity: weekly totals over six metrics in order of periods. An array as long as a person's weeks."""
    per = weekly.where(F.col("metric_key").isin(*SERIES)).groupBy("login", "period").agg(F.sum("count").alias("n"))
    return per.groupBy("login").agg(F.transform(F.sort_array(F.collect_list(F.struct("period", "n"))), lambda x: x["n"]).alias("activity"))


def with_activity(people: DataFrame, weekly: DataFrame) -> DataFrame:
    return people.join(sparklines(weekly), "login", "left").withColumn("activity", F.coalesce("activity", F.array().cast("array<bigint>")))


COMPARED = ("prs_opened", "prs_merged", "reviews_submitted", "approvals", "issues_opened", "issues_closed", "comments_total")


def compare(merged: DataFrame, a: str, b: str) -> DataFrame:
    """metric, both values, and each as percent of the larger. Comparing someone with themselves is refused."""
    if a == b:
        raise ValueError("choose two different people")
    long = merged.where(F.col("login").isin(a, b)).select("login", *COMPARED).unpivot(["login"], list(COMPARED), "metric", "value")
    side = lambda who, name: long.where(F.col("login") == who).select("metric", F.col("value").alias(name))
    both = side(a, "value_a").join(side(b, "value_b"), "metric")
    return both.select("metric", "value_a", "value_b", scale_to_max(F.col("value_a"), F.col("value_b")).alias("percent_a"), scale_to_max(F.col("value_b"), F.col("value_a")).alias("percent_b"))


def overall(counts: DataFrame) -> DataFrame:
    """The overall leaderboard: total score with its parts, ranked."""
    total = with_total(merge_metrics(counts)).select("login", F.col("contributions_total").alias("overall_score"), "prs_merged", "reviews_submitted", "issues_closed", "comments_total")
    return positions(total, "rank", [-F.col("overall_score"), F.col("login")])
