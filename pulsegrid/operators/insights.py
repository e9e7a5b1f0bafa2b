"""Ratios and texts for a year's report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percentage, ratio
from ..functions.texts import duration_long, number_text
from ..functions.times import date_label, month_label, period_to_date
from .metrics import per_person


def insights(events: DataFrame, summary: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: reviewers per pull request, share of people who review, merges a week, median size, merge rate. events: facts_wide or events_long."""
    kinds = ("prs_opened", "issues_opened", "reviews_submitted")
    people = per_person(events, kinds).select((F.col("reviews_submitted") > 0).alias("reviews"))
    part = people.agg(F.count_if("reviews").alias("reviewers"), F.count("*").alias("people"))
    return summary.join(part, F.lit(True)).join(sizes, F.lit(True)).select(
        ratio(F.col("total_reviews"), F.col("total_prs")).alias("avg_reviewers_per_pr"),
        percentage(F.col("reviewers"), F.col("people")).alias("review_participation_rate"),
        (F.col("prs_merged") / 52.0).alias("prs_per_week"),
        F.coalesce(F.col("median_size").cast("long"), F.lit(0)).alias("median_pr_size"),
        percentage(F.col("prs_merged"), F.col("total_prs")).alias("merge_rate"),
    )


def practice_shares(hygiene: DataFrame) -> DataFrame:
    """Share of repositories with CI, code owners, security policy, in whole percent."""
    share = lambda f: F.round(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")) * 100, 0)
    return hygiene.agg(share("has_ci_workflows").alias("ci_percent"), share("has_codeowners").alias("codeowners_percent"), share("has_security_md").alias("security_percent"))


def most_active_month(series: DataFrame, metric: str = "prs_merged") -> DataFrame:
    """month, label, total of the busiest month; weekly periods count by their Monday. No row without data."""
    day = F.coalesce(period_to_date(F.col("period")), F.try_to_date(F.concat("period", F.lit("-01")), "yyyy-MM-dd"))
    months = series.where(F.col("metric_key") == metric).select(F.trunc(day, "month").alias("month"), "count").where("month IS NOT NULL").groupBy("month").agg(F.sum("count").alias("total"))
    best = months.agg(F.min(F.struct((-F.col("total")).alias("t"), "month")).alias("b")).where("b IS NOT NULL")
    return best.select(F.date_format("b.month", "yyyy-MM").alias("month"), month_label(F.col("b.month")).alias("label"), (-F.col("b.t")).alias("total"))


def busiest_week(weekly: DataFrame, metric: str = "prs_opened") -> DataFrame:
    """period, label, total of the busiest week, the label being its Monday."""
    weeks = weekly.where(F.col("metric_key") == metric).groupBy("period").agg(F.sum("count").alias("total"))
    best = weeks.agg(F.min(F.struct((-F.col("total")).alias("t"), "period")).alias("b")).where("b IS NOT NULL")
    return best.select(F.col("b.period").alias("period"), date_label(period_to_date(F.col("b.period"))).alias("label"), (-F.col("b.t")).alias("total"))


def mean_merge_text(health: DataFrame) -> DataFrame:
    """The mean of positive per-repository medians, as number and text."""
    mean = F.avg(F.when(F.col("median_time_to_merge") > 0, F.col("median_time_to_merge")))
    return health.agg(mean.alias("hours")).select("hours", duration_long(F.col("hours")).alias("label"))


def review_facts(summary: DataFrame) -> DataFrame:
    """Reviews per pull request, coverage held at 100, and the comment total as text."""
    per = ratio(F.col("total_reviews"), F.col("total_prs"))
    return summary.select(per.alias("reviews_per_pr"), F.least(F.round(per * 100, 0), F.lit(100.0)).alias("coverage"), number_text(F.col("total_comments")).alias("comments_text"))


def health_signals(health: DataFrame) -> DataFrame:
    """Mean coverage and contributors, mean merge time as text, stale pull requests in all."""
    out = health.agg(
        F.avg("review_coverage").alias("avg_coverage"), F.avg(F.when(F.col("median_time_to_merge") > 0, F.col("median_time_to_merge"))).alias("hours"),
        F.coalesce(F.sum("stale_pr_count"), F.lit(0)).alias("stale_prs"), F.avg("contributor_count").alias("avg_contributors"),
    )
    return out.select("avg_coverage", duration_long(F.col("hours")).alias("merge_time"), "stale_prs", "avg_contributors")


def summary_from_metrics(rows: DataFrame) -> DataFrame:
    """The summary once more, from org-scope leaderboard rows."""
    org = rows.where("scope = 'org'")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("metric_key") == k, F.col("value"))), F.lit(0))
    people = org.select("login").distinct().agg(F.count("*").alias("total_contributors"))
    repos = rows.where("scope = 'repo'").select("repo_id").distinct().agg(F.count("*").alias("total_repos"))
    return org.agg(of("prs_merged").alias("prs_merged"), of("reviews_submitted").alias("total_reviews")).join(people, F.lit(True)).join(repos, F.lit(True))
