"""Winners, top lists and displays of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texts import duration_short
from .filters import not_instant
from .ordering import positions


def winners(counts: DataFrame) -> DataFrame:
    """metric_key, login, value: the best of each metric, ties by name. A max over a struct needs no sort."""
    best = counts.groupBy("metric_key").agg(F.min(F.struct((-F.col("value")).alias("v"), "login")).alias("b"))
    return best.select("metric_key", F.col("b.login").alias("login"), (-F.col("b.v")).alias("value"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def consistent_people(active_weeks: DataFrame, k: int = 3) -> DataFrame:
    return top_k(active_weeks, k, F.desc("active_weeks"), F.col("login"))


def largest_changes(details: DataFrame, k: int = 5) -> DataFrame:
    return top_k(details.where("lines_changed > 0"), k, F.desc("lines_changed"), F.col("repo_id"), F.col("number"))


def fastest_merges(details: DataFrame, k: int = 5) -> DataFrame:
    return top_k(not_instant(details), k, F.col("merge_time_hours"), F.col("repo_id"), F.col("number")).withColumn("duration", duration_short(F.col("merge_time_hours")))


def repo_contributions(health: DataFrame, k: int = 10) -> DataFrame:
    """Repositories by the sum of their counters, positive ones only."""
    total = F.col("pr_count") + F.col("issue_count") + F.col("review_count") + F.col("comment_count")
    return top_k(health.select("repo_id", total.alias("contributions")).where("contributions > 0"), k, F.desc("contributions"), F.col("repo_id"))


def repo_awards(health: DataFrame) -> DataFrame:
    """award, repo_id, value: most active, best reviewed, most collaborative; a value must be positive."""
    kinds = {"most_active": F.col("pr_count").cast("double"), "best_reviewed": F.col("review_coverage"), "most_collaborative": F.col("contributor_count").cast("double")}
    each = F.array(*[F.struct(F.lit(k).alias("award"), v.alias("value")) for k, v in kinds.items()])
    rows = health.select("repo_id", F.inline(each)).where("value > 0")
    best = rows.groupBy("award").agg(F.min(F.struct((-F.col("value")).alias("v"), "repo_id")).alias("b"))
    return best.select("award", F.col("b.repo_id").alias("repo_id"), (-F.col("b.v")).alias("value"))


def sample_by_metric(repos: DataFrame, metric: Column, mode: str = "sample", k: int = 50) -> DataFrame:
    """Which repositories an expensive look covers: none (skip), all, or the top k by a metric (null or unreadable is 0)."""
    if mode == "skip":
        return repos.where(F.lit(False))
    if mode == "all":
        return repos
    return top_k(repos.withColumn("_m", F.coalesce(metric.try_cast("double"), F.lit(0.0))), k, F.desc("_m"), F.col("repo_id")).drop("_m")


def nested_number(df: DataFrame, path: str) -> Column:
    """A dotted path into structs as a whole number: 0 where a step is missing, null or no number."""
    kind = df.schema
    for step in path.split("."):
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return F.lit(0).cast("long")
        kind = kind[step].dataType
    value = F.col(".".join(f"`{step}`" for step in path.split(".")))
    return F.coalesce(F.lit(0) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else value.try_cast("double").cast("long"), F.lit(0).cast("long"))


def sorted_by(df: DataFrame, column: str, tie: str) -> DataFrame:
    """Descending, nulls as 0."""
    return df.orderBy(F.coalesce(F.col(column), F.lit(0)).desc(), tie)


def visible_rank(df: DataFrame, column: str, tie: str) -> DataFrame:
    """The position after sorting: descending, nulls as 0, ties by another column."""
    return positions(df, "position", [-F.coalesce(F.col(column), F.lit(0)), F.col(tie)])


def first_items(df: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """Per key the first n items in order and how many more there are. A null key is a key, a null item counts but is not shown.

    The items come from a window that each task cuts to n rows per key, the counts from a plain grouping.
    """
    w = Window.partitionBy(key).orderBy(item)
    first = df.select(key, item).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    shown = first.groupBy(F.col(key).alias("_key")).agg(F.concat_ws(", ", F.sort_array(F.collect_list(item))).alias("shown"))
    counted = df.groupBy(key).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return counted.join(shown, F.col(key).eqNullSafe(F.col("_key"))).select(key, "shown", "more")


def peaks(series: DataFrame, n: int = 3, date: str = "date", value: str = "value") -> DataFrame:
    """The n highest points, in date order."""
    return series.orderBy(F.desc(value), date).limit(n).orderBy(date)


def capped_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key: the feature is the cap."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def capped_pages(df: DataFrame, pages: int, column: str = "page") -> DataFrame:
    return df.where(F.col(column) <= pages)


@dataclass(frozen=True)
class Award:
    """A declarative award: the best by a metric, ties by another column, then by id."""

    key: str
    title: str
    metric: str
    direction: str = "desc"
    tie_breaker: str | None = None
    humans_only: bool = False
    min_prs: int = 0


# fixed values: the awards of people and of repositories
USER_AWARDS = [
    Award("merge_machine", "Merge Machine", "prs_merged", tie_breaker="prs_opened", humans_only=True),
    Award("review_paladin", "Review Paladin", "reviews_submitted", tie_breaker="review_comments_total", humans_only=True),
    Award("docs_druid", "Docs Druid", "docs_lines_changed", tie_breaker="docs_commits", humans_only=True),
    Award("bug_janitor", "Bug Janitor", "issues_closed", tie_breaker="issues_opened", humans_only=True),
    Award("comment_champion", "Comment Champion", "comments_total", tie_breaker="review_comments_total", humans_only=True),
    Award("approval_ace", "Approval Ace", "approvals", tie_breaker="reviews_submitted", humans_only=True),
    Award("nitpicker", "Thoughtful Nitpicker", "changes_requested", tie_breaker="reviews_submitted", humans_only=True),
    Award("early_bird", "Early Bird", "avg_time_to_first_review", direction="asc", humans_only=True),
    Award("consistency_king", "Consistency King/Queen", "active_weeks", tie_breaker="prs_merged", humans_only=True),
    Award("night_owl", "Night Owl", "off_hours_commits", tie_breaker="commits", humans_only=True),
]
REPO_AWARDS = [
    Award("bus_factor_alarm", "Bus Factor Alarm", "bus_factor_risk_score"),
    Award("stale_queue_dragon", "Stale Queue Dragon", "stale_pr_count"),
    Award("review_desert", "Review Desert", "review_coverage", direction="asc", min_prs=10),
    Award("merge_velocity_champion", "Merge Velocity Champion", "median_time_to_merge", direction="asc", min_prs=10),
    Award("most_active", "Most Active Repository", "total_activity_score"),
    Award("best_hygiene", "Best Hygiene", "hygiene_score"),
    Award("worst_hygiene", "Hygiene Needs Work", "hygiene_score", direction="asc"),
]


def give_awards(stats: DataFrame, awards: list[Award], id_col: str = "login") -> DataFrame:
    """award_key, title, winner, value: one row per award that anyone wins, all from one scan. stats holds the metric columns, is_bot and prs_opened."""
    best = []
    for a in awards:
        fits = F.col(a.metric).isNotNull()
        if a.humans_only:
            fits &= ~F.col("is_bot")
        if a.min_prs:
            fits &= F.col("prs_opened") >= a.min_prs
        value = F.col(a.metric).cast("double")
        tie = -F.coalesce(F.col(a.tie_breaker), F.lit(0)).cast("double") if a.tie_breaker else F.lit(0.0)
        rank = F.struct((value if a.direction == "asc" else -value).alias("m"), tie.alias("t"), F.col(id_col).alias("id"))
        best.append(F.min(F.when(fits, rank)).alias(a.key))
    won = [
        F.when(
            F.col(a.key).isNotNull(),
            F.struct(F.lit(a.key).alias("award_key"), F.lit(a.title).alias("title"), F.col(a.key)["id"].alias("winner"), (F.col(a.key)["m"] if a.direction == "asc" else -F.col(a.key)["m"]).alias("value")),
        )
        for a in awards
    ]
    return stats.agg(*best).select(F.inline(F.array_compact(F.array(*won))))


def risk_signals(stats: DataFrame, signals: list[tuple[str, Column]], id_col: str = "repo_id") -> DataFrame:
    """signal, repo: a row for each signal whose condition holds."""
    each = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in signals]))
    return stats.select(F.explode(each).alias("signal"), F.col(id_col).alias("repo"))
