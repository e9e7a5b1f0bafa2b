"""Repository filters with reasons, and row filters of the activity tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso_timestamp


@dataclass(frozen=True)
class RepoFilters:
    """What a repository must be. Empty tuples and None ask for nothing."""

    include_forks: bool = False
    include_archived: bool = False
    visibility: str = "all"  # all, public or private
    pushed_within_days: int | None = None
    min_kb: int | None = None
    max_kb: int | None = None
    include_languages: tuple[str, ...] = ()
    exclude_languages: tuple[str, ...] = ()
    require_any_topics: tuple[str, ...] = ()
    require_all_topics: tuple[str, ...] = ()
    exclude_topics: tuple[str, ...] = ()
    include_names: tuple[str, ...] = field(default=())
    exclude_names: tuple[str, ...] = field(default=())


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def fork_ok(c: RepoFilters) -> Column:
    return F.lit(True) if c.include_forks else ~F.coalesce(F.col("fork"), F.lit(False))


def archive_ok(c: RepoFilters) -> Column:
    return F.lit(True) if c.include_archived else ~F.coalesce(F.col("archived"), F.lit(False))


def visibility_ok(c: RepoFilters) -> Column:
    seen = F.coalesce("visibility", F.when(F.coalesce("private", F.lit(False)), "private").otherwise("public"))
    return F.lit(True) if c.visibility == "all" else seen == c.visibility


def activity_ok(c: RepoFilters, as_of: Column) -> Column:
    if c.pushed_within_days is None:
        return F.lit(True)
    return F.coalesce(iso_timestamp(F.col("pushed_at")) >= as_of - F.expr(f"INTERVAL {c.pushed_within_days} DAYS"), F.lit(False))


def size_ok(c: RepoFilters) -> Column:
    kb = F.coalesce(F.col("size_kb"), F.lit(0))
    return (kb >= (c.min_kb or 0)) & (F.lit(True) if c.max_kb is None else kb <= c.max_kb)


def language_ok(c: RepoFilters) -> Column:
    out = F.lit(True)
    if c.exclude_languages:
        out = out & ~F.coalesce(F.col("language").isin(*c.exclude_languages), F.lit(False))
    if c.include_languages:
        out = out & F.coalesce(F.col("language").isin(*c.include_languages), F.lit(False))
    return out


def topics_ok(c: RepoFilters) -> Column:
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    as_array = lambda names: F.array(*[F.lit(n) for n in names])
    out = F.lit(True)
    if c.exclude_topics:
        out = out & ~F.arrays_overlap(topics, as_array(c.exclude_topics))
    if c.require_all_topics:
        out = out & (F.size(F.array_except(as_array(c.require_all_topics), topics)) == 0)
    if c.require_any_topics:
        out = out & F.arrays_overlap(topics, as_array(c.require_any_topics))
    return out


def name_ok(c: RepoFilters) -> Column:
    out = ~_any([F.col("name").rlike(p) for p in c.exclude_names])
    return out & _any([F.col("name").rlike(p) for p in c.include_names]) if c.include_names else out


def apply_filter_chain(repos: DataFrame, c: RepoFilters, as_of: Column) -> DataFrame:
    """All rows with reject_filter and reject_reason: the first filter of the fixed order that fails, or nulls."""
    steps = [
        ("fork", fork_ok(c), "is a fork"),
        ("archive", archive_ok(c), "is archived"),
        ("visibility", visibility_ok(c), f"is not {c.visibility}"),
        ("activity", activity_ok(c, as_of), f"no push within {c.pushed_within_days} days"),
        ("size", size_ok(c), "size out of range"),
        ("language", language_ok(c), "language not wanted"),
        ("topics", topics_ok(c), "topics not wanted"),
        ("name", name_ok(c), "name not wanted"),
    ]
    which = F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok, _ in steps])
    why = F.coalesce(*[F.when(which == name, F.lit(text)) for name, _, text in steps])
    return repos.withColumn("reject_filter", which).withColumn("reject_reason", why)


def passed(chained: DataFrame) -> DataFrame:
    return chained.where("reject_filter IS NULL").drop("reject_filter", "reject_reason")


def rejection_stats(chained: DataFrame) -> DataFrame:
    """filter, rejected, discovered, passed: a row for each filter that rejected something."""
    totals = chained.agg(F.count("*").alias("discovered"), F.count_if(F.col("reject_filter").isNull()).alias("passed"))
    each = chained.where("reject_filter IS NOT NULL").groupBy(F.col("reject_filter").alias("filter")).agg(F.count("*").alias("rejected"))
    return each.join(F.broadcast(totals), F.lit(True)).orderBy(F.desc("rejected"), "filter")


def created_within(df: DataFrame, since: Column, until: Column, column: str = "created_at") -> DataFrame:
    """Rows of the half-open window; rows without a time go. Bounds take the column's own type, so that they reach the scan."""
    kind = df.schema[column].dataType
    return df.where((F.col(column) >= since.cast(kind)) & (F.col(column) < until.cast(kind)))


def updated_within(df: DataFrame, since: Column, until: Column, column: str = "updated_at") -> DataFrame:
    """The same on text times; what cannot be read goes."""
    at = iso_timestamp(F.col(column).cast("string"))
    return df.where((at >= since) & (at < until))


def page_all_older(rows: DataFrame, page: str, column: str, since: Column) -> DataFrame:
    """Per page, whether every row with a readable time is older than since (true if there is none)."""
    return rows.groupBy(page).agg(F.coalesce(F.bool_and(iso_timestamp(F.col(column).cast("string")) < since), F.lit(True)).alias("all_older"))


def split_issues(issues: DataFrame, marker: str = "is_pull_request") -> tuple[DataFrame, DataFrame]:
    """(real issues, number of dropped pull requests)."""
    real = F.coalesce(F.col(marker), F.lit(False)) == F.lit(False)
    return issues.where(real), issues.agg(F.count_if(~real).alias("dropped"))


def updated_before(issues: DataFrame, until: Column, column: str = "updated_at") -> DataFrame:
    return issues.where(F.col(column) < until.cast(issues.schema[column].dataType))


def commit_window(commits: DataFrame, until: Column, since: Column | None = None, since_days: int | None = None, column: str = "committed_at") -> DataFrame:
    """[since, until), or the last since_days before until."""
    start = since if since is not None else until - F.expr(f"INTERVAL {since_days} DAYS")
    return created_within(commits, start, until, column)


def with_login(df: DataFrame, column: str = "login") -> DataFrame:
    return df.where(F.coalesce(F.col(column), F.lit("")) != "")


def in_year(df: DataFrame, year: int, column: str) -> DataFrame:
    """The calendar-year gate as a range, so that it reaches the scan."""
    return created_within(df, F.lit(f"{year}-01-01").cast("timestamp"), F.lit(f"{year + 1}-01-01").cast("timestamp"), column)


def org_scope(metrics: DataFrame) -> DataFrame:
    return metrics.where((F.col("scope") == "org") & (F.coalesce("metric_key", F.lit("")) != ""))


def complete_points(points: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        points = points.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return points


def name_contains(df: DataFrame, column: str, query: str) -> DataFrame:
    return df.where(F.lower(column).contains(query.lower()))


def with_status(df: DataFrame, status: str, column: str = "health_status") -> DataFrame:
    return df if status == "all" else df.where(F.col(column) == status)


def not_instant(df: DataFrame, column: str = "merge_time_hours") -> DataFrame:
    """Merges under a minute do not count as fast."""
    return df.where(F.col(column) >= 1 / 60)


def of_period_type(series: DataFrame, period_type: str) -> DataFrame:
    return series.where(F.col("period_type") == period_type)
