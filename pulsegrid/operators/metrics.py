"""The event-long table and what one grouping of it gives: leaderboards, series, health, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.people import is_bot
from ..functions.times import hours_between, iso_week_key, month_key
from ..sources.scratch import written
from .filters import created_within, in_year
from .ordering import ahead, positions
from .selection import median

#: The metrics of a leaderboard, in the order of reports.
METRICS = ("prs_opened", "prs_merged", "issues_opened", "issues_closed", "reviews_submitted", "approvals", "changes_requested", "comments_total", "review_comments_total")
SERIES = ("prs_opened", "prs_merged", "issues_opened", "issues_closed", "reviews_submitted", "comments_total")
COUNTED = ("prs_opened", "issues_opened", "reviews_submitted", "comments_total")
TOTAL = ("prs_merged", "prs_opened", "reviews_submitted", "issues_opened", "issues_closed", "comments_total")


def people_only(df: DataFrame) -> DataFrame:
    return df.where((F.col("login") != "") & ~is_bot(F.col("login"), F.col("user_type")))


def _kinds(prs: DataFrame, issues: DataFrame, reviews: DataFrame, comments: DataFrame, metrics: tuple[str, ...]) -> list[tuple[DataFrame, list[tuple[str, Column, str]]]]:
    """Per fact table the wanted metrics it counts for: name, condition, time column. Tables without any are left out."""
    yes, state = F.lit(True), F.upper("state")
    real = ~F.coalesce("is_pull_request", F.lit(False))
    closed = real & (F.col("state") == "closed") & F.col("closed_at").isNotNull()
    facts = [
        (prs, [("prs_opened", yes, "created_at"), ("prs_merged", F.col("merged_at").isNotNull(), "merged_at")]),
        (issues, [("issues_opened", real, "created_at"), ("issues_closed", closed, "closed_at")]),
        (reviews, [("reviews_submitted", yes, "submitted_at"), ("approvals", state == "APPROVED", "submitted_at"), ("changes_requested", state == "CHANGES_REQUESTED", "submitted_at")]),
        (comments, [("comments_total", yes, "created_at"), ("review_comments_total", F.col("comment_type").isin("pr", "review"), "created_at")]),
    ]
    wanted = [(df, [k for k in kinds if k[0] in metrics]) for df, kinds in facts]
    return [(df, kinds) for df, kinds in wanted if kinds]


def _events(df: DataFrame, kinds: list[tuple[str, Column, str]], item: str) -> DataFrame:
    """A row for each metric that a fact counts for: one scan, no union of scans."""
    each = F.array(*[F.when(on, F.struct(F.lit(name).alias("metric_key"), F.col(at).alias("ts"))) for name, on, at in kinds])
    rows = people_only(df).select("repo_id", "login", F.col(item).alias("item_id"), F.inline(each)).where("metric_key IS NOT NULL")
    return rows.select("metric_key", "repo_id", "login", "ts", "item_id")


def events_long(prs: DataFrame, issues: DataFrame, reviews: DataFrame, comments: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric_key, repo_id, login, ts, item_id: one row per countable fact of a person.

    Only tables that the named metrics count are read.
    """
    return reduce(DataFrame.unionByName, [_events(df, kinds, "number") for df, kinds in _kinds(prs, issues, reviews, comments, metrics)])


def facts_wide(prs: DataFrame, issues: DataFrame, reviews: DataFrame, comments: DataFrame, metrics: tuple[str, ...] = METRICS, timed: bool = False, before: Column | None = None) -> DataFrame:
    """repo_id, login and a 0 or 1 per named metric: one row per fact of a person that counts for any of them.

    What is counted needs no row per metric: a fact stays one row into the grouping. timed adds ts; a table whose metrics
    have different times then gives a scan for each, with that time's conditions pushed into it. before adds last, the latest of a fact's
    times before a moment, from the same scan. The counting operators take this table or events_long.
    """
    parts = []
    for df, kinds in _kinds(prs, issues, reviews, comments, metrics):
        people = people_only(df)
        for at in dict.fromkeys(k[2] for k in kinds) if timed else (None,):
            on = {name: cond for name, cond, time in kinds if at in (None, time)}
            flags = [F.when(on[m], 1).otherwise(0).alias(m) if m in on else F.lit(0).alias(m) for m in METRICS if m in metrics]
            extra = [F.col(at).alias("ts")] if at else []
            if before is not None:
                times = [F.when(cond & (F.col(time) < before), F.col(time)) for name, cond, time in kinds if name in on]
                extra.append((F.greatest(*times) if len(times) > 1 else times[0]).cast("timestamp").alias("last"))
            parts.append(people.where(reduce(lambda a, b: a | b, on.values())).select("repo_id", "login", *extra, *flags))
    return reduce(DataFrame.unionByName, parts)


def _is_long(rows: DataFrame) -> bool:
    return "metric_key" in rows.columns


def _long(wide: DataFrame, value: str) -> DataFrame:
    """A row per metric with a positive count, from a column per metric."""
    found = [m for m in METRICS if m in wide.columns]
    keys = [c for c in wide.columns if c not in found]
    return wide.unpivot(keys, found, "metric_key", value).where(F.col(value) > 0).select("metric_key", *keys, value)


def _sums(rows: DataFrame) -> list[Column]:
    return [F.sum(m).alias(m) for m in METRICS if m in rows.columns]


def per_person(rows: DataFrame, kinds: tuple[str, ...], *keys: str) -> DataFrame:
    """keys, login and a count per kind, of people with any of them; rows are events_long or facts_wide."""
    if _is_long(rows):
        return rows.where(F.col("metric_key").isin(*kinds)).groupBy(*keys, "login").agg(*[F.count_if(F.col("metric_key") == k).alias(k) for k in kinds])
    some = [k for k in kinds if k in rows.columns]
    last = [F.max("last").alias("last")] if "last" in rows.columns else []
    counted = rows.groupBy(*keys, "login").agg(*[F.sum(k).alias(k) if k in some else F.lit(0).cast("long").alias(k) for k in kinds], *last)
    return counted.where(reduce(lambda a, b: a | b, [F.col(k) > 0 for k in some], F.lit(False)))


def leaderboard_counts(events: DataFrame, *extra: str) -> DataFrame:
    """metric_key, login (and extra keys), value."""
    if _is_long(events):
        return events.groupBy("metric_key", *extra, "login").agg(F.count("*").alias("value"))
    return _long(events.groupBy(*extra, "login").agg(*_sums(events)), "value")


def ranked(counts: DataFrame, *within: str, n: int | None = None) -> DataFrame:
    """rank within each metric (and extra keys): by value, ties by login. n: as of `ahead`."""
    return positions(counts, "rank", [-F.col("value"), F.col("login")], ("metric_key", *within), n=n)


def top_ranked(counts: DataFrame, n: int, *within: str) -> DataFrame:
    """The first n of `ranked`: each task keeps n rows of a metric before anything is shuffled."""
    w = Window.partitionBy("metric_key", *within).orderBy(F.desc("value"), "login")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def leaderboards(events: DataFrame, users: DataFrame) -> DataFrame:
    """Ranked people with avatars; a user whose first sight was a bot is left out."""
    known = users.select("login", "avatar_url", "is_bot")
    named = leaderboard_counts(events).join(known, "login", "left").where(~F.coalesce("is_bot", F.lit(False)))
    return ranked(named.select("metric_key", "login", F.coalesce("avatar_url", F.lit("")).alias("avatar_url"), "value"))


def scoped_leaderboards(events: DataFrame) -> DataFrame:
    """Org and repository scope from one pass: counts per repository and person are written once, org counts are their sums."""
    long = _is_long(events)
    pairs = written(events.groupBy(*["metric_key"] * long, "repo_id", "login").agg(*([F.count("*").alias("value")] if long else _sums(events))), "pair-counts")
    per_org = pairs.groupBy(*["metric_key"] * long, "login").agg(*([F.sum("value").alias("value")] if long else _sums(pairs)))
    of_repos, of_org = (pairs, per_org) if long else (_long(pairs, "value"), _long(per_org, "value"))
    columns = ("metric_key", "scope", "repo_id", "login", "value", "rank")
    org = ranked(of_org).select("metric_key", F.lit("org").alias("scope"), F.lit(None).cast(pairs.schema["repo_id"].dataType).alias("repo_id"), "login", "value", "rank")
    repos = ranked(of_repos, "repo_id", n=2 * pairs.count()).withColumn("scope", F.lit("repo"))
    return org.unionByName(repos.select(*columns))


def top_n(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("rank") <= n)


def time_series(events: DataFrame, year: int, period_type: str = "week", *extra: str) -> DataFrame:
    """metric_key, period, login (and extra keys), count in the calendar year; weeks carry their ISO year."""
    key = iso_week_key if period_type == "week" else month_key
    kept = in_year(events, year, "ts")
    if not _is_long(events):
        counted = [m for m in SERIES if m in events.columns]
        return _long(kept.groupBy(key(F.col("ts")).alias("period"), *extra, "login").agg(*[F.sum(m).alias(m) for m in counted]), "count")
    kept = kept.where(F.col("metric_key").isin(*SERIES))
    return kept.groupBy("metric_key", key(F.col("ts")).alias("period"), *extra, "login").agg(F.count("*").alias("count"))


def repo_counters(events: DataFrame, repos: DataFrame, end: Column | None = None, days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """Per registered repository: pull requests, issues, reviews, comments, distinct people; zeros without events.

    With end, events must be facts_wide(before=end): the people of the last days before it are counted in the same grouping.
    """
    by_person = per_person(events, COUNTED, "repo_id")
    names = ["pr_count", "issue_count", "review_count", "comment_count"]
    sums = [F.sum(k).alias(c) for k, c in zip(COUNTED, names, strict=True)]
    if end is not None:
        recent = [f"active_contributors_{d}d" for d in days]
        sums += [F.count_if(F.col("last") >= end - F.expr(f"INTERVAL {d} DAYS")).alias(c) for d, c in zip(days, recent, strict=True)]
        names += recent
    counted = by_person.groupBy("repo_id").agg(F.count("*").alias("contributor_count"), *sums)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return repos.select("repo_id").distinct().join(counted, "repo_id", "left").select("repo_id", *[zero(c) for c in ("contributor_count", *names)])


def _coverage(reviewed: Column, opened: Column) -> Column:
    return F.coalesce(F.try_divide(reviewed * F.lit(100.0), opened.cast("double")), F.lit(0.0)).alias("review_coverage")


def review_coverage(prs: DataFrame, reviews: DataFrame, repos: DataFrame) -> DataFrame:
    """repo_id, review_coverage: distinct reviewed numbers over people's pull requests, in percent; it may exceed 100."""
    opened = people_only(prs).groupBy("repo_id").agg(F.count("*").alias("prs"))
    reviewed = people_only(reviews).select("repo_id", "number").distinct().groupBy("repo_id").agg(F.count("*").alias("reviewed"))
    share = _coverage(F.col("reviewed"), F.col("prs"))
    return repos.select("repo_id").distinct().join(opened, "repo_id", "left").join(reviewed, "repo_id", "left").select("repo_id", share)


def _middle(column: str, exact: bool) -> Column:
    return F.median(column) if exact else F.percentile_approx(column, 0.5).cast("double")


def merge_times(prs: DataFrame, exact: bool = True) -> DataFrame:
    """repo_id, median hours to merge of people's merged pull requests."""
    merged = people_only(prs).where("merged_at IS NOT NULL").select("repo_id", hours_between(F.col("created_at"), F.col("merged_at")).alias("hours"))
    return merged.groupBy("repo_id").agg(_middle("hours", exact).alias("median_time_to_merge"))


def first_review_hours(prs: DataFrame, reviews: DataFrame) -> DataFrame:
    """repo_id, number, hours to the earliest review of each pull request of a person. Reviews of others are ignored."""
    opened = people_only(prs).select("repo_id", "number", "created_at")
    first = people_only(reviews).groupBy("repo_id", "number").agg(F.min("submitted_at").alias("first_review"))
    return opened.join(first, ["repo_id", "number"]).select("repo_id", "number", hours_between(F.col("created_at"), F.col("first_review")).alias("hours"))


def review_times(prs: DataFrame, reviews: DataFrame, exact: bool = True) -> DataFrame:
    return first_review_hours(prs, reviews).groupBy("repo_id").agg(_middle("hours", exact).alias("median_time_to_first_review"))


def repo_health(events: DataFrame, prs: DataFrame, reviews: DataFrame, repos: DataFrame, end: Column | None = None, stale_days: int = 30) -> DataFrame:
    """The health row of every registered repository.

    Every fact table is read once for the counters; the times and the coverage come from one grouping of reviews by pull request.
    With end (and events from facts_wide(before=end)) the recently active people and the stale pull requests before it come
    from the same two groupings.
    """
    first = people_only(reviews).groupBy("repo_id", "number").agg(F.min("submitted_at").alias("first_review"))
    reviewed = first.groupBy("repo_id").agg(F.count("*").alias("reviewed"))
    person = F.col("_person")
    rows = people_only(prs).withColumn("_person", F.lit(True)) if end is None else prs.withColumn("_person", F.coalesce((F.col("login") != "") & ~is_bot(F.col("login"), F.col("user_type")), F.lit(False)))
    opened = rows.select("repo_id", "number", "created_at", "merged_at", "_person", *(["state"] if end is not None else [])).join(first, ["repo_id", "number"], "left")
    middle = lambda at, name: F.median(F.when(person, hours_between(F.col("created_at"), F.col(at)))).alias(name)
    stale = [] if end is None else [F.count_if((F.col("state") == "open") & (F.col("created_at") < end - F.expr(f"INTERVAL {stale_days} DAYS"))).alias("stale_pr_count")]
    times = opened.groupBy("repo_id").agg(middle("merged_at", "median_time_to_merge"), middle("first_review", "median_time_to_first_review"), *stale)
    counters = repo_counters(events, repos, end)
    joined = counters.join(reviewed, "repo_id", "left").join(times, "repo_id", "left")
    more = ["stale_pr_count"] if end is not None else []
    return joined.select(*counters.columns, _coverage(F.col("reviewed"), F.nullif("pr_count", F.lit(0))), "median_time_to_merge", "median_time_to_first_review", *more)


def summary(events: DataFrame, repos: DataFrame) -> DataFrame:
    """One row of totals. Contributors open pull requests or issues or review; commenters alone are not counted.

    One grouping by person; its totals are summed after.
    """
    kinds = ("prs_opened", "issues_opened", "reviews_submitted", "comments_total", "prs_merged", "issues_closed")
    names = ("total_prs", "total_issues", "total_reviews", "total_comments", "prs_merged", "issues_closed")
    by_person = per_person(events, kinds)
    active = F.col("prs_opened") + F.col("issues_opened") + F.col("reviews_submitted") > 0
    totals = by_person.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(c) for k, c in zip(kinds, names, strict=True)], F.count_if(active).alias("total_contributors"))
    return totals.join(repos.select("repo_id").distinct().agg(F.count("*").alias("total_repos")), F.lit(True))


def contributors(events: DataFrame) -> DataFrame:
    return events.where(F.col("metric_key").isin("prs_opened", "issues_opened", "reviews_submitted")).select("login").distinct()


def new_contributors(events: DataFrame, year: int) -> DataFrame:
    """login, first_at of people whose first event, as far as the input goes, is in the year; by name."""
    first = events.groupBy("login").agg(F.min("ts").alias("first_at"))
    return first.where(F.year("first_at") == year).orderBy("login")


def size_stats(details: DataFrame) -> DataFrame:
    """n, median_size, largest of the changed lines of merged pull requests with any, exact at any size."""
    some = details.where("lines_changed > 0")
    return some.agg(F.count("*").alias("n"), F.max("lines_changed").alias("largest")).join(median(some, "lines_changed", "median_size"), F.lit(True)).select("n", "median_size", "largest")


def active_weeks(events: DataFrame, year: int) -> DataFrame:
    """login, active_weeks: distinct weeks with any counted event in the year."""
    weeks = time_series(events, year).select("login", "period").distinct()
    return weeks.groupBy("login").agg(F.count("*").alias("active_weeks"))


def active_within(events: DataFrame, end: Column, days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """Per repository, distinct people in the last n days before end."""
    recent = created_within(events, end - F.expr(f"INTERVAL {max(days)} DAYS"), end, "ts").groupBy("repo_id", "login").agg(F.max("ts").alias("last"))
    return recent.groupBy("repo_id").agg(*[F.count_if(F.col("last") >= end - F.expr(f"INTERVAL {d} DAYS")).alias(f"active_contributors_{d}d") for d in days])


def stale_counts(items: DataFrame, end: Column, days: int = 30) -> DataFrame:
    """Per repository, open items created more than `days` before end."""
    return items.groupBy("repo_id").agg(F.count_if((F.col("state") == "open") & (F.col("created_at") < end - F.expr(f"INTERVAL {days} DAYS"))).alias("stale"))


def user_extras(commits: DataFrame, office: tuple[int, int] = (8, 18)) -> DataFrame:
    """login, commits, off_hours_commits, docs_commits, docs_lines_changed: a commit counts as docs if any of its files is."""
    docs_lines = F.sum(F.when(F.col("is_docs"), F.col("lines")).otherwise(0))
    by_commit = commits.groupBy("login", "sha").agg(F.min("committed_at").alias("at"), F.bool_or("is_docs").alias("docs"), docs_lines.alias("docs_lines"))
    hour = F.hour("at")
    return by_commit.groupBy("login").agg(
        F.count("*").alias("commits"), F.count_if((hour < office[0]) | (hour >= office[1])).alias("off_hours_commits"), F.count_if("docs").alias("docs_commits"),
        F.sum("docs_lines").alias("docs_lines_changed"),
    )


def first_review_of_people(reviews: DataFrame, prs: DataFrame) -> DataFrame:
    """login, avg_time_to_first_review: mean hours from opening to a reviewer's own first review of a pull request."""
    opened = people_only(prs).select("repo_id", "number", "created_at")
    own = people_only(reviews).groupBy("repo_id", "number", "login").agg(F.min("submitted_at").alias("at"))
    hours = own.join(opened, ["repo_id", "number"]).select("login", hours_between(F.col("created_at"), F.col("at")).alias("hours"))
    return hours.groupBy("login").agg(F.avg("hours").alias("avg_time_to_first_review"))


def activity_of() -> Column:
    """Pull requests, issues, reviews and comments of a row together."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in ("pr_count", "issue_count", "review_count", "comment_count")])


def activity_score(counters: DataFrame) -> DataFrame:
    """repo_id, total_activity_score."""
    return counters.select("repo_id", activity_of().alias("total_activity_score"))


def repo_standing(health: DataFrame, hygiene: DataFrame, merged: DataFrame) -> DataFrame:
    """What repository awards look at: health (with stale_pr_count) and prs_opened, total_activity_score, hygiene_score and bus_factor_risk_score.

    merged: repo_id, login, value of merged pull requests. The risk score is the activity per person of the bus factor; null where nobody merged.
    """
    scores = hygiene.groupBy("repo_id").agg(F.max("score").alias("hygiene_score"))
    rows = health.withColumns({"prs_opened": F.col("pr_count"), "total_activity_score": activity_of()})
    rows = rows.join(scores, "repo_id", "left").join(bus_factor(merged, "repo_id"), "repo_id", "left")
    return rows.withColumn("bus_factor_risk_score", F.try_divide(F.col("total_activity_score").cast("double"), F.col("bus_factor").cast("double"))).withColumn("is_bot", F.lit(False))


def bus_factor(counts: DataFrame, *within: str, share: float = 0.5) -> DataFrame:
    """The fewest top people who reach the share of all merged pull requests. counts: login, value (and keys).

    The running sum is over one row per person, after aggregation. Totals are joined: a row per key, or one row. Without
    keys an empty table gives 0, with keys no row; a null key is a key.
    """
    keys = list(within)
    totals = counts.groupBy(*keys).agg(F.sum("value").alias("_total"))
    if keys:
        totals = totals.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], "_total")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)], F.lit(True))
    before = ahead(counts, "_before", [-F.col("value"), F.col("login")], within, "value")
    return before.join(totals, same).groupBy(*keys).agg(F.count_if(F.col("_before") < F.col("_total") * share).alias("bus_factor"))
