"""Registered queries of the activity operators. A name starts with the identifiers of the operators that it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, people, texts, times
from ..operators import charts, contributors, filters, hygiene, identity, insights, joins, metrics, normalize, ranking, runs, search
from ..sources import scratch
from .star import PEOPLE, TREE_PATHS, Star, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
YEAR = 1997


def as_of():
    return F.lit("2024-12-31 00:00:00").cast("timestamp")


def end():
    return F.lit("1998-01-01 00:00:00").cast("timestamp")


def q(name: str, sql: str, dates: tuple[str, ...] = (), doubles: tuple[str, ...] = ()):
    """Register a query with its SQL. Dates are compared as texts, whole numbers that may be null as doubles."""

    def register(f: Callable[[Star], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Star(spark, sf_dir))
            return out.withColumns({c: F.col(c).cast(t) for t, names in (("string", dates), ("double", doubles)) for c in names}) if dates or doubles else out

        QUERIES[name] = run
        casts = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates] + [f"CAST({c} AS DOUBLE) AS {c}" for c in doubles]
        ORACLES[name] = oracle(f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql)
        return f

    return register


def counts(s: Star, *only: str) -> DataFrame:
    return metrics.leaderboard_counts(s.facts(*only))


def weekly(s: Star, *only: str) -> DataFrame:
    return metrics.time_series(s.facts(*(only or metrics.SERIES), timed=True), YEAR)


def health(s: Star) -> DataFrame:
    return metrics.repo_health(s.facts(*metrics.COUNTED), s.prs, s.reviews, s.repos)


def details(s: Star) -> DataFrame:
    return normalize.pr_details(s.prs, s.repos)


def users(s: Star) -> DataFrame:
    seen = s.prs.select("login", "avatar_url", "user_type").unionByName(s.reviews.select("login", "avatar_url", "user_type"))
    return normalize.user_dimension(seen.withColumn("seq", F.lit(0)), ["seq"])


def scored(s: Star) -> DataFrame:
    return s.hygiene.withColumn("score", hygiene.score())


# --- leaderboards -------------------------------------------------------------------------------------------------

for _id, _metric in enumerate(metrics.METRICS, 1):
    q(f"a{_id}_{_metric}", f"SELECT login, count(*) AS value FROM events_long WHERE metric_key = '{_metric}' GROUP BY login")(
        lambda s, m=_metric: counts(s, m).select("login", "value")
    )


@q("u1_u2_events_long", "SELECT metric_key, repo_id, login, ts, item_id FROM events_long")
def _(s: Star) -> DataFrame:
    return s.events()


@q(
    "k1_w1_j2_leaderboards",
    """SELECT metric_key, login, coalesce(avatar_url, '') AS avatar_url, value, CAST(row_number() OVER (PARTITION BY metric_key ORDER BY value DESC, login) AS INTEGER) AS rank
    FROM counts LEFT JOIN users USING (login) WHERE NOT coalesce(is_bot, false)""",
)
def leaderboards(s: Star) -> DataFrame:
    return metrics.leaderboards(s.facts(), users(s))


@q(
    "w2_d10_scoped_leaderboards",
    """SELECT metric_key, scope, repo_id, login, value, CAST(row_number() OVER (PARTITION BY metric_key, scope, repo_id ORDER BY value DESC, login) AS INTEGER) AS rank FROM (
    SELECT metric_key, 'org' AS scope, NULL AS repo_id, login, count(*) AS value FROM events_long GROUP BY metric_key, login
    UNION ALL SELECT metric_key, 'repo', repo_id, login, count(*) FROM events_long GROUP BY metric_key, repo_id, login)""",
)
def _(s: Star) -> DataFrame:
    return metrics.scoped_leaderboards(s.facts())


@q(
    "w3_k11_top_ten_per_metric",
    "SELECT * FROM (SELECT metric_key, login, value, CAST(row_number() OVER (PARTITION BY metric_key ORDER BY value DESC, login) AS INTEGER) AS rank FROM counts) WHERE rank <= 10",
)
def _(s: Star) -> DataFrame:
    return metrics.top_ranked(counts(s), 10)


@q("k2_winners", "SELECT metric_key, login, value FROM (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY value DESC, login) AS r FROM counts) WHERE r = 1")
def _(s: Star) -> DataFrame:
    return ranking.winners(counts(s))


# --- time series --------------------------------------------------------------------------------------------------

q("a10_i2_f20_weekly_series", "SELECT metric_key, period, login, count FROM weekly")(weekly)
q(
    "a11_i3_monthly_series",
    """SELECT metric_key, strftime(ts, '%Y-%m') AS period, login, count(*) AS count FROM events_long
    WHERE year(ts) = 1997 AND metric_key IN ('prs_opened','prs_merged','issues_opened','issues_closed','reviews_submitted','comments_total') GROUP BY ALL""",
)(lambda s: metrics.time_series(s.facts(*metrics.SERIES, timed=True), YEAR, "month"))
q("a21_active_weeks", "SELECT login, count(DISTINCT period) AS active_weeks FROM weekly GROUP BY login")(lambda s: metrics.active_weeks(s.facts(*metrics.SERIES, timed=True), YEAR))
q("k3_consistent_people", "SELECT login, count(DISTINCT period) AS active_weeks FROM weekly GROUP BY login ORDER BY 2 DESC, 1 LIMIT 3")(lambda s: ranking.consistent_people(metrics.active_weeks(s.facts(*metrics.SERIES, timed=True), YEAR)))
q("a22_i4_active_people", dates=("date",), sql="SELECT date, count(DISTINCT login) AS contributors FROM dated GROUP BY date")(lambda s: charts.active_people(weekly(s)))
q(
    "a23_collaboration", dates=("date",), sql="""SELECT date, CAST(coalesce(sum(count) FILTER (metric_key = 'reviews_submitted'), 0) AS BIGINT) AS reviews, CAST(coalesce(sum(count) FILTER (metric_key = 'comments_total'), 0) AS BIGINT) AS comments,
    CAST(0 AS BIGINT) AS cross_team FROM dated WHERE metric_key IN ('reviews_submitted', 'comments_total') GROUP BY date""",
)(lambda s: charts.collaboration(weekly(s, "reviews_submitted", "comments_total")))
q(
    "a24_velocity", dates=("date",), sql="""SELECT date, CAST(coalesce(sum(count) FILTER (metric_key = 'prs_opened'), 0) AS BIGINT) AS opened, CAST(coalesce(sum(count) FILTER (metric_key = 'prs_merged'), 0) AS BIGINT) AS merged,
    any_value((SELECT CAST(trunc(coalesce(avg(median_time_to_merge) FILTER (median_time_to_merge > 0), 0)) AS BIGINT) FROM health)) AS avg_merge_hours
    FROM dated WHERE metric_key IN ('prs_opened', 'prs_merged') GROUP BY date""",
)(lambda s: charts.velocity(weekly(s, "prs_opened", "prs_merged"), metrics.merge_times(s.prs).join(s.repos.select("repo_id").distinct(), "repo_id", "left_semi")))
q("a26_contribution_timeline", dates=("date",), sql="SELECT date, CAST(sum(count) AS BIGINT) AS total FROM dated GROUP BY date")(lambda s: charts.weekly_total(weekly(s)))
q("a29_merged_timeline", dates=("date",), sql="SELECT date, CAST(sum(count) AS BIGINT) AS total FROM dated WHERE metric_key = 'prs_merged' GROUP BY date")(lambda s: charts.weekly_total(weekly(s, "prs_merged"), "prs_merged"))
q(
    "a27_contribution_types",
    """SELECT type, CAST(coalesce((SELECT sum(count) FROM weekly WHERE metric_key = m), 0) AS BIGINT) AS count
    FROM (VALUES ('prs_opened', 'PRs'), ('reviews_submitted', 'Reviews'), ('issues_opened', 'Issues'), ('comments_total', 'Comments')) t(m, type)""",
)(lambda s: charts.contribution_types(weekly(s, *metrics.COUNTED)))
q(
    "a30_i6_most_active_month",
    """SELECT strftime(m, '%Y-%m') AS month, strftime(m, '%B %Y') AS label, CAST(total AS BIGINT) AS total FROM (
    SELECT date_trunc('month', date) AS m, sum(count) AS total FROM dated WHERE metric_key = 'prs_merged' GROUP BY 1) ORDER BY total DESC, m LIMIT 1""",
)(lambda s: insights.most_active_month(weekly(s, "prs_merged")))
q(
    "a31_busiest_week",
    "SELECT period, strftime(any_value(date), '%B %d, %Y') AS label, CAST(sum(count) AS BIGINT) AS total FROM dated WHERE metric_key = 'prs_opened' GROUP BY period ORDER BY total DESC, period LIMIT 1",
)(lambda s: insights.busiest_week(weekly(s, "prs_opened")))
q(
    "a51_series_stats",
    "SELECT CAST(sum(count) AS BIGINT) AS total, round(avg(count), 2) AS mean, median(count) AS median, min(count) AS min, max(count) AS max FROM weekly WHERE metric_key = 'prs_opened'",
)(lambda s: charts.series_stats(weekly(s, "prs_opened")))
q("a52_date_range", dates=("first", "last"), sql="SELECT min(date) AS first, max(date) AS last FROM dated")(lambda s: charts.date_range(charts.weekly_total(weekly(s))))
q("a53_metric_keys", "SELECT DISTINCT metric_key FROM weekly")(lambda s: charts.distinct_sorted(weekly(s), "metric_key"))
q("w9_peaks", dates=("date",), sql="SELECT date, CAST(sum(count) AS BIGINT) AS total FROM dated GROUP BY date ORDER BY total DESC, date LIMIT 5")(lambda s: ranking.peaks(charts.weekly_total(weekly(s)), 5, value="total"))
q("a57_shares", "SELECT metric_key, n, n / sum(n) OVER () AS share FROM (SELECT metric_key, CAST(sum(value) AS BIGINT) AS n FROM counts GROUP BY 1)")(
    lambda s: charts.shares(counts(s).groupBy("metric_key").agg(F.sum("value").alias("n")), "n")
)
q(
    "a56_calendar", dates=("date", "week"), sql="""SELECT d AS date, CAST(date_trunc('week', d) AS DATE) AS week, CAST(isodow(d) - 1 AS INTEGER) AS weekday, CAST(coalesce(v, 0) AS BIGINT) AS value FROM (
    SELECT CAST(unnest(generate_series((SELECT min(ts) FROM events)::DATE, (SELECT max(ts) FROM events)::DATE, INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN (
    SELECT CAST(ts AS DATE) AS d, count(*) AS v FROM events WHERE event_type = 'click' GROUP BY 1) USING (d)""",
)(lambda s: charts.calendar(s.source("events").select(F.to_date("ts").alias("date"), (F.col("event_type") == "click").cast("bigint").alias("value"))))
q("f22_complete_points", "SELECT metric_key, login, count FROM weekly WHERE period <> '' AND login <> ''")(lambda s: filters.complete_points(weekly(s), "period", "login").select("metric_key", "login", "count"))
q(
    "i23_series_points", dates=("date",), sql="SELECT CAST(ts AS DATE) AS date, CASE WHEN value <> 0 THEN value ELSE 0 END AS value FROM events",
)(lambda s: charts.series_points(s.source("events").select(F.lit(None).cast("date").alias("date"), F.to_date("ts").alias("week"), F.lit(None).cast("date").alias("month"), F.lit(0.0).alias("count"), "value")))
q(
    "i30_preferred_scope",
    """SELECT metric_key, login, scope, n FROM (SELECT *, bool_or(scope = 'repo') OVER (PARTITION BY metric_key, login) AS any_repo FROM (
    SELECT metric_key, login, CASE WHEN repo_id LIKE '%7' THEN 'repo' ELSE 'org' END AS scope, count(*) AS n FROM events_long GROUP BY ALL)) WHERE (scope = 'repo') = any_repo""",
)(
    lambda s: charts.preferred_scope(
        s.events().groupBy("metric_key", "login", F.when(F.col("repo_id").endswith("7"), "repo").otherwise("org").alias("scope")).agg(F.count("*").alias("n")), ["metric_key", "login"]
    ).select("metric_key", "login", "scope", "n")
)
q("s16_rows_of_columns", "SELECT CAST(l_orderkey AS BIGINT) AS k, l_quantity AS v FROM lineitem")(
    lambda s: charts.rows_of_columns(s.source("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_orderkey", "l_quantity")).alias("x")).select(F.col("x.l_orderkey").alias("k"), F.col("x.l_quantity").alias("v")), "k", "v")
)
q("f27_period_type", "SELECT metric_key, login, period, count FROM weekly")(
    lambda s: filters.of_period_type(weekly(s).withColumn("period_type", F.lit("week")), "week").select("metric_key", "login", "period", "count")
)

# --- repository health --------------------------------------------------------------------------------------------

q("a12_a13_repo_counters", "SELECT repo_id, contributor_count, pr_count, issue_count, review_count, comment_count FROM health")(lambda s: metrics.repo_counters(s.facts(*metrics.COUNTED), s.repos))
q("a14_i14_review_coverage", "SELECT repo_id, review_coverage FROM health")(lambda s: metrics.review_coverage(s.prs, s.reviews, s.repos))
q("a15_merge_times", "SELECT repo_id, median(merge_time) AS median_time_to_merge FROM (SELECT repo_id, (epoch_us(merged_at) - epoch_us(created_at)) / 3.6e9 AS merge_time FROM events_long JOIN prs USING (repo_id) WHERE metric_key = 'prs_merged' AND item_id = number) GROUP BY repo_id")(
    lambda s: metrics.merge_times(s.prs)
)
q("j1_w6_i5_first_review_hours", "SELECT repo_id, number, h AS hours FROM first_review")(lambda s: metrics.first_review_hours(s.prs, s.reviews))
q("a16_review_times", "SELECT repo_id, median(h) AS median_time_to_first_review FROM first_review GROUP BY repo_id")(lambda s: metrics.review_times(s.prs, s.reviews))
q("j12_k13_repo_health", "SELECT * FROM health")(health)
q(
    "a17_a18_summary",
    """SELECT count(*) FILTER (metric_key = 'prs_opened') AS total_prs, count(*) FILTER (metric_key = 'issues_opened') AS total_issues, count(*) FILTER (metric_key = 'reviews_submitted') AS total_reviews,
    count(*) FILTER (metric_key = 'comments_total') AS total_comments, count(*) FILTER (metric_key = 'prs_merged') AS prs_merged, count(*) FILTER (metric_key = 'issues_closed') AS issues_closed,
    count(DISTINCT login) FILTER (metric_key IN ('prs_opened', 'issues_opened', 'reviews_submitted')) AS total_contributors, (SELECT count(DISTINCT repo_id) FROM repos) AS total_repos FROM events_long""",
)(lambda s: metrics.summary(s.facts(*metrics.SERIES), s.repos))
q("a19_k6_new_contributors", "SELECT login, min(ts) AS first_at FROM events_long GROUP BY login HAVING year(min(ts)) = 1997")(lambda s: metrics.new_contributors(s.events(), YEAR))
q("a20_a38_size_stats", "SELECT count(*) AS n, median(lines_changed) AS median_size, max(lines_changed) AS largest FROM details WHERE lines_changed > 0")(lambda s: metrics.size_stats(details(s)))
q("p5_pr_details", "SELECT * FROM details")(details)
q("k4_largest_changes", "SELECT * FROM details WHERE lines_changed > 0 ORDER BY lines_changed DESC, repo_id, number LIMIT 5")(lambda s: ranking.largest_changes(details(s)))
q(
    "k5_f26_i8_fastest_merges",
    """SELECT *, CASE WHEN merge_time_hours < 1 THEN CAST(CAST(trunc(merge_time_hours * 60) AS BIGINT) AS VARCHAR) || 'm' WHEN merge_time_hours < 24 THEN format('{:.1f}h', merge_time_hours)
    ELSE format('{:.1f}d', merge_time_hours / 24) END AS duration FROM details WHERE merge_time_hours >= 1.0 / 60 ORDER BY merge_time_hours, repo_id, number LIMIT 5""",
)(lambda s: ranking.fastest_merges(details(s)))
q("a28_k7_repo_contributions", "SELECT repo_id, pr_count + issue_count + review_count + comment_count AS contributions FROM health WHERE pr_count + issue_count + review_count + comment_count > 0 ORDER BY 2 DESC, 1 LIMIT 10")(
    lambda s: ranking.repo_contributions(metrics.repo_counters(s.facts(*metrics.COUNTED), s.repos))
)
q(
    "k9_repo_awards",
    """(SELECT 'most_active' AS award, repo_id, CAST(pr_count AS DOUBLE) AS value FROM health WHERE pr_count > 0 ORDER BY value DESC, repo_id LIMIT 1)
    UNION ALL (SELECT 'best_reviewed', repo_id, review_coverage AS value FROM health WHERE review_coverage > 0 ORDER BY value DESC, repo_id LIMIT 1)
    UNION ALL (SELECT 'most_collaborative', repo_id, CAST(contributor_count AS DOUBLE) AS value FROM health WHERE contributor_count > 0 ORDER BY value DESC, repo_id LIMIT 1)""",
)(lambda s: ranking.repo_awards(health(s)))
q("k8_repos_by_merges", "SELECT repo_id, count(*) AS merged FROM events_long WHERE metric_key = 'prs_merged' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(
    lambda s: ranking.top_k(s.events("prs_merged").groupBy("repo_id").agg(F.count("*").alias("merged")), 10, F.desc("merged"), F.col("repo_id"))
)
q("a41_w4_bus_factor", "SELECT count(*) FILTER (b < 0.5 * t) AS bus_factor FROM (SELECT coalesce(sum(value) OVER (ORDER BY value DESC, login ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(value) OVER () AS t FROM counts WHERE metric_key = 'prs_merged')")(
    lambda s: metrics.bus_factor(counts(s, "prs_merged"))
)
q(
    "d9_bus_factor_per_repo",
    """SELECT repo_id, count(*) FILTER (b < 0.5 * t) AS bus_factor FROM (SELECT repo_id, coalesce(sum(v) OVER (PARTITION BY repo_id ORDER BY v DESC, login ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    sum(v) OVER (PARTITION BY repo_id) AS t FROM (SELECT repo_id, login, count(*) AS v FROM events_long WHERE metric_key = 'prs_merged' GROUP BY 1, 2)) GROUP BY repo_id""",
)(lambda s: metrics.bus_factor(metrics.leaderboard_counts(s.facts("prs_merged"), "repo_id").drop("metric_key"), "repo_id"))
q(
    "d4_active_within",
    """SELECT repo_id, count(DISTINCT login) FILTER (ts >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY) AS active_contributors_30d, count(DISTINCT login) FILTER (ts >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY) AS active_contributors_90d,
    count(DISTINCT login) AS active_contributors_365d FROM events_long WHERE ts < TIMESTAMP '1998-01-01' AND ts >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY GROUP BY repo_id""",
)(lambda s: metrics.active_within(s.facts(*metrics.SERIES, timed=True), end()))
q("d5_stale_prs", "SELECT repo_id, count(*) FILTER (state = 'open' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY) AS stale FROM prs GROUP BY repo_id")(lambda s: metrics.stale_counts(s.prs, end()))
q("w10_k12_visible_rank", "SELECT repo_id, pr_count, CAST(row_number() OVER (ORDER BY pr_count DESC, repo_id) AS INTEGER) AS position FROM health")(
    lambda s: ranking.visible_rank(metrics.repo_counters(s.facts(*metrics.COUNTED), s.repos).select("repo_id", "pr_count"), "pr_count", "repo_id")
)
q("u4_numbers_per_repo", "SELECT DISTINCT repo_id, number FROM reviews")(lambda s: joins.numbers_per_repo(s.reviews))
q("u5_union_comments", "SELECT repo_id, number, CASE comment_type WHEN 'issue' THEN 'issue' ELSE 'review' END AS comment_type FROM comments")(
    lambda s: joins.union_comments(s.comments.where("comment_type = 'issue'"), s.comments.where("comment_type <> 'issue'")).select("repo_id", "number", "comment_type")
)
q("j6_of_collected", "SELECT repo_id, number, login, state FROM reviews WHERE (repo_id, number) IN (SELECT repo_id, number FROM prs WHERE merged_at IS NOT NULL)")(
    lambda s: joins.of_collected(s.reviews, s.prs.where("merged_at IS NOT NULL"), ["repo_id", "number"]).select("repo_id", "number", "login", "state")
)
q("a36_a35_a37_a39_insights", """SELECT CASE WHEN t.prs = 0 THEN 0 ELSE t.reviews / t.prs END AS avg_reviewers_per_pr, 100.0 * r / p AS review_participation_rate, t.merged / 52.0 AS prs_per_week,
    (SELECT CAST(trunc(median(lines_changed)) AS BIGINT) FROM details WHERE lines_changed > 0) AS median_pr_size, 100.0 * t.merged / t.prs AS merge_rate
    FROM (SELECT count(*) FILTER (metric_key = 'prs_opened') AS prs, CAST(count(*) FILTER (metric_key = 'reviews_submitted') AS DOUBLE) AS reviews, CAST(count(*) FILTER (metric_key = 'prs_merged') AS DOUBLE) AS merged,
    count(DISTINCT login) FILTER (metric_key = 'reviews_submitted') AS r, count(DISTINCT login) FILTER (metric_key IN ('prs_opened', 'issues_opened', 'reviews_submitted')) AS p FROM events_long) t""")(
    lambda s: insights.insights(s.facts("prs_opened", "issues_opened", "reviews_submitted"), metrics.summary(s.facts(*metrics.SERIES), s.repos), metrics.size_stats(details(s)))
)
q("a32_i9_mean_merge_text", """SELECT h AS hours, CASE WHEN h < 1 THEN format('{:.0f} minutes', h * 60) WHEN h < 24 THEN format('{:.1f} hours', h) ELSE format('{:.1f} days', h / 24) END AS label
    FROM (SELECT avg(median_time_to_merge) FILTER (median_time_to_merge > 0) AS h FROM health)""")(lambda s: insights.mean_merge_text(metrics.merge_times(s.prs).join(s.repos.select("repo_id"), "repo_id", "left_semi")))  # fmt: skip
q("a33_a34_i10_review_facts", """SELECT r / p AS reviews_per_pr, least(round(100 * r / p, 0), 100.0) AS coverage, format('{:,}', c) AS comments_text FROM (SELECT CAST(count(*) FILTER (metric_key = 'reviews_submitted') AS DOUBLE) AS r,
    count(*) FILTER (metric_key = 'prs_opened') AS p, count(*) FILTER (metric_key = 'comments_total') AS c FROM events_long)""")(lambda s: insights.review_facts(metrics.summary(s.facts(*metrics.SERIES), s.repos)))  # fmt: skip
q("a44_health_signals", """SELECT avg(review_coverage) AS avg_coverage, format('{:.1f} days', avg(median_time_to_merge) FILTER (median_time_to_merge > 0) / 24) AS merge_time,
    CAST(coalesce(sum(stale), 0) AS BIGINT) AS stale_prs, avg(contributor_count) AS avg_contributors FROM health
    LEFT JOIN (SELECT repo_id, count(*) FILTER (state = 'open' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY) AS stale FROM prs GROUP BY 1) USING (repo_id)""")(
    lambda s: insights.health_signals(health(s).join(metrics.stale_counts(s.prs, end()).withColumnRenamed("stale", "stale_pr_count"), "repo_id", "left"))
)
q("a55_f21_summary_from_metrics", """SELECT CAST(sum(value) FILTER (metric_key = 'prs_merged') AS BIGINT) AS prs_merged, CAST(sum(value) FILTER (metric_key = 'reviews_submitted') AS BIGINT) AS total_reviews,
    count(DISTINCT login) AS total_contributors, any_value((SELECT count(DISTINCT repo_id) FROM events_long)) AS total_repos FROM counts""")(lambda s: insights.summary_from_metrics(metrics.scoped_leaderboards(s.facts())))  # fmt: skip

# --- people -------------------------------------------------------------------------------------------------------

_ALL = ", ".join(metrics.METRICS)
q("j4_a60_contributor_merge", f"SELECT login, {_ALL}, prs_merged + prs_opened + reviews_submitted + issues_opened + issues_closed + comments_total AS contributions_total FROM merged")(lambda s: contributors.with_total(contributors.merge_metrics(counts(s))))
q("j7_contributors_ranked", f"""SELECT login, {_ALL}, contributions_total, CAST(row_number() OVER (ORDER BY contributions_total DESC, login) AS INTEGER) AS rank, coalesce(avatar_url, '') AS avatar_url
    FROM (SELECT *, prs_merged + prs_opened + reviews_submitted + issues_opened + issues_closed + comments_total AS contributions_total FROM merged) LEFT JOIN users USING (login)""")(
    lambda s: contributors.contributors(counts(s), users(s))
)
q("a59_j5_sparklines", "SELECT login, list(n ORDER BY period) AS activity FROM (SELECT login, period, CAST(sum(count) AS BIGINT) AS n FROM weekly GROUP BY 1, 2) GROUP BY login")(lambda s: contributors.sparklines(weekly(s)))
q("d11_overall", """SELECT login, t AS overall_score, prs_merged, reviews_submitted, issues_closed, comments_total, CAST(row_number() OVER (ORDER BY t DESC, login) AS INTEGER) AS rank
    FROM (SELECT *, prs_merged + prs_opened + reviews_submitted + issues_opened + issues_closed + comments_total AS t FROM merged)""")(lambda s: contributors.overall(counts(s)))  # fmt: skip
q("j10_i27_compare", """SELECT m AS metric, a AS value_a, b AS value_b, 100.0 * a / greatest(a, b, 1) AS percent_a, 100.0 * b / greatest(a, b, 1) AS percent_b FROM (
    SELECT m, coalesce(max(value) FILTER (login = 'user1'), 0) AS a, coalesce(max(value) FILTER (login = 'user2'), 0) AS b
    FROM (VALUES ('prs_opened'), ('prs_merged'), ('reviews_submitted'), ('approvals'), ('issues_opened'), ('issues_closed'), ('comments_total')) t(m) LEFT JOIN counts ON metric_key = m GROUP BY m)""")(
    lambda s: contributors.compare(contributors.merge_metrics(counts(s)), "user1", "user2")
)
q("p3_w5_t2_user_dimension", "SELECT login, avatar_url, user_type AS type, is_bot FROM users")(users)
q("p4_export_users", "SELECT login, avatar_url, user_type AS type FROM users WHERE NOT is_bot")(lambda s: normalize.export_users(users(s)))
q("f17_bot_predicate", "SELECT number, repo_id, login NOT IN (SELECT login FROM users WHERE NOT is_bot) OR login IS NULL OR user_type = 'Bot' AS is_bot FROM prs")(
    lambda s: s.prs.select("number", "repo_id", people.is_bot(F.col("login"), F.col("user_type")).alias("is_bot"))
)
q("f18_d3_bot_reason", """SELECT number, CASE WHEN login IN ('user1') THEN 'override: bot' WHEN user_type = 'Bot' THEN 'type' WHEN regexp_matches(login, '^(?:.*\\[bot\\]$)') THEN 'pattern: .*\\[bot\\]$' ELSE 'human' END AS reason FROM prs""")(
    lambda s: s.prs.select("number", people.bot_reason(F.col("login"), F.col("user_type"), bots=("user1",)).alias("reason"))
)
q("f19_with_login", "SELECT number, login FROM prs WHERE login IS NOT NULL AND login <> ''")(lambda s: filters.with_login(s.prs).select("number", "login"))
q("f23_search_people", "SELECT login FROM users WHERE contains(lower(login), 'r1')")(lambda s: filters.name_contains(users(s), "login", "R1").select("login"))
q("f24_s14_global_search", """SELECT * FROM (SELECT 'contributor' AS kind, login AS name, value AS weight FROM counts WHERE metric_key = 'prs_opened'
    UNION ALL SELECT 'repository', repo_id, count(*) FROM events_long WHERE metric_key = 'prs_merged' GROUP BY repo_id) WHERE contains(lower(name), 'er12') ORDER BY kind, weight DESC, name LIMIT 5""")(
    lambda s: search.global_search(_index(s), "er12")
)
q("s14_search_index", """SELECT 'contributor' AS kind, login AS name, value AS weight FROM counts WHERE metric_key = 'prs_opened'
    UNION ALL SELECT 'repository', repo_id, count(*) FROM events_long WHERE metric_key = 'prs_merged' GROUP BY repo_id""")(lambda s: _index(s))  # fmt: skip


def _index(s: Star) -> DataFrame:
    people_ = counts(s, "prs_opened").select("login", F.col("value").alias("total_prs"))
    repos_ = s.events("prs_merged").groupBy(F.col("repo_id").alias("repo_full_name")).agg(F.count("*").alias("prs_merged"))
    return search.search_index(people_, repos_)


# --- repository filters and dimensions ----------------------------------------------------------------------------

CHAIN = filters.RepoFilters(
    visibility="public", pushed_within_days=200, min_kb=300, max_kb=4500, exclude_languages=("Brand#3",), require_any_topics=("red", "blue", "small", "large"), exclude_topics=("gear",), exclude_names=(r"^repo1\d$",)
)
_FIRST = """CASE WHEN fork THEN 'fork' WHEN archived THEN 'archive' WHEN coalesce(visibility, CASE WHEN private THEN 'private' ELSE 'public' END) <> 'public' THEN 'visibility'
    WHEN NOT coalesce(try_cast(pushed_at AS TIMESTAMP) >= TIMESTAMP '2024-12-31' - INTERVAL 200 DAY, false) THEN 'activity' WHEN size_kb NOT BETWEEN 300 AND 4500 THEN 'size'
    WHEN coalesce(language = 'Brand#3', false) THEN 'language' WHEN list_has_any(topics, ['gear']) OR NOT list_has_any(topics, ['red', 'blue', 'small', 'large']) THEN 'topics'
    WHEN regexp_matches(name, '^repo1\\d$') THEN 'name' END"""


def _simple(name: str, column, sql: str) -> None:
    q(name, f"SELECT repo_id FROM repos WHERE {sql}")(lambda s: s.repos.where(column()).select("repo_id"))


C = filters.RepoFilters
_simple("f1_fork", lambda: filters.fork_ok(C()), "NOT fork")
_simple("f2_archive", lambda: filters.archive_ok(C()), "NOT archived")
_simple("f3_visibility", lambda: filters.visibility_ok(C(visibility="private")), "coalesce(visibility, CASE WHEN private THEN 'private' ELSE 'public' END) = 'private'")
_simple("f4_i1_activity", lambda: filters.activity_ok(C(pushed_within_days=100), as_of()), "coalesce(try_cast(pushed_at AS TIMESTAMP) >= TIMESTAMP '2024-12-31' - INTERVAL 100 DAY, false)")
_simple("f5_size", lambda: filters.size_ok(C(min_kb=1000, max_kb=2000)), "size_kb BETWEEN 1000 AND 2000")
_simple("f6_language", lambda: filters.language_ok(C(include_languages=("Brand#1", "Brand#2"), exclude_languages=("Brand#2",))), "language = 'Brand#1'")
_simple("f7_u3_topics", lambda: filters.topics_ok(C(require_all_topics=("red",), exclude_topics=("gear",))), "list_contains(topics, 'red') AND NOT list_contains(topics, 'gear')")
_simple("f8_name_pattern", lambda: filters.name_ok(C(include_names=(r"9$", r"^repo1"), exclude_names=(r"repo\d$",))), "(regexp_matches(name, '9$') OR regexp_matches(name, '^repo1')) AND NOT regexp_matches(name, 'repo\\d$')")
q("f9_filter_chain", f"SELECT repo_id, {_FIRST} AS reject_filter FROM repos")(lambda s: filters.apply_filter_chain(s.repos, CHAIN, as_of()).select("repo_id", "reject_filter"))
q("f10_rejection_stats", f"""SELECT f AS filter, count(*) AS rejected, any_value(d) AS discovered, any_value(p) AS passed FROM (SELECT f, count(*) OVER () AS d, count(*) FILTER (f IS NULL) OVER () AS p
    FROM (SELECT {_FIRST} AS f FROM repos)) WHERE f IS NOT NULL GROUP BY f""")(lambda s: filters.rejection_stats(filters.apply_filter_chain(s.repos, CHAIN, as_of())))  # fmt: skip
q("f11_created_within", "SELECT number FROM prs WHERE created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1998-01-01'")(lambda s: filters.created_within(s.prs, F.lit("1997-01-01").cast("timestamp"), end()).select("number"))
q("f12_updated_within", "SELECT number FROM prs WHERE updated_at >= TIMESTAMP '1997-01-01' AND updated_at < TIMESTAMP '1998-01-01'")(lambda s: filters.updated_within(s.prs, F.lit("1997-01-01").cast("timestamp"), end()).select("number"))
q("f13_page_all_older", "SELECT number // 100 AS page, bool_and(updated_at < TIMESTAMP '2001-08-01') AS all_older FROM prs GROUP BY 1")(
    lambda s: filters.page_all_older(s.prs.withColumn("page", F.floor(F.col("number") / 100)), "page", "updated_at", F.lit("2001-08-01").cast("timestamp"))
)
q("f14_real_issues", "SELECT number FROM issues WHERE NOT is_pull_request")(lambda s: filters.split_issues(s.issues)[0].select("number"))
q("f15_updated_before", "SELECT number FROM issues WHERE updated_at < TIMESTAMP '2024-01-15'")(lambda s: filters.updated_before(s.issues, F.lit("2024-01-15").cast("timestamp")).select("number"))
q("f16_commit_window", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")(
    lambda s: filters.commit_window(s.source("events"), F.lit("2024-01-20").cast("timestamp"), since_days=7, column="ts").select("event_id")
)
q("f20_in_year", "SELECT number FROM prs WHERE year(created_at) = 1997")(lambda s: filters.in_year(s.prs, YEAR, "created_at").select("number"))
q("p1_repo_metadata", "SELECT id, name, full_name, description, language, archived, private, fork, visibility, pushed_at, default_branch FROM repos")(lambda s: normalize.repo_metadata(s.repos).drop("topics"))
q("p2_repo_dimension", "SELECT repo_id, name, description, coalesce(language, '') AS language, stars FROM repos")(lambda s: normalize.repo_dimension(s.repos.select("repo_id", "name", "description", "language", "stars", "id"), ["id"]))
q("p17_default_branch", "SELECT repo_id, coalesce(nullif(default_branch, ''), 'main') AS branch FROM repos")(lambda s: s.repos.select("repo_id", normalize.default_branch(F.lit(None).cast("string"), F.col("default_branch")).alias("branch")))
q("p18_split_repo_name", "SELECT split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS repo FROM repos")(lambda s: normalize.split_repo_name(s.repos)[0].select("owner", "repo"))
q("p19_repo_of", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'org/nested' || user_id WHEN 3 THEN NULL ELSE 'org/repo' || event_id % 2100 END AS repo FROM events""")(
    lambda s: s.source("events").select("event_id", normalize.repo_of(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("org/nested"), "user_id")).otherwise(""), F.concat(
        F.when(F.col("event_id") % 4 == 3, "https://api.example.org/users/").otherwise("https://api.example.org/repos/"), F.lit("org/repo"), F.col("event_id") % 2100, F.lit("/issues/"), "event_id", F.lit("/comments"))).alias("repo"))
)
q("s6_repo_from_file", "SELECT repo_id AS repo FROM repos")(lambda s: s.repos.select(_records().repo_from_file(F.concat(_records().file_of_repo(F.col("repo_id")), F.lit(".jsonl"))).alias("repo")))
q("s13_k15_years", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) BETWEEN 2000 AND 2100")(lambda s: _records().years(s.source("orders").select(F.year("o_orderdate").alias("year"))))
q("s15_csv_ready", "SELECT trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS c_name, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer")(lambda s: _records().csv_ready(s.source("customer").select("c_name", "c_custkey")))
q("p20_j11_year_navigation", doubles=("contributors", "prs_merged"), sql="""SELECT CAST(y AS INTEGER) AS year, '/' || y || '/' AS path, 'Year ' || y AS description, y = 2001 AS is_current, m IS NULL AS is_coming_soon, c AS contributors, m AS prs_merged
    FROM (SELECT DISTINCT year(created_at) AS y FROM prs WHERE year(created_at) >= 2000) LEFT JOIN (SELECT year(ts) AS y, count(DISTINCT login) AS c, count(*) AS m FROM events_long WHERE metric_key = 'prs_merged' AND year(ts) < 2001 GROUP BY 1) USING (y)""")(
    lambda s: normalize.year_navigation(
        _records().years(s.prs.select(F.year("created_at").alias("year"))),
        s.events("prs_merged").where("year(ts) < 2001").groupBy(F.year("ts").alias("year")).agg(F.count_distinct("login").alias("contributors"), F.count("*").alias("prs_merged")),
        2001,
    )
)
q("p21_report_summary", """SELECT count(*) FILTER (metric_key = 'prs_opened') AS prs_opened, count(*) FILTER (metric_key = 'prs_merged') AS prs_merged, count(*) FILTER (metric_key = 'reviews_submitted') AS reviews,
    count(*) FILTER (metric_key = 'comments_total') AS comments, count(DISTINCT login) FILTER (metric_key IN ('prs_opened', 'issues_opened', 'reviews_submitted')) AS contributors, (SELECT count(*) FROM repos) AS repos FROM events_long""")(
    lambda s: normalize.report_summary(metrics.summary(s.facts(*metrics.SERIES), s.repos))
)
q("p6_i15_leaderboard_rows", "SELECT 'x' AS metric_key, o_orderpriority AS login, '' AS avatar_url, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey % 3 END AS value FROM orders")(
    lambda s: normalize.leaderboard_rows(s.source("orders").select(F.lit("x").alias("metric_key"), F.lit("").alias("login"), F.col("o_orderpriority").alias("user"), F.lit(None).cast("string").alias("avatar_url"), (F.col("o_orderkey") % 3).alias("value"), F.col("o_custkey").alias("count")))
)
q("p8_metric_leaderboards", """SELECT metric_key, login, coalesce(avatar_url, '') AS avatar_url, value, CAST(row_number() OVER (PARTITION BY metric_key ORDER BY value DESC, login) AS INTEGER) AS rank FROM counts LEFT JOIN users USING (login)""")(
    lambda s: normalize.metric_leaderboards(metrics.scoped_leaderboards(s.facts()).withColumnRenamed("login", "user_id"), users(s))
)
q("p9_metric_series", "SELECT 'weekly' AS granularity, metric_key, period, login, count FROM weekly")(
    lambda s: normalize.metric_series(weekly(s).select("metric_key", "period", "login", F.col("count").alias("value"), F.lit("org").alias("scope"), F.lit("week").alias("period_type")))
)
q("p7_i26_award_lists", """SELECT award_key, 'individual' AS category, title, description, login AS winner_name, CAST(value AS VARCHAR) || ' ' || unit AS supporting_stats FROM (
    SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY value DESC, login) AS r FROM counts) JOIN (VALUES ('prs_opened', 'top_pr_author', 'Top PR Author', 'Most pull requests opened', 'PRs opened'),
    ('reviews_submitted', 'top_reviewer', 'Top Reviewer', 'Most reviews submitted', 'reviews'), ('issues_opened', 'top_issue_opener', 'Top Issue Opener', 'Most issues opened', 'issues')) t(metric_key, award_key, title, description, unit) USING (metric_key) WHERE r = 1""")(
    lambda s: normalize.award_lists(
        ranking.winners(counts(s)).select(
            F.when(F.col("metric_key") == "prs_opened", "top_pr_author").when(F.col("metric_key") == "reviews_submitted", "top_reviewer").when(F.col("metric_key") == "issues_opened", "top_issue_opener").alias("award_key"),
            F.col("login").alias("user"), F.col("value").alias("count"),
        )
    )
)
q("p10_metric_awards", "SELECT repo_id AS winner_repo_id, 'repository' AS category, repo_id AS repo_name FROM repos WHERE stars % 2 = 0")(
    lambda s: normalize.metric_awards(s.repos.select(F.col("repo_id").alias("winner_repo_id"), F.when(F.col("stars") % 2 == 0, "repository").otherwise("unknown").alias("category")))
)


def _records():
    from ..sources import records

    return records


# --- hygiene ------------------------------------------------------------------------------------------------------

_TALL = "(CASE WHEN dependabot_enabled IS NULL THEN 1 ELSE 0 END + CASE WHEN secret_scanning_enabled IS NULL THEN 1 ELSE 0 END)"
q("i17_hygiene_score", "SELECT repo_id, score FROM scored")(lambda s: scored(s).select("repo_id", "score"))
q("i16_file_flags", """SELECT repo_id, coalesce(bool_or(upper(path) IN ('README.MD', 'README')), false) AS has_readme, coalesce(bool_or(path IN ('SECURITY.md', 'security.md', '.github/SECURITY.md')), false) AS has_security_md,
    coalesce(bool_or(path IN ('CODEOWNERS', '.github/CODEOWNERS', 'docs/CODEOWNERS')), false) AS has_codeowners, coalesce(bool_or(path IN ('CONTRIBUTING.md', 'contributing.md', '.github/CONTRIBUTING.md')), false) AS has_contributing,
    coalesce(bool_or(starts_with(upper(path), 'LICENSE')), false) AS has_license, coalesce(bool_or(starts_with(path, '.github/workflows/') OR path IN ('.travis.yml', 'Jenkinsfile')), false) AS has_ci_workflows
    FROM repos LEFT JOIN tree USING (repo_id) GROUP BY repo_id""")(lambda s: hygiene.file_flags(s.tree, s.repos))  # fmt: skip
_VIEW = """SELECT repo_id, m AS prs_merged, a AS active_contributors_365d, CASE WHEN meaningful THEN coalesce(nullif(score, 0), 25 * CAST(coalesce(branch_protection_enabled, false) AS INT)) END AS hygiene_score, meaningful,
    CASE WHEN meaningful THEN CASE WHEN coalesce(nullif(score, 0), 0) >= 50 THEN 'healthy' WHEN coalesce(nullif(score, 0), 0) >= 30 THEN 'warning' ELSE 'critical' END
    ELSE CASE WHEN coalesce(m, 0) >= 5 OR coalesce(a, 0) >= 3 THEN 'healthy' WHEN coalesce(m, 0) >= 1 OR coalesce(a, 0) >= 1 THEN 'warning' ELSE 'critical' END END AS health_status
    FROM (SELECT *, coalesce(has_readme OR has_security_md OR has_codeowners OR has_ci_workflows OR has_contributing OR coalesce(dependabot_enabled, false) OR coalesce(secret_scanning_enabled, false), false) AS meaningful FROM scored)
    LEFT JOIN (SELECT repo_id, count(*) AS m FROM events_long WHERE metric_key = 'prs_merged' GROUP BY 1) USING (repo_id)
    LEFT JOIN (SELECT repo_id, count(DISTINCT login) AS a FROM events_long WHERE ts < TIMESTAMP '1998-01-01' AND ts >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY GROUP BY 1) USING (repo_id)"""


def view(s: Star) -> DataFrame:
    merged = s.events("prs_merged").groupBy("repo_id").agg(F.count("*").alias("prs_merged"))
    active = metrics.active_within(s.facts(*metrics.SERIES, timed=True), end()).select("repo_id", "active_contributors_365d")
    base = s.repos.select("repo_id").distinct().join(merged, "repo_id", "left").join(active, "repo_id", "left")
    return hygiene.with_status(base, scored(s))


q("i18_i19_j3_health_status", doubles=("prs_merged", "active_contributors_365d", "hygiene_score"), sql=f"SELECT repo_id, prs_merged, active_contributors_365d, hygiene_score, health_status FROM ({_VIEW})")(view)
q("f25_with_status", f"SELECT repo_id FROM ({_VIEW}) WHERE health_status = 'warning'")(lambda s: filters.with_status(view(s), "warning").select("repo_id"))
q("a43_repo_summary", f"""SELECT count(*) FILTER (health_status = 'healthy') AS healthy_count, count(*) FILTER (health_status = 'warning') AS warning_count, count(*) FILTER (health_status = 'critical') AS critical_count,
    avg(hygiene_score) AS avg_score, avg(active_contributors_365d) AS avg_contributors FROM ({_VIEW})""")(lambda s: hygiene.repo_summary(view(s)))  # fmt: skip
q("a42_hygiene_aggregate", """SELECT count(*) FILTER (has_security_md) AS security_md_count, count(*) FILTER (dependabot_enabled OR secret_scanning_enabled) AS security_features_count, count(*) FILTER (has_codeowners) AS codeowners_count,
    count(*) FILTER (branch_protection_enabled) AS branch_protection_count, count(*) FILTER (has_ci_workflows) AS ci_workflows_count, avg(CAST(has_ci_workflows AS INT)) AS avg_workflows, count(*) FILTER (has_readme) AS readme_count,
    count(*) FILTER (has_contributing) AS contributing_count FROM hygiene""")(lambda s: hygiene.hygiene_aggregate(s.hygiene))  # fmt: skip
_PRACTICES = {"ci": "has_ci_workflows", "codeowners": "has_codeowners", "security": "has_security_md", "protection": "branch_protection_enabled"}
q("a25_adoption", " UNION ALL ".join(f"SELECT '{n}' AS practice, 100.0 * avg(CAST(coalesce({f}, false) AS INT)) AS percent FROM hygiene" for n, f in _PRACTICES.items()))(lambda s: hygiene.adoption(s.hygiene, _PRACTICES))
q("a40_practice_shares", "SELECT round(100 * avg(CAST(has_ci_workflows AS INT))) AS ci_percent, round(100 * avg(CAST(has_codeowners AS INT))) AS codeowners_percent, round(100 * avg(CAST(has_security_md AS INT))) AS security_percent FROM hygiene")(lambda s: insights.practice_shares(s.hygiene))
_FLAGS = ["has_readme", "has_license", "branch_protection_enabled"]
q("a61_have_and_missing", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS practice, CASE WHEN coalesce({f}, false) THEN 'have' ELSE 'missing' END AS slice, count(*) AS count FROM hygiene GROUP BY 2" for f in _FLAGS) + ")")(lambda s: hygiene.have_and_missing(s.hygiene, _FLAGS))
q("p16_hygiene_breakdown", " UNION ALL ".join(f"SELECT repo_id, score, '{f}' AS practice, coalesce({f}, false) AS present FROM scored" for f in _FLAGS))(lambda s: normalize.hygiene_breakdown(scored(s), _FLAGS))
q("a54_score_bins", "SELECT CASE WHEN score >= 80 THEN '80-100' WHEN score >= 60 THEN '60-79' WHEN score >= 40 THEN '40-59' ELSE '0-39' END AS bin, count(*) AS repos FROM scored GROUP BY 1")(lambda s: hygiene.score_bins(scored(s)))
q("a58_score_range", "SELECT avg(score) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM scored")(lambda s: hygiene.score_range(scored(s)))
q("k14_by_score", "SELECT repo_id, score FROM scored ORDER BY score DESC, repo_id LIMIT 15")(lambda s: hygiene.by_score(scored(s), 15))
q("a45_access_tally", f"SELECT CASE {_TALL} WHEN 0 THEN 'all' WHEN 2 THEN 'none' ELSE 'partial' END AS access, count(*) AS repos FROM hygiene GROUP BY 1")(lambda s: hygiene.access_tally(s.hygiene, ["dependabot_enabled", "secret_scanning_enabled"]))
q("a46_i22_protection_tally", "SELECT CASE WHEN branch_protection_enabled THEN 'enabled' WHEN NOT branch_protection_enabled THEN 'disabled' ELSE 'denied' END AS protection, count(*) AS repos FROM hygiene GROUP BY 1")(
    lambda s: hygiene.protection_tally(s.hygiene.withColumnRenamed("branch_protection_enabled", "protection_enabled"))
)
q("a50_metadata_access", """SELECT count(*) FILTER (NOT f) AS processed, count(*) FILTER (f) AS failed, count(*) FILTER (NOT f AND p IS NOT NULL) AS protection_readable, count(*) FILTER (NOT f AND p IS NULL) AS protection_hidden
    FROM (SELECT has_license AS f, branch_protection_enabled AS p FROM hygiene)""")(lambda s: runs.metadata_access(s.hygiene.select(F.col("has_license").alias("failed"), F.col("branch_protection_enabled").alias("protection"))))  # fmt: skip
q("i28_missing_notes", "SELECT repo_id, CASE WHEN has_readme AND has_license THEN '' ELSE 'Missing: ' || concat_ws(', ', CASE WHEN NOT has_readme THEN 'README' END, CASE WHEN NOT has_license THEN 'LICENSE' END) END AS notes FROM hygiene")(
    lambda s: s.hygiene.select("repo_id", texts.missing_notes({"README": F.col("has_readme"), "LICENSE": F.col("has_license")}).alias("notes"))
)
q("j8_a47_file_presence", doubles=("size",), sql=f"""SELECT repo_id, e.path AS path, t.path IS NOT NULL AS exists, t.type AS type, t.size AS size FROM (SELECT repo_id, unnest([{", ".join(f"'{p}'" for p in TREE_PATHS[:4])}]) AS path FROM repos) e
    LEFT JOIN tree t USING (repo_id, path)""")(lambda s: joins.file_presence(s.repos, list(TREE_PATHS[:4]), s.tree))  # fmt: skip
q("a47_files_checked", "SELECT repo_id, count(*) AS files_checked FROM tree GROUP BY ROLLUP (repo_id)")(lambda s: runs.files_checked(s.tree))
q("j9_workflow_files", "SELECT repo_id, prefix, path, size FROM tree JOIN (VALUES ('.github/'), ('.github/workflows/')) p(prefix) ON starts_with(path, prefix) WHERE type = 'blob'")(lambda s: joins.workflow_files(s.tree, [".github/", ".github/workflows/"]))
_RISKS = "SELECT '{}' AS rule, '{}' AS severity, '{}' AS title, repo_id FROM {} WHERE {}"
_RISK_SQL = " UNION ALL ".join(
    _RISKS.format(*r, t, c)
    for r, (t, c) in zip(
        hygiene.RISKS,
        [
            ("scored", "NOT has_security_md"), ("scored", "NOT has_ci_workflows"), ("scored", "score < 60"), ("scored", "NOT has_codeowners"),
            ("hx", "median_time_to_first_review > 48"), ("hx", "review_coverage < 50"), ("hx", "coalesce(stale, 0) > 5"), ("hx", "coalesce(a, 0) < 2"),
            ("scored", "NOT coalesce(dependabot_enabled, false) OR NOT coalesce(secret_scanning_enabled, false)"), ("scored", "NOT coalesce(branch_protection_enabled, false)"),
        ],
        strict=True,
    )
).replace("FROM hx", """FROM (SELECT * FROM health LEFT JOIN (SELECT repo_id, count(*) FILTER (state = 'open' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY) AS stale FROM prs GROUP BY 1) USING (repo_id)
    LEFT JOIN (SELECT repo_id, count(DISTINCT login) AS a FROM events_long WHERE ts < TIMESTAMP '1998-01-01' AND ts >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY GROUP BY 1) USING (repo_id))""")  # fmt: skip


def risk_health(s: Star) -> DataFrame:
    """Health with stale pull requests and recently active people."""
    return metrics.repo_health(s.facts(*metrics.SERIES, before=end()), s.prs, s.reviews, s.repos, end())


q("i21_risk_rows", _RISK_SQL)(lambda s: hygiene.risk_rows(scored(s), risk_health(s)))
q("i21_risks", f"SELECT rule, severity, title, count(*) AS repo_count, string_agg(repo_id, ',' ORDER BY repo_id) AS repos FROM ({_RISK_SQL}) GROUP BY ALL")(lambda s: hygiene.risks(scored(s), risk_health(s)))
q("w8_first_items", """SELECT rule, string_agg(repo_id, ', ' ORDER BY repo_id) FILTER (r <= 3) AS shown, greatest(count(*) - 3, 0) AS more FROM (SELECT rule, repo_id, row_number() OVER (PARTITION BY rule ORDER BY repo_id) AS r FROM (
    SELECT 'R1' AS rule, repo_id FROM scored WHERE NOT has_security_md UNION ALL SELECT 'R2', repo_id FROM scored WHERE NOT has_ci_workflows)) GROUP BY rule""")(
    lambda s: ranking.first_items(hygiene.risk_rows(scored(s), s.repos.select("repo_id", F.lit(0.0).alias("median_time_to_first_review"), F.lit(60.0).alias("review_coverage"), F.lit(0).alias("stale_pr_count"), F.lit(9).alias("active_contributors_90d"))).where("rule IN ('R1', 'R2')"), "rule", "repo_id", 3)
)
AWARDS = [
    ranking.Award("merge_machine", "Merge Machine", "prs_merged", tie_breaker="prs_opened", humans_only=True),
    ranking.Award("bug_janitor", "Bug Janitor", "issues_closed", tie_breaker="issues_opened", humans_only=True),
    ranking.Award("selective", "Most Selective", "approvals", direction="asc", humans_only=True, min_prs=5),
]
q("d6_declarative_awards", """(SELECT 'merge_machine' AS award_key, 'Merge Machine' AS title, login AS winner, CAST(prs_merged AS DOUBLE) AS value FROM merged ORDER BY prs_merged DESC, prs_opened DESC, login LIMIT 1)
    UNION ALL (SELECT 'bug_janitor', 'Bug Janitor', login, CAST(issues_closed AS DOUBLE) FROM merged ORDER BY issues_closed DESC, issues_opened DESC, login LIMIT 1)
    UNION ALL (SELECT 'selective', 'Most Selective', login, CAST(approvals AS DOUBLE) FROM merged WHERE prs_opened >= 5 ORDER BY approvals, login LIMIT 1)""")(
    lambda s: ranking.give_awards(contributors.merge_metrics(counts(s)).withColumn("is_bot", F.lit(False)), AWARDS)
)
q("d7_risk_signals", "SELECT 'no_ci' AS signal, repo_id AS repo FROM scored WHERE NOT has_ci_workflows UNION ALL SELECT 'low_score', repo_id FROM scored WHERE score < 30")(
    lambda s: ranking.risk_signals(scored(s), [("no_ci", ~F.col("has_ci_workflows")), ("low_score", F.col("score") < 30)])
)
q("k10_i29_sample_by_metric", "SELECT repo_id, stars FROM repos ORDER BY stars DESC, repo_id LIMIT 50")(lambda s: ranking.sample_by_metric(s.repos, F.col("stars"), "sample", 50).select("repo_id", "stars"))
q("w7_capped_rows", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3")(lambda s: ranking.capped_rows(s.source("orders"), "o_custkey", "o_orderkey", 3).select("o_custkey", "o_orderkey"))

# --- runs, texts, other shapes ------------------------------------------------------------------------------------

q("a48_outcomes", "SELECT event_type AS outcome, count(*) AS repos, sum(value) AS value FROM events GROUP BY 1")(lambda s: runs.outcomes(s.source("events").withColumnRenamed("event_type", "outcome"), "value"))
q("a49_endpoint_totals", "SELECT coalesce(event_type, 'all') AS endpoint, CAST(sum(user_id) AS BIGINT) AS records, count(*) AS requests, count(*) FILTER (event_id % 5 = 0) AS failures, CAST(sum(event_id % 3) AS BIGINT) AS retries FROM events GROUP BY ROLLUP (event_type)")(
    lambda s: runs.endpoint_totals(s.source("events").select(F.col("event_type").alias("endpoint"), F.col("user_id").alias("records"), (F.col("event_id") % 5 == 0).alias("failed"), (F.col("event_id") % 3).alias("retries")))
)
q("i24_redact", """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'Bearer\\s+[a-zA-Z0-9_\\-\\.]+', 'Bearer [REDACTED]', 'g'), '(Authorization:\\s*)[^\\s,\\]]+', '\\1[REDACTED]', 'gi'),
    '(token[=:]\\s*)[^\\s,\\]]+', '\\1[REDACTED]', 'gi'), '(api[_-]?key[=:]\\s*)[^\\s,\\]]+', '\\1[REDACTED]', 'gi') AS text FROM documents""")(lambda s: s.source("documents").select("doc_id", texts.redact(F.col("text")).alias("text")))  # fmt: skip
q("i25_stats_map", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")(lambda s: s.source("events").select("event_id", F.element_at(texts.stats_map(F.col("props")), "k").alias("k")))
q("i7_inclusive_end", dates=("last_day",), sql="SELECT o_orderkey, CAST(o_orderdate - INTERVAL 1 DAY AS DATE) AS last_day FROM orders")(lambda s: s.source("orders").select("o_orderkey", times.inclusive_end(F.to_date("o_orderdate")).alias("last_day")))
q("i12_i11_short_name", "SELECT repo_id, split_part(repo_id, '/', 2) AS short FROM repos")(lambda s: s.repos.select("repo_id", texts.short_name(F.col("repo_id")).alias("short")))
q("i13_half_even", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM orders")(lambda s: s.source("orders").select("o_orderkey", numbers.half_even(F.col("o_totalprice"), 2).alias("price")))
q("i20_trend", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'up' WHEN c_acctbal < 5000 THEN 'down' ELSE 'neutral' END AS trend FROM customer")(lambda s: s.source("customer").select("c_custkey", numbers.trend(F.col("c_acctbal") - 5000).alias("trend")))
q("i26_count_label", "SELECT repo_id, CAST(stars AS VARCHAR) || ' reviews' AS label, CAST(stars % 100 AS VARCHAR) || '% coverage' AS coverage FROM repos")(
    lambda s: s.repos.select("repo_id", texts.count_label(F.col("stars"), "reviews").alias("label"), texts.percent_label(F.col("stars") % 100, "coverage").alias("coverage"))
)
q("d1_fact_pull_request", "SELECT repo_id, number, login, created_at, merged_at, CASE WHEN merged_at IS NOT NULL THEN 'merged' ELSE state END AS state, length(title) AS title_length, additions, deletions FROM prs")(
    lambda s: normalize.fact_pull_request(s.prs.withColumn("body", F.lit(None).cast("string")).withColumn("labels", F.lit(None).cast("array<struct<name: string>>"))).drop("labels", "body_length")
)


def commits(s: Star) -> DataFrame:
    kinds = ["docs/a.md", "infra/main.tf", "tests/test_a.py", "src/a.py"]
    path = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    files = F.array(F.struct(path.alias("path"), F.col("l_quantity").cast("long").alias("lines")))
    return s.source("lineitem").select(
        F.concat(F.lit("org/repo"), F.col("l_orderkey") % 2100).alias("repo_id"), F.col("l_orderkey").cast("string").alias("sha"), F.concat(F.lit("user"), F.col("l_suppkey")).alias("login"),
        F.timestamp_add("HOUR", (F.col("l_orderkey") % 24).cast("int"), "l_shipdate").alias("committed_at"), files.alias("files"),
    )


_COMMIT_FILES = """SELECT concat('org/repo', CAST(l_orderkey % 2100 AS VARCHAR)) AS repo_id, CAST(l_orderkey AS VARCHAR) AS sha, 'user' || l_suppkey AS login, l_shipdate + to_hours(l_orderkey % 24) AS committed_at,
    CASE l_linenumber % 4 WHEN 0 THEN 'docs/a.md' WHEN 1 THEN 'infra/main.tf' WHEN 2 THEN 'tests/test_a.py' ELSE 'src/a.py' END AS path, CAST(trunc(l_quantity) AS BIGINT) AS lines,
    CASE l_linenumber % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'tf' ELSE 'py' END AS file_ext, l_linenumber % 4 = 0 AS is_docs, l_linenumber % 4 = 1 AS is_iac, l_linenumber % 4 = 2 AS is_test, false AS is_ci FROM lineitem"""
q("d2_fact_commit_files", _COMMIT_FILES)(lambda s: normalize.fact_commit_files(commits(s)))
q("d8_user_extras", f"SELECT login, count(*) AS commits, count(*) FILTER (h < 8 OR h >= 18) AS off_hours_commits, count(*) FILTER (d) AS docs_commits, CAST(sum(n) AS BIGINT) AS docs_lines_changed FROM (SELECT login, sha, hour(min(committed_at)) AS h, bool_or(is_docs) AS d, coalesce(sum(lines) FILTER (is_docs), 0) AS n FROM ({_COMMIT_FILES}) GROUP BY 1, 2) GROUP BY login")(
    lambda s: metrics.user_extras(normalize.fact_commit_files(commits(s)))
)
q("d3_dim_time", dates=("date",), sql="""SELECT CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS year, strftime(d, '%Y-%m') AS month, strftime(d, '%G-W%V') AS week, CAST(isodow(d) AS INTEGER) AS weekday
    FROM (SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS d)""")(
    lambda s: normalize.dim_time(s.source("orders"), "o_orderdate")
)
q("p14_flatten_protection", doubles=("required_review_count",), sql="""SELECT repo_id AS repo, CASE WHEN k % 4 = 0 THEN true WHEN k % 4 = 1 THEN false END AS protection_enabled, CASE WHEN k % 4 = 2 THEN '403: permission denied' WHEN k % 4 = 3 THEN '500: error' END AS error,
    CASE WHEN k % 4 = 0 THEN k % 3 = 0 END AS enforce_admins, CASE WHEN k % 4 = 0 THEN CAST(k % 5 AS INTEGER) END AS required_review_count FROM (SELECT repo_id, id AS k FROM repos)""")(
    lambda s: normalize.flatten_protection(_responses(s)).select("repo", "protection_enabled", "error", "enforce_admins", "required_review_count")
)


def _responses(s: Star) -> DataFrame:
    body = F.from_json(F.format_string('{"enforce_admins": {"enabled": %s}, "required_reviews": {"count": %d}}', (F.col("id") % 3 == 0).cast("string"), F.col("id") % 5), normalize.PROTECTION_BODY)
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 403, 500)]), (F.col("id") % 4 + 1).cast("int"))
    return s.repos.select(F.col("repo_id").alias("repo"), F.lit("main").alias("branch"), status.alias("status"), body.alias("body"))


q("p15_flatten_security", """SELECT repo_id AS repo, CASE WHEN k % 3 <> 0 THEN k % 2 = 0 END AS dependabot_alerts, CASE WHEN k % 3 = 0 THEN 'no access to security features' END AS error FROM (SELECT repo_id, id AS k FROM repos)""")(
    lambda s: normalize.flatten_security(
        s.repos.select(
            F.col("repo_id").alias("repo"),
            F.struct(*[F.struct(F.when((F.col("id") % 3 != 0), F.when(F.col("id") % 2 == 0, "enabled").otherwise("disabled")).alias("status")).alias(f) for f in normalize.SECURITY_FEATURES]).alias("features"),
        )
    ).select("repo", "dependabot_alerts", "error")
)
_HEALTH = ("o_orderkey", "o_orderkey", "o_custkey", "_coverage")
q("p11_p13_health_shapes", """SELECT concat('r', CAST(o_orderkey AS VARCHAR)) AS repo_id, concat('n', CAST(o_orderkey AS VARCHAR)) AS repo_full_name, o_custkey AS prs_merged,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 400 / 4.0 END AS review_coverage FROM orders""")(
    lambda s: normalize.health_from_shapes(
        s.source("orders").withColumn("_coverage", F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 400 / 4).cast("string")).otherwise("null")).select(
            F.when(F.col("o_orderkey") % 4 == 0, F.format_string('{"r%d": {"repo_full_name": "n%d", "prs_merged": %d, "review_coverage": %s}}', *_HEALTH))
            .when(F.col("o_orderkey") % 4 == 1, F.format_string('[{"repo_id": "r%d", "repo": "n%d", "prs_merged": %d, "review_coverage": %s}]', *_HEALTH))
            .when(F.col("o_orderkey") % 4 == 2, F.format_string('{"repositories": [{"repo_id": "r%d", "repo_full_name": "n%d", "prs_merged": %d, "review_coverage": %s}]}', *_HEALTH))
            .otherwise(F.format_string('{"repositories": {"r%d": {"repo_full_name": "n%d", "prs_merged": %d, "review_coverage": %s}}}', *_HEALTH))
            .alias("health")
        )
    )
)
q("p12_hygiene_shapes", "SELECT concat('r', CAST(o_orderkey AS VARCHAR)) AS repo_id, CAST(o_custkey AS INTEGER) AS score FROM orders")(
    lambda s: normalize.hygiene_from_shapes(
        s.source("orders").select(
            F.when(F.col("o_orderkey") % 4 == 0, F.format_string('{"r%d": {"score": %d}}', "o_orderkey", "o_custkey"))
            .when(F.col("o_orderkey") % 4 == 1, F.format_string('[{"repo": "r%d", "score": %d}]', "o_orderkey", "o_custkey"))
            .when(F.col("o_orderkey") % 4 == 2, F.format_string('{"repositories": [{"repo_id": "r%d", "score": %d}]}', "o_orderkey", "o_custkey"))
            .otherwise(F.format_string('{"repositories": {"r%d": {"score": %d}}}', "o_orderkey", "o_custkey"))
            .alias("hygiene")
        )
    )
)
q("j13_first_rule", "SELECT repo_id, topics[1] AS first FROM repos")(lambda s: s.repos.select("repo_id", joins.first_rule("topics").alias("first")))


# --- identity rules, prefixes and searches that come as tables ---------------------------------------------------------

_RULES = """SELECT c_custkey AS rule_id, 'human' AS kind, concat('user', CAST(c_custkey AS STRING)) AS value, 0 AS rank FROM customer WHERE c_custkey % 40 = 1
    UNION ALL SELECT c_custkey, 'bot', concat('user', CAST(c_custkey AS STRING)), 1 FROM customer WHERE c_custkey % 30 = 1
    UNION ALL SELECT 1000000 + r_regionkey, 'type', CASE r_regionkey WHEN 0 THEN 'Bot' ELSE concat('Kind', CAST(r_regionkey AS STRING)) END, 2 FROM region
    UNION ALL SELECT 2000000 + n_nationkey, 'pattern', CASE n_nationkey WHEN 0 THEN 'renovate-.*' ELSE concat('user', CAST(n_nationkey AS STRING), '[05]$') END, 3 FROM nation"""


def rules(s: Star) -> DataFrame:
    parts = {t: s.source(t) for t in ("customer", "region", "nation")}
    sql = _RULES
    for t in parts:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return s.spark.sql(sql, **parts)


q("f18_d3_rules_of_a_table", f"""SELECT * FROM (WITH ru AS ({_RULES.replace("STRING", "VARCHAR")}),
    hit AS (SELECT number, min(struct_pack(rank, rule_id, kind, value)) AS r FROM prs JOIN ru ON (kind IN ('human', 'bot') AND value = login) OR (kind = 'type' AND value = user_type)
        OR (kind = 'pattern' AND regexp_matches(login, '^(?:' || value || ')')) GROUP BY number)
    SELECT number, login, CAST(r.rule_id AS BIGINT) AS rule_id, CASE WHEN r IS NULL THEN 'human' WHEN r.kind = 'type' THEN 'type' WHEN r.kind = 'pattern' THEN 'pattern: ' || r.value ELSE 'override: ' || r.kind END AS reason,
        coalesce(r.kind <> 'human', false) AS is_bot FROM prs LEFT JOIN hit USING (number))""")(
    lambda s: identity.classify(s.prs.select("number", "login", "user_type"), rules(s)).drop("user_type")
)
_PREFIXES = "SELECT DISTINCT regexp_replace(path, '[^/]*$', '') AS prefix FROM tree UNION SELECT DISTINCT substring(path, 1, 4) FROM tree UNION SELECT DISTINCT path FROM tree"
q("j9_prefix_table", f"SELECT repo_id, path, size, prefix FROM tree JOIN ({_PREFIXES}) p ON starts_with(path, prefix) WHERE type = 'blob'")(
    lambda s: joins.under_prefixes(s.tree.where("type = 'blob'").select("repo_id", "path", "size"), s.spark.sql(_PREFIXES.replace("FROM tree", "FROM {tree}"), tree=s.tree))
)
q("f23_f24_s14_postings", """SELECT * FROM (WITH ix AS (SELECT 'contributor' AS kind, login AS name, value AS weight FROM counts WHERE metric_key = 'prs_opened'
    UNION ALL SELECT 'repository', repo_id, count(*) FROM events_long WHERE metric_key = 'prs_merged' GROUP BY repo_id),
    te AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'ER' || s_suppkey WHEN 1 THEN 'repo' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS term FROM supplier)
    SELECT term, kind, name, weight, CAST(row_number() OVER (PARTITION BY term ORDER BY kind, weight DESC, name) AS INTEGER) AS place FROM te JOIN ix ON contains(lower(name), lower(term)) WHERE length(term) >= 2
    QUALIFY row_number() OVER (PARTITION BY term ORDER BY kind, weight DESC, name) <= 5)""")(lambda s: _postings(s))  # fmt: skip


def _postings(s: Star) -> DataFrame:
    key = F.col("s_suppkey")
    terms = s.source("supplier").select(F.when(key % 3 == 0, F.concat(F.lit("ER"), key)).when(key % 3 == 1, F.concat(F.lit("repo"), key)).otherwise(key.cast("string")).alias("term"))
    index = search.NameIndex(s.spark, scratch.new_folder(s.spark, "names"))
    index.build(_index(s))
    return index.first_hits(terms)


# --- parts of the survey's lines that the given tables do not show by themselves ------------------------------------

_TOKEN = "CASE WHEN o_orderkey % 3 = 0 THEN substr(md5(CAST(o_orderkey AS {string})), 1, 12) ELSE md5(CAST(o_orderkey AS {string})) END"
_NOTE = "concat('a ghp_', {t}, ' b gho_', {t}, ' c ghu_', {t}, ' d ghs_', {t}, ' e github_pat_', {t}, ' f Bearer ', {t}, ' g AUTHORIZATION: ', {t}, ' h Token=', {t}, ' i api-key: ', {t}, ' end')"


def _note(string: str) -> str:
    return _NOTE.format(t=_TOKEN.format(string=string))


q("i24_redact_every_pattern", f"""SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'gh[pous]_[a-zA-Z0-9]{{20,}}', '[REDACTED_GH_TOKEN]', 'g'),
    'github_pat_[a-zA-Z0-9_]+', '[REDACTED_GH_PAT]', 'g'), 'Bearer\\s+[a-zA-Z0-9_\\-\\.]+', 'Bearer [REDACTED]', 'g'), '(Authorization:\\s*)[^\\s,\\]]+', '\\1[REDACTED]', 'gi'),
    '(token[=:]\\s*)[^\\s,\\]]+', '\\1[REDACTED]', 'gi'), '(api[_-]?key[=:]\\s*)[^\\s,\\]]+', '\\1[REDACTED]', 'gi') AS text FROM (SELECT o_orderkey, {_note("VARCHAR")} AS t FROM orders)""")(
    lambda s: s.source("orders").select("o_orderkey", texts.redact(F.expr(_note("STRING"))).alias("text"))
)
q("i13_half_even_on_halves", "SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_orderkey % 40 AS DECIMAL(9, 1)) + 0.5, 0) AS DOUBLE) AS whole, round_even(CAST(l_orderkey % 1000 AS DECIMAL(9, 3)) / 1000 * 125, 2)::DOUBLE AS cents FROM lineitem")(
    lambda s: s.source("lineitem").select(
        "l_orderkey", "l_linenumber", numbers.half_even((F.col("l_orderkey") % 40).cast("decimal(9,1)") + F.lit("0.5").cast("decimal(2,1)"), 0).cast("double").alias("whole"),
        numbers.half_even(((F.col("l_orderkey") % 1000) * 125).cast("decimal(12,0)") / F.lit("1000").cast("decimal(4,0)"), 2).cast("double").alias("cents"),
    )
)
q("i11_case_and_parts", "SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, contains(lower(c_name), '#00') AS has, starts_with(c_mktsegment, 'A') AS first FROM customer")(
    lambda s: s.source("customer").select(
        "c_custkey", F.lower("c_name").alias("low"), F.upper("c_mktsegment").alias("up"), F.lower("c_name").contains("#00").alias("has"), F.col("c_mktsegment").startswith("A").alias("first")
    )
)
q("i29_nested_metric", "SELECT repo_id, CASE WHEN size_kb % 400 = 0 THEN 0 ELSE stars END AS merged, 0::BIGINT AS missing, 0::BIGINT AS text FROM repos ORDER BY merged DESC, repo_id LIMIT 50")(
    lambda s: (lambda r: ranking.sample_by_metric(r, ranking.nested_number(r, "mergedPullRequests.totalCount"), "sample", 50).select(
        "repo_id", ranking.nested_number(r, "mergedPullRequests.totalCount").alias("merged"), ranking.nested_number(r, "watchers.totalCount").alias("missing"), ranking.nested_number(r, "name").alias("text")
    ))(s.repos.withColumn("mergedPullRequests", F.when(F.col("size_kb") % 400 != 0, F.struct(F.col("stars").alias("totalCount")))))
)
q("d1_fact_pull_request_texts", """SELECT repo_id, number, CASE WHEN number % 5 = 0 THEN 0 ELSE length(title) * 2 END AS body_length, CASE WHEN number % 3 = 0 THEN '' WHEN number % 3 = 1 THEN 'bug' ELSE 'bug,' || state END AS labels FROM prs""")(
    lambda s: normalize.fact_pull_request(_labelled(s.prs)).select("repo_id", "number", "body_length", F.array_join("labels", ",").alias("labels"))
)
q("d1_fact_issue", """SELECT repo_id, number, login, created_at, closed_at, state, length(state) AS title_length, CASE WHEN number % 5 = 0 THEN 0 ELSE length(state) * 2 END AS body_length,
    CASE WHEN number % 3 = 0 THEN '' WHEN number % 3 = 1 THEN 'bug' ELSE 'bug,' || state END AS labels FROM issues WHERE NOT is_pull_request""")(
    lambda s: normalize.fact_issue(_labelled(s.issues.withColumn("title", F.col("state")))).withColumn("labels", F.array_join("labels", ","))
)
q("d1_fact_review", "SELECT repo_id, number, login, upper(state) AS state, submitted_at FROM reviews")(lambda s: normalize.fact_review(s.reviews))
for _name, _kinds in (("issue", ("issue", "pr")), ("review", ("review",))):
    q(f"d1_fact_{_name}_comment", f"SELECT repo_id, number, login, created_at, coalesce(length(login), 0) AS body_length FROM comments WHERE comment_type IN ({', '.join(repr(k) for k in _kinds)})")(
        lambda s, kinds=_kinds: normalize.fact_comment(s.comments.withColumn("body", F.col("login")), *kinds)
    )


def _labelled(df: DataFrame) -> DataFrame:
    """Bodies (some missing) and labels (some missing) for tables that have none."""
    one, two = F.struct(F.lit("bug").alias("name")), F.struct(F.col("state").alias("name"))
    labels = F.when(F.col("number") % 3 == 1, F.array(one)).when(F.col("number") % 3 == 2, F.array(one, two))
    return df.withColumns({"body": F.when(F.col("number") % 5 != 0, F.concat("title", "title")), "labels": labels})


q("d5_stale_issues", "SELECT repo_id, count(*) FILTER (state = 'open' AND created_at < TIMESTAMP '2024-12-31' - INTERVAL 30 DAY) AS stale FROM issues WHERE NOT is_pull_request GROUP BY repo_id")(
    lambda s: metrics.stale_counts(s.issues.where(~F.col("is_pull_request")), as_of())
)
q("d8_first_review_of_people", f"""SELECT login, avg((epoch_us(seen) - epoch_us(created_at)) / 3.6e9) AS avg_time_to_first_review FROM (SELECT repo_id, number, login, min(submitted_at) AS seen FROM reviews WHERE {PEOPLE} GROUP BY ALL) v
    JOIN (SELECT repo_id, number, created_at FROM prs WHERE {PEOPLE}) p USING (repo_id, number) GROUP BY login""")(lambda s: metrics.first_review_of_people(s.reviews, s.prs))
q("d9_activity_score", "SELECT repo_id, pr_count + issue_count + review_count + comment_count AS total_activity_score FROM health")(
    lambda s: metrics.activity_score(metrics.repo_counters(s.facts(*metrics.COUNTED), s.repos))
)
q("d10_repo_series", """SELECT metric_key, strftime(ts, '%G-W%V') AS period, repo_id, login, count(*) AS count FROM events_long
    WHERE year(ts) = 1997 AND metric_key IN ('prs_opened','prs_merged','issues_opened','issues_closed','reviews_submitted','comments_total') GROUP BY ALL""")(
    lambda s: metrics.time_series(s.facts(*metrics.SERIES, timed=True), YEAR, "week", "repo_id")
)
SMALL_AWARDS = [
    ranking.Award("review_desert", "Review Desert", "review_coverage", direction="asc", min_prs=5),
    ranking.Award("merge_velocity_champion", "Merge Velocity Champion", "median_time_to_merge", direction="asc", min_prs=5),
    ranking.Award("most_active", "Most Active Repository", "total_activity_score"),
    ranking.Award("stale_queue_dragon", "Stale Queue Dragon", "stale_pr_count"),
]
q("d6_repo_awards", """SELECT * FROM (WITH h AS (SELECT *, pr_count + issue_count + review_count + comment_count AS total_activity_score FROM health LEFT JOIN
    (SELECT repo_id, count(*) FILTER (state = 'open' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY) AS stale_pr_count FROM prs GROUP BY 1) USING (repo_id))
    (SELECT 'review_desert' AS award_key, 'Review Desert' AS title, repo_id AS winner, review_coverage AS value FROM h WHERE pr_count >= 5 ORDER BY review_coverage, repo_id LIMIT 1)
    UNION ALL (SELECT 'merge_velocity_champion', 'Merge Velocity Champion', repo_id, median_time_to_merge FROM h WHERE pr_count >= 5 AND median_time_to_merge IS NOT NULL ORDER BY median_time_to_merge, repo_id LIMIT 1)
    UNION ALL (SELECT 'most_active', 'Most Active Repository', repo_id, total_activity_score::DOUBLE FROM h ORDER BY total_activity_score DESC, repo_id LIMIT 1)
    UNION ALL (SELECT 'stale_queue_dragon', 'Stale Queue Dragon', repo_id, stale_pr_count::DOUBLE FROM h WHERE stale_pr_count IS NOT NULL ORDER BY stale_pr_count DESC, repo_id LIMIT 1))""")(
    lambda s: ranking.give_awards(
        risk_health(s).withColumns({"prs_opened": F.col("pr_count"), "total_activity_score": metrics.activity_of()}), SMALL_AWARDS, "repo_id",
    )
)


def _award_sql(awards: list[ranking.Award], table: str, key: str) -> str:
    """The winner of each award as a query of its own."""
    each = []
    for a in awards:
        tie = f"coalesce({a.tie_breaker}, 0) DESC, " if a.tie_breaker else ""
        where = f"{a.metric} IS NOT NULL" + (f" AND prs_opened >= {a.min_prs}" if a.min_prs else "")
        each.append(f"(SELECT '{a.key}' AS award_key, '{a.title}' AS title, {key} AS winner, CAST({a.metric} AS DOUBLE) AS value FROM {table} WHERE {where} ORDER BY {a.metric} {a.direction.upper()}, {tie}{key} LIMIT 1)")
    return " UNION ALL ".join(each)


_EXTRAS = f"""SELECT login, count(*) AS commits, count(*) FILTER (h < 8 OR h >= 18) AS off_hours_commits, count(*) FILTER (d) AS docs_commits, CAST(sum(n) AS BIGINT) AS docs_lines_changed
    FROM (SELECT login, sha, hour(min(committed_at)) AS h, bool_or(is_docs) AS d, coalesce(sum(lines) FILTER (is_docs), 0) AS n FROM ({_COMMIT_FILES}) GROUP BY 1, 2) GROUP BY login"""
_FIRST = f"""SELECT login, avg((epoch_us(seen) - epoch_us(created_at)) / 3.6e9) AS avg_time_to_first_review FROM (SELECT repo_id, number, login, min(submitted_at) AS seen FROM reviews WHERE {PEOPLE} GROUP BY ALL) v
    JOIN (SELECT repo_id, number, created_at FROM prs WHERE {PEOPLE}) p USING (repo_id, number) GROUP BY login"""
q("d6_all_user_awards", f"""SELECT * FROM (WITH us AS (SELECT * FROM merged FULL JOIN ({_EXTRAS}) x USING (login) FULL JOIN ({_FIRST}) y USING (login)
    FULL JOIN (SELECT login, count(DISTINCT period) AS active_weeks FROM weekly GROUP BY login) z USING (login)) {_award_sql(ranking.USER_AWARDS, "us", "login")})""")(
    lambda s: ranking.give_awards(
        contributors.merge_metrics(counts(s)).join(metrics.user_extras(normalize.fact_commit_files(commits(s))), "login", "full").join(metrics.first_review_of_people(s.reviews, s.prs), "login", "full")
        .join(metrics.active_weeks(s.facts(*metrics.SERIES, timed=True), YEAR), "login", "full").withColumn("is_bot", F.lit(False)), ranking.USER_AWARDS,
    )
)
q("d6_all_repo_awards", f"""SELECT * FROM (WITH rs AS (SELECT *, pr_count AS prs_opened, pr_count + issue_count + review_count + comment_count AS total_activity_score, score AS hygiene_score,
    (pr_count + issue_count + review_count + comment_count) / bus_factor AS bus_factor_risk_score FROM health LEFT JOIN (SELECT repo_id, score FROM scored) USING (repo_id)
    LEFT JOIN (SELECT repo_id, count(*) FILTER (state = 'open' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY) AS stale_pr_count FROM prs GROUP BY 1) USING (repo_id)
    LEFT JOIN (SELECT repo_id, count(*) FILTER (b < 0.5 * t) AS bus_factor FROM (SELECT repo_id, coalesce(sum(v) OVER (PARTITION BY repo_id ORDER BY v DESC, login ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
        sum(v) OVER (PARTITION BY repo_id) AS t FROM (SELECT repo_id, login, count(*) AS v FROM events_long WHERE metric_key = 'prs_merged' GROUP BY ALL)) GROUP BY repo_id) USING (repo_id))
    {_award_sql(ranking.REPO_AWARDS, "rs", "repo_id")})""")(
    lambda s: ranking.give_awards(metrics.repo_standing(risk_health(s), scored(s), metrics.leaderboard_counts(s.facts("prs_merged"), "repo_id").drop("metric_key")), ranking.REPO_AWARDS, "repo_id")
)
