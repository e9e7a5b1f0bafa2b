import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import charts, contributors, filters, hygiene, insights, joins, metrics, normalize, ranking, search


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def star(spark):
    prs = spark.createDataFrame(
        [
            ("o/a", 1, "ann", "User", "2024-01-01 00:00:00", "2024-01-01 01:00:00", 10, 5),
            ("o/a", 2, "bob", "User", "2024-01-02 00:00:00", "2024-01-02 02:00:00", None, 3),
            ("o/a", 3, "x[bot]", "Bot", "2024-01-03 00:00:00", None, 1, 1),
            ("o/b", 1, "ann", "User", "2024-12-30 00:00:00", None, 1, 1),
            ("o/zz", 9, "cy", "User", "2023-12-31 00:00:00", None, 1, 1),
        ],
        "repo_id string, number long, login string, user_type string, created_at string, merged_at string, additions long, deletions long",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "merged_at")}).withColumn("title", F.lit("t"))
    issues = spark.createDataFrame(
        [("o/a", 4, "ann", "User", "closed", "2024-02-01", "2024-02-03", False), ("o/a", 5, "ann", "User", "open", "2024-02-01", None, True), ("o/a", 6, "bob", "User", "open", "2024-02-01", None, None)],
        "repo_id string, number long, login string, user_type string, state string, created_at string, closed_at string, is_pull_request boolean",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "closed_at")})
    reviews = spark.createDataFrame(
        [("o/a", 1, "bob", "User", "approved", "2024-01-01 00:30:00"), ("o/a", 1, "ann", "User", "CHANGES_REQUESTED", "2024-01-01 00:10:00"), ("o/a", 3, "bob", "User", "COMMENTED", "2024-01-04 00:00:00"), ("o/a", 77, None, None, "APPROVED", "2024-01-04 00:00:00")],
        "repo_id string, number long, login string, user_type string, state string, submitted_at string",
    ).withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    comments = spark.createDataFrame(
        [("o/a", 1, "dee", "User", "issue", "2024-01-05"), ("o/a", 2, "dee", "User", "review", "2024-01-05")], "repo_id string, number long, login string, user_type string, comment_type string, created_at string"
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    repos = spark.createDataFrame([("o/a",), ("o/b",), ("o/c",)], "repo_id string")
    return prs, issues, reviews, comments, repos, metrics.events_long(prs, issues, reviews, comments)


def test_leaderboards_keep_all_years_and_drop_bots(star):
    got = {(r["metric_key"], r["login"]): r["value"] for r in metrics.leaderboard_counts(star[5]).collect()}
    assert got["prs_opened", "ann"] == 2 and got["prs_opened", "cy"] == 1 and ("prs_opened", "x[bot]") not in got
    assert got["issues_opened", "ann"] == 1 and got["issues_closed", "ann"] == 1 and got["issues_opened", "bob"] == 1
    assert got["reviews_submitted", "bob"] == 2 and got["approvals", "bob"] == 1 and got["changes_requested", "ann"] == 1
    assert got["comments_total", "dee"] == 2 and got["review_comments_total", "dee"] == 1


def test_ranking_ties_by_login(spark):
    counts = spark.createDataFrame([("m", "e", 1), ("m", "b", 5), ("m", "a", 5), ("m", "c", 9), ("m", "d", 2)], "metric_key string, login string, value long")
    assert [r["login"] for r in metrics.ranked(counts).orderBy("rank").collect()] == ["c", "a", "b", "d", "e"]
    assert rows(ranking.winners(counts)) == [("m", "c", 9)]


def test_series_uses_calendar_gate_and_iso_weeks(star):
    weeks = {r["period"] for r in metrics.time_series(star[5], 2024).where("metric_key = 'prs_opened'").collect()}
    assert weeks == {"2024-W01", "2025-W01"}


def test_health(star):
    prs, issues, reviews, comments, repos, events = star
    got = {r["repo_id"]: r.asDict() for r in metrics.repo_health(events, prs, reviews, repos).collect()}
    assert set(got) == {"o/a", "o/b", "o/c"}
    a = got["o/a"]
    assert (a["pr_count"], a["issue_count"], a["review_count"], a["comment_count"], a["contributor_count"]) == (2, 2, 3, 2, 3)
    assert a["review_coverage"] == 100.0  # numbers 1 and 3 reviewed, two pull requests of people
    assert a["median_time_to_merge"] == 1.5 and a["median_time_to_first_review"] == pytest.approx(1 / 6)
    assert got["o/c"]["pr_count"] == 0 and got["o/c"]["review_coverage"] == 0.0 and got["o/c"]["median_time_to_merge"] is None


def test_summary_leaves_commenters_out(star):
    s = metrics.summary(star[5], star[4]).first()
    assert s["total_contributors"] == 3 and s["total_prs"] == 4 and s["prs_merged"] == 2 and s["total_repos"] == 3


def test_new_contributors(star):
    assert [r["login"] for r in metrics.new_contributors(star[5], 2024).collect()] == ["ann", "bob", "dee"]


@pytest.mark.parametrize(("values", "factor"), [([60, 20, 20], 1), ([30, 30, 40], 2), ([], 0), ([1, 1, 1, 1], 2)])
def test_bus_factor(spark, values, factor):
    counts = spark.createDataFrame([(f"u{i}", v) for i, v in enumerate(values)], "login string, value long")
    got = metrics.bus_factor(counts).collect()
    assert (got[0][0] if got else 0) == factor


def test_percentile_option_differs_on_even_counts(spark):
    prs = spark.createDataFrame([("r", i, "ann", "User", h) for i, h in enumerate((1, 2, 4, 10))], "repo_id string, number long, login string, user_type string, h int")
    at = F.lit("2024-01-01").cast("timestamp")
    prs = prs.withColumn("created_at", at).withColumn("merged_at", F.timestamp_add("HOUR", "h", "created_at"))
    assert metrics.merge_times(prs).first()[1] == 3.0 and metrics.merge_times(prs, exact=False).first()[1] == 2.0


def test_filter_chain_reports_the_first_failure(spark):
    repos = spark.createDataFrame(
        [
            ("a", True, True, None, False, "2024-06-01T00:00:00Z", 10, "Python", ["x"]),
            ("b", None, None, None, True, "2024-06-01T00:00:00Z", 10, "Python", ["x"]),
            ("c", False, False, "public", False, "never", 10, "Python", ["x"]),
            ("d", False, False, "public", False, "2024-06-01T00:00:00Z", None, None, ["x"]),
            ("e", False, False, "public", False, "2024-06-01T00:00:00Z", 10, "Python", None),
            ("old-f", False, False, "public", False, "2024-06-01T00:00:00Z", 10, "Python", ["x", "y"]),
            ("g", False, False, "public", False, "2024-06-01T00:00:00Z", 10, "Python", ["x", "y"]),
        ],
        "name string, fork boolean, archived boolean, visibility string, private boolean, pushed_at string, size_kb int, language string, topics array<string>",
    )
    chain = filters.RepoFilters(visibility="public", pushed_within_days=365, include_languages=("Python",), require_all_topics=("x",), exclude_names=("^old",))
    done = filters.apply_filter_chain(repos, chain, F.lit("2024-12-31").cast("timestamp"))
    assert rows(done.select("name", "reject_filter"), "name") == [("a", "fork"), ("b", "visibility"), ("c", "activity"), ("d", "language"), ("e", "topics"), ("g", None), ("old-f", "name")]
    assert [r["name"] for r in filters.passed(done).collect()] == ["g"]
    assert {r["filter"]: r["rejected"] for r in filters.rejection_stats(done).collect()} == dict.fromkeys(("fork", "visibility", "activity", "language", "topics", "name"), 1)


def test_page_test_is_true_for_no_readable_time(spark):
    pages = spark.createDataFrame([(1, "bad"), (2, "2024-01-01T00:00:00Z"), (2, "2024-03-01T00:00:00Z")], "page int, t string")
    assert rows(filters.page_all_older(pages, "page", "t", F.lit("2024-02-01").cast("timestamp")), "page") == [(1, True), (2, False)]


def test_first_seen_wins(spark):
    seen = spark.createDataFrame([("ann", "new", "Bot", 2), ("ann", "old", "User", 1), ("", "x", "User", 0)], "login string, avatar_url string, user_type string, seq int")
    assert rows(normalize.user_dimension(seen, ["seq"])) == [("ann", "old", "User", False)]


def test_award_shapes(spark):
    shapes = ['{"top_pr_author": {"user": "a", "count": 1}}', '{"individual": {"top_reviewer": {"user": "b", "count": 2}}}', '{"individual": [{"award_key": "top_issue_opener", "user": "c", "count": 3}]}']
    raw = spark.createDataFrame([(x,) for x in shapes], "awards string")
    assert sorted(rows(normalize.awards_from_shapes(raw))) == [("top_issue_opener", "c", 3), ("top_pr_author", "a", 1), ("top_reviewer", "b", 2)]


def test_repo_names(spark):
    ok, bad = normalize.split_repo_name(spark.createDataFrame([("o/r",), ("o",), ("o/r/x",), (None,), ("/r",)], "full_name string"))
    assert rows(ok.select("owner", "repo")) == [("o", "r")] and bad.count() == 4
    df = spark.createDataFrame([("", "https://api/repos/o/r/issues/1"), ("p/q", None), (None, "x")], "n string, u string")
    assert [r[0] for r in df.select(normalize.repo_of(F.col("n"), F.col("u"))).collect()] == ["o/r", "p/q", None]


def test_status_and_scores(spark):
    flags = "repo_id string, score int, " + ", ".join(f"{f} boolean" for f in ("has_readme", "has_security_md", "has_codeowners", "has_ci_workflows", "has_contributing", "dependabot_enabled", "secret_scanning_enabled", "branch_protection_enabled"))
    hyg = spark.createDataFrame(
        [("a", 60, True, *[None] * 7), ("b", 0, True, False, False, True, False, None, True, True), ("c", 90, *[False] * 8), ("d", 30, *[False] * 3, True, *[False] * 4)], flags
    )
    health = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("c", 5, 0), ("d", 0, 0), ("e", 1, 0), ("f", None, None)], "repo_id string, prs_merged long, active_contributors_365d long")
    got = {r["repo_id"]: (r["hygiene_score"], r["health_status"]) for r in hygiene.with_status(health, hyg).collect()}
    assert got == {"a": (60, "healthy"), "b": (60, "healthy"), "c": (None, "healthy"), "d": (30, "warning"), "e": (None, "warning"), "f": (None, "critical")}


def test_long_review_rule_and_its_switch(spark):
    health = spark.createDataFrame([("r", 100.0, 10.0, 0, 9)], "repo_id string, median_time_to_first_review double, review_coverage double, stale_pr_count long, active_contributors_90d long")
    none = spark.createDataFrame([], "repo_id string, score int, " + ", ".join(f"{f} boolean" for f in ("has_security_md", "has_ci_workflows", "has_codeowners", "dependabot_enabled", "secret_scanning_enabled", "branch_protection_enabled")))
    assert sorted(r["rule"] for r in hygiene.risks(none, health).collect()) == ["R5", "R6"]
    assert [r["rule"] for r in hygiene.risks(none, health, compat=True).collect()] == ["R6"]


@pytest.mark.parametrize("piece", [7, 10_000])
def test_a_rule_names_all_its_repositories(spark, monkeypatch, piece):
    monkeypatch.setattr(hygiene, "NAMES_PER_PIECE", piece)
    names = [f"o/{n}" for n in range(50)]
    hyg = spark.createDataFrame([(n, 90, i % 2 == 0 and i < 50, *[True] * 5) for i, n in enumerate([*names, "o/1", None])], "repo_id string, score int, " + ", ".join(f"{f} boolean" for f in ("has_security_md", "has_ci_workflows", "has_codeowners", "dependabot_enabled", "secret_scanning_enabled", "branch_protection_enabled")))
    health = spark.createDataFrame([(n, 1.0, 10.0, 0, 9) for n in names], "repo_id string, median_time_to_first_review double, review_coverage double, stale_pr_count long, active_contributors_90d long")
    got = sorted(map(tuple, hygiene.risks(hyg, health).collect()))
    title = {r: (s, t) for r, s, t in hygiene.RISKS}
    assert got == [("R1", *title["R1"], 26, ",".join(sorted([*names[1::2], "o/1"]))), ("R6", *title["R6"], 50, ",".join(sorted(names)))]


def test_weekly_charts(spark):
    weekly = spark.createDataFrame([("prs_opened", "2025-W01", u, 1) for u in "abc"] + [("reviews_submitted", "2025-W01", "a", 4), ("prs_opened", "", "z", 9)], "metric_key string, period string, login string, count long")
    assert [(str(d), n) for d, n in rows(charts.active_people(weekly))] == [("2024-12-30", 3)]
    assert dict(rows(charts.contribution_types(weekly))) == {"PRs": 12, "Reviews": 4, "Issues": 0, "Comments": 0}


def test_busiest_month_reads_both_keys(spark):
    s = "metric_key string, period string, login string, count long"
    weekly = spark.createDataFrame([("prs_merged", "2025-W06", "a", 10), ("prs_merged", "2025-W07", "a", 20), ("prs_merged", "2025-W02", "a", 5)], s)
    assert rows(insights.most_active_month(weekly)) == [("2025-02", "February 2025", 30)]
    assert rows(insights.most_active_month(weekly.where("false"))) == []
    health = spark.createDataFrame([(1.0,), (2.0,), (None,)], "median_time_to_merge double")
    assert rows(insights.mean_merge_text(health)) == [(1.5, "1.5 hours")]


def test_people_compare_and_search(spark):
    counts = spark.createDataFrame([("prs_opened", "ann", 4), ("prs_opened", "bob", 1), ("reviews_submitted", "bob", 2)], "metric_key string, login string, value long")
    merged = contributors.merge_metrics(counts)
    assert {r["metric"]: (r["percent_a"], r["percent_b"]) for r in contributors.compare(merged, "ann", "bob").collect()}["prs_opened"] == (100.0, 25.0)
    with pytest.raises(ValueError):
        contributors.compare(merged, "ann", "ann")
    index = spark.createDataFrame([("contributor", "Ann", 1), ("repository", "o/ann", 5)], "kind string, name string, weight long")
    assert [r["name"] for r in search.global_search(index, "AN").collect()] == ["Ann", "o/ann"]
    assert search.global_search(index, "a").count() == 0


def test_joins(spark):
    tree = spark.createDataFrame([("r", ".github/workflows/a.yml", "blob", 1), ("r", ".github/workflows", "tree", None), ("r", "README.md", "blob", 2)], "repo_id string, path string, type string, size long")
    assert len(rows(joins.workflow_files(tree, [".github/", ".github/workflows/"]))) == 2
    got = rows(joins.file_presence(spark.createDataFrame([("r",), ("s",)], "repo_id string"), ["README.md"], tree), "repo_id")
    assert got == [("r", "README.md", True, "blob", 2), ("s", "README.md", False, None, None)]
    x = spark.createDataFrame([([1, 2],), ([],)], "n array<int>")
    assert [r[0] for r in x.select(joins.first_rule("n")).collect()] == [1, None]


def test_shares_and_ranks(star, spark):
    counts = metrics.leaderboard_counts(star[5])
    total = charts.shares(counts, "value").agg(F.sum("share")).first()[0]
    assert total == pytest.approx(1.0)
    by = metrics.ranked(counts).groupBy("metric_key").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["m"] == r["n"] for r in by)
    series = metrics.time_series(star[5], 2024).agg(F.sum("count")).first()[0]
    assert series <= counts.where(F.col("metric_key").isin(*metrics.SERIES)).agg(F.sum("value")).first()[0]


@pytest.mark.parametrize("wanted", [metrics.METRICS, metrics.SERIES, ("prs_merged", "review_comments_total")])
def test_one_row_per_fact_counts_like_one_row_per_metric(star, wanted):
    long = metrics.events_long(*star[:4], metrics=wanted)
    wide, timed = (metrics.facts_wide(*star[:4], metrics=wanted, timed=t) for t in (False, True))
    same = lambda f, other, key: rows(f(other), *key) == rows(f(long), *key)
    assert same(metrics.leaderboard_counts, wide, ("metric_key", "login"))
    assert same(lambda e: metrics.leaderboard_counts(e, "repo_id"), timed, ("metric_key", "repo_id", "login"))
    assert same(metrics.scoped_leaderboards, wide, ("metric_key", "scope", "repo_id", "login"))
    assert same(lambda e: metrics.time_series(e, 2024), timed, ("metric_key", "period", "login"))
    assert same(lambda e: metrics.repo_counters(e, star[4]), wide, ("repo_id",))
    assert same(lambda e: metrics.summary(e, star[4]), wide, ())
    assert same(lambda e: metrics.active_within(e, F.lit("2024-12-31").cast("timestamp")), timed, ("repo_id",))


def test_no_facts_give_no_counts(star):
    empty = metrics.facts_wide(*[df.limit(0) for df in star[:4]])
    assert metrics.leaderboard_counts(empty).count() == 0 and metrics.scoped_leaderboards(empty).count() == 0
    assert rows(metrics.summary(empty, star[4]))[0][:7] == (0,) * 7


def test_file_presence_like_a_join(spark, monkeypatch):
    repos = spark.createDataFrame([("r",), ("r",), ("s",), (None,)], "repo_id string")
    tree = spark.createDataFrame(
        [("r", "a", "blob", 1), ("r", "a", "blob", 7), ("r", "b", None, None), ("r", "z", "blob", 1), ("s", "a", "tree", None), (None, "a", "blob", 1), ("q", "a", "blob", 1), ("s", None, "blob", 1)],
        "repo_id string, path string, type string, size long",
    )
    expected = {("r", "a", True, "blob", 7), ("r", "b", True, None, None), ("s", "a", True, "tree", None), ("s", "b", False, None, None), (None, "a", False, None, None), (None, "b", False, None, None)}
    for n in (200_000, 2):
        monkeypatch.setattr(joins, "ROWS_PER_TASK", n)
        got = list(map(tuple, joins.file_presence(repos, ["a", "b"], tree).collect()))
        assert len(got) == 6 and set(got) == expected
    assert joins.file_presence(repos, [], tree).collect() == [] and joins.file_presence(repos.limit(0), ["a"], tree).collect() == []


def test_file_presence_sorts_a_bounded_number_of_rows_a_task(spark):
    repos = spark.range(300_000).select(F.concat(F.lit("o/"), "id").alias("repo_id")).coalesce(1)
    found = joins.file_presence(repos, ["a", "b"], repos.select("repo_id", F.lit("a").alias("path"), F.lit("blob").alias("type"), F.lit(1).alias("size")))
    tasks = found.groupBy(F.spark_partition_id()).agg(F.count_distinct("repo_id").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 300_000 and max(r["n"] for r in tasks) < 100_000
