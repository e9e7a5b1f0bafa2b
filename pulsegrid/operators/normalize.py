"""From raw shapes to the activity tables: dimensions, facts, report shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import first_nonzero
from ..functions.people import is_bot
from ..functions.times import hours_between


def repo_metadata(raw: DataFrame) -> DataFrame:
    """The repository projection; rows without id, name or full_name go."""
    keep = ["id", "name", "full_name", "description", "language", "stargazers_count", "forks_count", "archived", "private", "fork", "visibility", "topics", "size", "pushed_at", "default_branch"]
    return raw.select(*[c for c in keep if c in raw.columns]).dropna(subset=["id", "name", "full_name"])


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first by `order`. A min over a struct, so map tasks combine first."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return best.select(key, *[F.col(f"_first.{c}").alias(c) for c in df.columns if c != key])


def repo_dimension(repos: DataFrame, order: list[str]) -> DataFrame:
    """First-seen repository by full name, with defaults for what is missing."""
    out = first_seen(repos, "repo_id", order)
    return out.select(
        "repo_id",
        F.coalesce("name", F.element_at(F.split("repo_id", "/"), -1)).alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce("stars", F.lit(0)).alias("stars"),
    )


def user_dimension(seen: DataFrame, order: list[str]) -> DataFrame:
    """First-seen user by login: avatar, type and the bot flag as of that sight."""
    out = first_seen(seen.where(F.coalesce("login", F.lit("")) != ""), "login", order)
    return out.select("login", "avatar_url", F.col("user_type").alias("type"), is_bot(F.col("login"), F.col("user_type")).alias("is_bot"))


def export_users(users: DataFrame) -> DataFrame:
    return users.where(~F.col("is_bot")).select("login", "avatar_url", "type")


def pr_details(prs: DataFrame, repos: DataFrame) -> DataFrame:
    """Merged pull requests of registered repositories by people: lines changed and hours to merge."""
    merged = prs.where(F.col("merged_at").isNotNull() & ~is_bot(F.col("login"), F.col("user_type")))
    return merged.join(repos.select("repo_id").distinct(), "repo_id", "left_semi").select(
        "repo_id", "number", "title", "login",
        (F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("lines_changed"),
        hours_between(F.col("created_at"), F.col("merged_at")).alias("merge_time_hours"),
    )


def leaderboard_rows(rows: DataFrame) -> DataFrame:
    """login and value from either of two namings; a value of 0 falls through to count."""
    return rows.select(
        "metric_key",
        F.coalesce(F.nullif("login", F.lit("")), F.col("user"), F.lit("")).alias("login"),
        F.coalesce("avatar_url", F.lit("")).alias("avatar_url"),
        first_nonzero(F.col("value"), F.col("count")).alias("value"),
    )


#: Title, description and unit of the awards.
AWARDS = {
    "top_pr_author": ("individual", "Top PR Author", "Most pull requests opened", "PRs opened"),
    "top_reviewer": ("individual", "Top Reviewer", "Most reviews submitted", "reviews"),
    "top_issue_opener": ("individual", "Top Issue Opener", "Most issues opened", "issues"),
}


def award_lists(flat: DataFrame, definitions: dict[str, tuple[str, str, str, str]] = AWARDS) -> DataFrame:
    """award_key, user, count -> category, title, description, winner_name and a text of the count; unknown awards go."""
    spark = flat.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in definitions.items()], "award_key string, category string, title string, description string, unit string")
    return flat.join(F.broadcast(known), "award_key").select(
        "award_key", "category", "title", "description", F.coalesce("user", F.lit("")).alias("winner_name"), F.concat_ws(" ", F.col("count").cast("string"), "unit").alias("supporting_stats")
    )


def _entries(raw: DataFrame, value: Column) -> DataFrame:
    """raw with key and value of every entry of a variant: an object's fields, or a list's items with a null key. Anything else has none."""
    spark = raw.sparkSession
    parsed = raw.withColumn("_entries", value)
    return parsed.lateralJoin(spark.tvf.variant_explode(F.col("_entries").outer())).drop("_entries", "pos")


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("value", f"$.{name}", kind)


def awards_from_shapes(raw: DataFrame, column: str = "awards") -> DataFrame:
    """award_key, user, count from one JSON text a row: flat, nested by category, or lists by category. The text is parsed once."""
    top = _entries(raw.select(F.col(column).alias("_text")), F.try_parse_json("_text")).select("key", "value")
    is_award = F.coalesce(_field("user", "string"), _field("count", "string")).isNotNull()
    flat = F.parse_json(F.concat(F.lit('{"'), F.col("key"), F.lit('": '), F.to_json("value"), F.lit("}")))
    each = _entries(top.select(F.when(is_award, flat).otherwise(F.col("value")).alias("_of")), F.col("_of"))
    rows = each.select(F.coalesce("key", _field("award_key", "string")).alias("award_key"), _field("user", "string").alias("user"), _field("count", "bigint").alias("count"))
    return rows.where("award_key is not null")


def metric_leaderboards(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Org-scope metric rows with the user's login and avatar."""
    known = users.select(F.col("login").alias("user_id"), "avatar_url")
    return rows.where((F.col("scope") == "org") & (F.coalesce("metric_key", F.lit("")) != "")).join(known, "user_id", "left").select(
        "metric_key", F.col("user_id").alias("login"), F.coalesce("avatar_url", F.lit("")).alias("avatar_url"), "value", "rank"
    )


def metric_series(rows: DataFrame) -> DataFrame:
    """Org-scope series: weekly for weeks, monthly for anything else."""
    granularity = F.when(F.col("period_type") == "week", "weekly").otherwise("monthly")
    return rows.where((F.col("scope") == "org") & (F.coalesce("metric_key", F.lit("")) != "")).select(granularity.alias("granularity"), "metric_key", "period", "login", F.col("value").alias("count"))


def metric_awards(rows: DataFrame, categories: tuple[str, ...] = ("individual", "repository", "risk")) -> DataFrame:
    return rows.where(F.col("category").isin(*categories)).withColumn("repo_name", F.coalesce("winner_repo_id", F.lit("")))


def _repositories(column: str) -> Column:
    """What holds the repositories of a JSON text: its field of that name, or the whole."""
    parsed = F.try_parse_json(column)
    return F.coalesce(F.try_variant_get(parsed, "$.repositories", "variant"), parsed)


def health_from_shapes(raw: DataFrame, column: str = "health") -> DataFrame:
    """repo_id, repo_full_name, prs_merged, review_coverage from a map by id, a list, or {repositories: either} as JSON text.

    A text is parsed once, to a variant. Null and malformed texts give no rows, fields of another type are null.
    """
    rows = _entries(raw, _repositories(column))
    name = F.coalesce(_field("repo_full_name", "string"), _field("repo", "string"), F.col("key"), _field("repo_id", "string"))
    return rows.select(
        F.coalesce(F.col("key"), _field("repo_id", "string"), name).alias("repo_id"), name.alias("repo_full_name"), F.coalesce(_field("prs_merged", "bigint"), F.lit(0)).alias("prs_merged"),
        _field("review_coverage", "double").alias("review_coverage"),
    )


def hygiene_from_shapes(raw: DataFrame, column: str = "hygiene") -> DataFrame:
    """repo_id, score from a map by id, {repositories: map or list}, or a list as JSON text. Parsed once, as health is."""
    rows = _entries(raw, _repositories(column))
    return rows.select(F.coalesce(F.col("key"), _field("repo_id", "string"), _field("repo", "string")).alias("repo_id"), _field("score", "int").alias("score")).where("repo_id is not null")


def flatten_protection(responses: DataFrame) -> DataFrame:
    """Branch protection by response status: 200 has settings, 404 none, 403 no access, anything else an error."""
    ok = F.col("status") == 200
    flag = lambda name: F.when(ok, F.coalesce(F.col(f"body.{name}.enabled"), F.lit(False))).alias(name)
    return responses.select(
        "repo",
        "branch",
        F.when(ok, F.lit(True)).when(F.col("status") == 404, F.lit(False)).alias("protection_enabled"),
        F.when(F.col("status") == 403, "403: permission denied").when(~F.col("status").isin(200, 404), F.format_string("%d: error", "status")).alias("error"),
        *[flag(n) for n in ("enforce_admins", "allow_force_pushes", "allow_deletions", "required_linear_history", "required_conversation_resolution")],
        F.when(ok, F.col("body.required_reviews.count")).alias("required_review_count"),
        F.when(ok, F.coalesce("body.required_reviews.dismiss_stale", F.lit(False))).alias("dismiss_stale_reviews"),
        F.when(ok, F.coalesce("body.required_reviews.code_owners", F.lit(False))).alias("require_code_owner_reviews"),
    )


PROTECTION_BODY = (
    "struct<enforce_admins: struct<enabled: boolean>, allow_force_pushes: struct<enabled: boolean>, allow_deletions: struct<enabled: boolean>, "
    "required_linear_history: struct<enabled: boolean>, required_conversation_resolution: struct<enabled: boolean>, "
    "required_reviews: struct<count: int, dismiss_stale: boolean, code_owners: boolean>>"
)
SECURITY_FEATURES = ("dependabot_alerts", "secret_scanning", "push_protection", "code_scanning")


def flatten_security(responses: DataFrame) -> DataFrame:
    """Four three-state flags from a struct of {status: enabled | disabled}; an error text if none can be seen."""
    flags = [(F.col(f"features.{f}.status") == "enabled").alias(f) for f in SECURITY_FEATURES]
    unseen = F.array_compact(F.array(*[F.col(f"features.{f}.status") for f in SECURITY_FEATURES]))
    return responses.select("repo", *flags, F.when(F.coalesce(F.size(unseen), F.lit(0)) <= 0, "no access to security features").alias("error"))


def hygiene_breakdown(hygiene: DataFrame, flags: list[str]) -> DataFrame:
    """repo_id, score, practice, present: long form of the flags."""
    wide = hygiene.select("repo_id", "score", *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags])
    return wide.unpivot(["repo_id", "score"], flags, "practice", "present")


def default_branch(graph: Column, rest: Column) -> Column:
    return F.coalesce(F.nullif(graph, F.lit("")), F.nullif(rest, F.lit("")), F.lit("main"))


def split_repo_name(df: DataFrame, column: str = "full_name") -> tuple[DataFrame, DataFrame]:
    """(rows with owner and repo, rejected rows): exactly two non-empty parts."""
    parts = F.split(F.coalesce(F.col(column), F.lit("")), "/", -1)
    ok = (F.size(parts) == 2) & (F.element_at(parts, 1) != "") & (F.element_at(parts, -1) != "")
    return df.where(ok).withColumn("owner", F.element_at(parts, 1)).withColumn("repo", F.element_at(parts, 2)), df.where(~ok)


def repo_of(nested: Column, url: Column) -> Column:
    """A repository's name from the nested object, else from an API address."""
    return F.coalesce(F.nullif(nested, F.lit("")), F.nullif(F.regexp_extract(url, r"/repos/([^/]+/[^/]+)", 1), F.lit("")))


def year_navigation(years: DataFrame, stats: DataFrame, current: int) -> DataFrame:
    """year, path, description, is_current, is_coming_soon and the year's stats if there are any; newest first."""
    return years.join(stats, "year", "left").select(
        "year",
        F.format_string("/%d/", "year").alias("path"),
        F.format_string("Year %d", "year").alias("description"),
        (F.col("year") == current).alias("is_current"),
        F.col("contributors").isNull().alias("is_coming_soon"),
        "contributors",
        "prs_merged",
    ).orderBy(F.desc("year"))


def report_summary(summary: DataFrame) -> DataFrame:
    """The summary under the report's names."""
    return summary.select(
        F.col("total_prs").alias("prs_opened"), F.col("prs_merged"), F.col("total_reviews").alias("reviews"), F.col("total_comments").alias("comments"),
        F.col("total_contributors").alias("contributors"), F.col("total_repos").alias("repos"),
    )


def fact_pull_request(raw: DataFrame) -> DataFrame:
    """Fact rows with text lengths, label names and the state `merged`."""
    return raw.select(
        "repo_id", "number", "login", "created_at", "merged_at",
        F.when(F.col("merged_at").isNotNull(), "merged").otherwise(F.lower("state")).alias("state"),
        F.length(F.coalesce("title", F.lit(""))).alias("title_length"), F.length(F.coalesce("body", F.lit(""))).alias("body_length"),
        F.transform(F.coalesce("labels", F.array().cast("array<struct<name: string>>")), lambda x: x["name"]).alias("labels"),
        F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"),
    )


def fact_issue(raw: DataFrame) -> DataFrame:
    """Real issues with text lengths and label names; pull requests that the issue list repeats are left out."""
    return raw.where(~F.coalesce("is_pull_request", F.lit(False))).select(
        "repo_id", "number", "login", "created_at", "closed_at", F.lower("state").alias("state"),
        F.length(F.coalesce("title", F.lit(""))).alias("title_length"), F.length(F.coalesce("body", F.lit(""))).alias("body_length"),
        F.transform(F.coalesce("labels", F.array().cast("array<struct<name: string>>")), lambda x: x["name"]).alias("labels"),
    )


def fact_review(raw: DataFrame) -> DataFrame:
    """Reviews with the upper-cased state."""
    return raw.select("repo_id", "number", "login", F.upper("state").alias("state"), "submitted_at")


def fact_comment(raw: DataFrame, *kinds: str) -> DataFrame:
    """Comments of the given kinds: `issue` (and `pr`) for the issue comments, `review` for the review comments."""
    return raw.where(F.col("comment_type").isin(*kinds)).select("repo_id", "number", "login", "created_at", F.length(F.coalesce("body", F.lit(""))).alias("body_length"))


def fact_commit_files(commits: DataFrame) -> DataFrame:
    """One row per file of a commit: extension and what kind of file it is."""
    path = F.lower("file.path")
    return commits.select("repo_id", "sha", "login", "committed_at", F.explode("files").alias("file")).select(
        "repo_id", "sha", "login", "committed_at", F.col("file.path").alias("path"), F.col("file.lines").alias("lines"),
        F.regexp_extract(path, r"\.([a-z0-9]+)$", 1).alias("file_ext"),
        path.rlike(r"(^|/)(docs?|documentation)/|\.(md|rst|adoc)$|(^|/)readme").alias("is_docs"),
        path.rlike(r"\.(tf|tfvars|bicep)$|(^|/)(terraform|helm|k8s|ansible)/|(^|/)dockerfile").alias("is_iac"),
        path.rlike(r"(^|/)tests?/|(^|/)test_|_test\.|\.spec\.").alias("is_test"),
        path.rlike(r"^\.github/workflows/|(^|/)jenkinsfile$|^\.gitlab-ci\.yml$|^\.circleci/").alias("is_ci"),
    )


def dim_time(df: DataFrame, column: str) -> DataFrame:
    """A row per day from the first to the last of a column: date, year, month, ISO week, weekday (1 is Monday). No row without a date."""
    from ..functions.times import iso_week_key, month_key

    ends = df.agg(F.to_date(F.min(column)).alias("first"), F.to_date(F.max(column)).alias("last"))
    days = ends.select(F.explode(F.sequence("first", "last")).alias("date"))
    return days.select("date", F.year("date").alias("year"), month_key(F.col("date")).alias("month"), iso_week_key(F.col("date")).alias("week"), (F.weekday("date") + 1).alias("weekday"))


def identity_rules(users: DataFrame, reason: Column) -> DataFrame:
    """dim_identity_rule: every login with the rule that decided."""
    return users.select("login", reason.alias("rule"))


def envelope_schema(data: T.DataType | str) -> T.StructType:
    """The record envelope around a payload type."""
    payload = T.DataType.fromDDL(data) if isinstance(data, str) else data
    return T.StructType(
        [T.StructField(n, T.StringType()) for n in ("timestamp", "source", "endpoint", "request_id")] + [T.StructField("page", T.IntegerType()), T.StructField("data", payload)]
    )


def last_row(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


