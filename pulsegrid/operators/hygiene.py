"""Repository hygiene: file presence, scores, status, adoption, risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ahead

# fixed values: files that count, and where CI lives
SECURITY_FILES = ("SECURITY.md", "security.md", ".github/SECURITY.md")
OWNER_FILES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS")
CONTRIBUTING_FILES = ("CONTRIBUTING.md", "contributing.md", ".github/CONTRIBUTING.md")
CI_FOLDERS = (".github/workflows/", ".circleci/config.yml")
CI_FILES = (".gitlab-ci.yml", "circle.yml", ".circleci/config.yml", ".travis.yml", "Jenkinsfile")
# fixed values: points of a score, and of the fallback score
SCORE = {
    "branch_protection_enabled": 25, "has_security_md": 10, "dependabot_enabled": 8, "secret_scanning_enabled": 7,
    "has_readme": 15, "has_contributing": 5, "has_license": 5, "has_codeowners": 10, "has_ci_workflows": 15,
}
MEANINGFUL = ("has_readme", "has_security_md", "has_codeowners", "has_ci_workflows", "has_contributing", "dependabot_enabled", "secret_scanning_enabled")


def on(flag: str) -> Column:
    """A three-state flag as a rule sees it: null is off."""
    return F.coalesce(F.col(flag), F.lit(False))


def file_flags(tree: DataFrame, repos: DataFrame) -> DataFrame:
    """repo_id and six presence flags from tree entries (repo_id, path): map-side combined, no list of paths."""
    p, up = F.col("path"), F.upper("path")
    ci = p.isin(*CI_FILES)
    for folder in CI_FOLDERS:
        ci = ci | p.startswith(folder)
    flags = {
        "has_readme": up.isin("README.MD", "README"), "has_security_md": p.isin(*SECURITY_FILES), "has_codeowners": p.isin(*OWNER_FILES),
        "has_contributing": p.isin(*CONTRIBUTING_FILES), "has_license": up.startswith("LICENSE"), "has_ci_workflows": ci,
    }
    found = tree.groupBy("repo_id").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    return repos.select("repo_id").distinct().join(found, "repo_id", "left").select("repo_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in flags])


def score() -> Column:
    total = F.lit(0)
    for flag, points in SCORE.items():
        total = total + F.when(on(flag), points).otherwise(0)
    return total


def fallback_score() -> Column:
    points = lambda c, n: F.when(c, n).otherwise(0)
    return (
        points(on("branch_protection_enabled"), 25) + points(on("has_security_md"), 15) + points(on("dependabot_enabled") | on("secret_scanning_enabled"), 10)
        + points(on("has_readme"), 15) + points(on("has_contributing"), 10) + points(on("has_codeowners"), 15) + points(on("has_ci_workflows"), 10)
    )


def is_meaningful() -> Column:
    out = F.lit(False)
    for f in MEANINGFUL:
        out = out | on(f)
    return out


def with_status(health: DataFrame, hygiene: DataFrame, healthy: int = 50, warning: int = 30) -> DataFrame:
    """Health rows (repo_id, prs_merged, active_contributors_365d) with score and status.

    With meaningful hygiene the score decides (the fallback score where it is 0 or null); otherwise activity does and
    the score is null.
    """
    joined = health.join(hygiene, "repo_id", "left")
    used = F.when(is_meaningful(), F.coalesce(F.nullif(F.col("score"), F.lit(0)), fallback_score()))
    merged, people = F.coalesce("prs_merged", F.lit(0)), F.coalesce("active_contributors_365d", F.lit(0))
    by_activity = F.when((merged >= 5) | (people >= 3), "healthy").when((merged >= 1) | (people >= 1), "warning").otherwise("critical")
    by_score = F.when(used >= healthy, "healthy").when(used >= warning, "warning").otherwise("critical")
    return joined.select("repo_id", "prs_merged", "active_contributors_365d", used.alias("hygiene_score"), F.when(is_meaningful(), by_score).otherwise(by_activity).alias("health_status"))


def hygiene_aggregate(hygiene: DataFrame) -> DataFrame:
    """One row of seven counts and a ratio; no row if no repository has a meaningful flag."""
    n = lambda c: F.count_if(c)
    out = hygiene.agg(
        n(on("has_security_md")).alias("security_md_count"), n(on("dependabot_enabled") | on("secret_scanning_enabled")).alias("security_features_count"),
        n(on("has_codeowners")).alias("codeowners_count"), n(on("branch_protection_enabled")).alias("branch_protection_count"),
        n(on("has_ci_workflows")).alias("ci_workflows_count"), F.avg(on("has_ci_workflows").cast("int")).alias("avg_workflows"),
        n(on("has_readme")).alias("readme_count"), n(on("has_contributing")).alias("contributing_count"), F.bool_or(is_meaningful()).alias("_any"),
    )
    return out.where("_any").drop("_any")


def repo_summary(view: DataFrame) -> DataFrame:
    """Counts by status, mean score of scored repositories, mean contributors."""
    s = F.col("health_status")
    return view.agg(
        F.count_if(s == "healthy").alias("healthy_count"), F.count_if(s == "warning").alias("warning_count"), F.count_if(s == "critical").alias("critical_count"),
        F.avg("hygiene_score").alias("avg_score"), F.avg("active_contributors_365d").alias("avg_contributors"),
    )


def adoption(hygiene: DataFrame, practices: dict[str, str]) -> DataFrame:
    """practice, percent of repositories with it."""
    each = F.array(*[F.struct(F.lit(name).alias("practice"), on(flag).cast("int").alias("x")) for name, flag in practices.items()])
    return hygiene.select(F.inline(each)).groupBy("practice").agg((F.avg("x") * 100).alias("percent"))


def have_and_missing(hygiene: DataFrame, flags: list[str]) -> DataFrame:
    """practice, slice (have, missing), count; empty slices are dropped."""
    each = F.array(*[F.struct(F.lit(f).alias("practice"), F.when(on(f), "have").otherwise("missing").alias("slice")) for f in flags])
    return hygiene.select(F.inline(each)).groupBy("practice", "slice").agg(F.count("*").alias("count"))


def score_bins(hygiene: DataFrame) -> DataFrame:
    """Histogram 80-100, 60-79, 40-59, 0-39 without empty bins."""
    s = F.coalesce("score", F.lit(0))
    return hygiene.groupBy(F.when(s >= 80, "80-100").when(s >= 60, "60-79").when(s >= 40, "40-59").otherwise("0-39").alias("bin")).agg(F.count("*").alias("repos"))


def score_range(hygiene: DataFrame) -> DataFrame:
    return hygiene.agg(F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def by_score(hygiene: DataFrame, k: int) -> DataFrame:
    return hygiene.select("repo_id", "score").orderBy(F.desc("score"), "repo_id").limit(k)


def access_tally(security: DataFrame, flags: list[str]) -> DataFrame:
    """access (all, partial, none) by how many of the flags could be read."""
    nulls = sum((F.col(f).isNull().cast("int") for f in flags), F.lit(0))
    return security.groupBy(F.when(nulls == 0, "all").when(nulls == len(flags), "none").otherwise("partial").alias("access")).agg(F.count("*").alias("repos"))


def protection_tally(protection: DataFrame) -> DataFrame:
    p = F.col("protection_enabled")
    return protection.groupBy(F.when(p, "enabled").when(~p, "disabled").otherwise("denied").alias("protection")).agg(F.count("*").alias("repos"))


NAMES_PER_PIECE = 10_000
#: Name, severity and title of the risk rules.
RISKS = (
    ("R1", "high", "Missing Security Policy"), ("R2", "medium", "Missing CI/CD"), ("R3", "medium", "Low Documentation Score"), ("R4", "low", "Missing CODEOWNERS"),
    ("R5", "medium", "Long Review Times"), ("R6", "high", "Low Review Coverage"), ("R7", "medium", "High Stale PR Count"), ("R8", "medium", "Low Contributor Activity"),
    ("R9", "high", "Disabled Security Features"), ("R10", "high", "No Branch Protection"),
)


def risks(
    hygiene: DataFrame, health: DataFrame, score_below: int = 60, review_hours: float = 48, coverage_below: float = 50, stale_above: int = 5, people_below: int = 2, compat: bool = False
) -> DataFrame:
    """rule, severity, title, repo_count, repos: a row for each rule that any repository breaks.

    Review times are compared in hours; compat=True holds hours against the limit in seconds instead. repos has all repositories by
    name as one comma-joined text. It is put together from pieces of `NAMES_PER_PIECE` neighbours, so no task holds a list of
    a rule's names, only its text; `risk_rows` has them as rows.
    """
    rule = ["rule", "severity", "title"]
    rows = risk_rows(hygiene, health, score_below, review_hours, coverage_below, stale_above, people_below, compat)
    placed = ahead(rows, "_place", [F.col("repo_id")], tuple(rule)).withColumn("_piece", F.floor(F.col("_place") / NAMES_PER_PIECE))
    pieces = placed.groupBy(*rule, "_piece").agg(F.count("*").alias("_n"), F.array_join(F.sort_array(F.collect_list("repo_id")), ",").alias("_names"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("_piece", "_names"))), lambda p: p["_names"])
    return pieces.groupBy(*rule).agg(F.sum("_n").alias("repo_count"), F.array_join(in_order, ",").alias("repos"))


def risk_rows(hygiene: DataFrame, health: DataFrame, score_below: int = 60, review_hours: float = 48, coverage_below: float = 50, stale_above: int = 5, people_below: int = 2, compat: bool = False) -> DataFrame:
    """rule, severity, title, repo_id: the long form, which stays distributed."""
    limit = review_hours * 3600 if compat else review_hours
    of_hygiene = {
        "R1": ~on("has_security_md"), "R2": ~on("has_ci_workflows"), "R3": F.coalesce("score", F.lit(0)) < score_below, "R4": ~on("has_codeowners"),
        "R9": ~on("dependabot_enabled") | ~on("secret_scanning_enabled"), "R10": ~on("branch_protection_enabled"),
    }
    of_health = {
        "R5": F.col("median_time_to_first_review") > limit, "R6": F.col("review_coverage") < coverage_below,
        "R7": F.col("stale_pr_count") > stale_above, "R8": F.coalesce("active_contributors_90d", F.lit(0)) < people_below,
    }
    text = {r: (severity, title) for r, severity, title in RISKS}

    def broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
        each = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(text[r][0]).alias("severity"), F.lit(text[r][1]).alias("title"))) for r, c in rules.items()]))
        return rows.where(F.col("repo_id").isNotNull()).select("repo_id", F.inline(each)).select("rule", "severity", "title", "repo_id")

    return broken(hygiene, of_hygiene).unionByName(broken(health, of_health))
