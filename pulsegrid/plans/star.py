"""The activity tables derived from the driver's tables, in Spark and as SQL text for the other engine.

orders are pull requests, lineitem their reviews, events issues and comments, part repositories with their
hygiene and file trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.people import BOT_PARTS
from ..operators.metrics import METRICS, events_long, facts_wide

TREE_PATHS = ("README.md", "LICENSE", "SECURITY.md", ".github/CODEOWNERS", "CONTRIBUTING.md", ".github/workflows/ci.yml", ".github/workflows/lint.yml", "docs/index.md", ".travis.yml")


def _user(n: str) -> str:
    return (
        f"CASE WHEN ({n}) % 29 = 0 THEN NULL WHEN ({n}) % 23 = 0 THEN concat('renovate-', CAST({n} AS STRING), '[bot]') ELSE concat('user', CAST({n} AS STRING)) END AS login, "
        f"CASE WHEN ({n}) % 31 = 0 THEN 'Bot' ELSE 'User' END AS user_type, concat('https://avatars/', CAST({n} AS STRING)) AS avatar_url"
    )


def _repo(n: str) -> str:
    return f"concat('org/repo', CAST({n} AS STRING))"


#: ADD(ts, hours) and EACH(list) are put in per dialect.
VIEWS = {
    "prs": f"""SELECT {_repo("o_orderkey % 2100")} AS repo_id, o_orderkey AS number, concat('PR ', o_orderpriority) AS title, {_user("o_custkey % 500")},
        o_orderdate AS created_at, ADD(o_orderdate, 120) AS updated_at, CASE WHEN o_orderstatus = 'F' THEN ADD(o_orderdate, o_orderkey % 400) END AS merged_at,
        CAST(floor(o_totalprice / 100) AS BIGINT) AS additions, o_orderkey % 300 AS deletions, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state FROM orders""",
    "issues": f"""SELECT {_repo("event_id % 2100")} AS repo_id, event_id AS number, {_user("user_id")}, CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state,
        ts AS created_at, ADD(ts, event_id % 90) AS updated_at, CASE WHEN event_id % 3 = 0 THEN ADD(ts, event_id % 200) END AS closed_at, event_id % 11 = 0 AS is_pull_request
        FROM events WHERE event_type IN ('error', 'signup')""",
    "reviews": f"""SELECT {_repo("l_orderkey % 2100")} AS repo_id, l_orderkey AS number, {_user("l_suppkey + l_linenumber")},
        CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'changes_requested' ELSE 'COMMENTED' END AS state, l_shipdate AS submitted_at FROM lineitem""",
    "comments": f"""SELECT {_repo("event_id % 2100")} AS repo_id, event_id AS number, {_user("user_id + 7")}, ts AS created_at,
        CASE event_type WHEN 'click' THEN 'issue' WHEN 'view' THEN 'pr' ELSE 'review' END AS comment_type FROM events WHERE event_type IN ('click', 'view', 'purchase')""",
    "repos": f"""SELECT {_repo("p_partkey")} AS repo_id, p_partkey AS id, concat('repo', CAST(p_partkey AS STRING)) AS name, {_repo("p_partkey")} AS full_name, p_name AS description,
        CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_brand END AS language, CAST(floor(p_retailprice) AS BIGINT) AS stars, p_size % 11 = 0 AS archived, p_partkey % 9 = 0 AS private,
        p_size % 7 = 0 AS fork, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 9 = 0 THEN 'private' ELSE 'public' END AS visibility, split(p_name, ' ') AS topics,
        p_size * 100 AS size_kb, CASE WHEN p_partkey % 17 = 0 THEN 'unknown' ELSE concat('2024-', lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0'), '-15T00:00:00Z') END AS pushed_at,
        CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'trunk' END AS default_branch FROM part""",
    "hygiene": f"""SELECT {_repo("p_partkey")} AS repo_id, p_size % 2 = 0 AS has_readme, p_partkey % 3 = 0 AS has_license, p_size % 5 = 0 AS has_contributing, p_partkey % 7 = 0 AS has_security_md,
        p_size % 3 = 0 AS has_codeowners, p_partkey % 4 < 2 AS has_ci_workflows, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 6 < 3 END AS branch_protection_enabled,
        CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 5 = 1 END AS dependabot_enabled, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_size % 4 = 0 END AS secret_scanning_enabled FROM part""",
    "tree": f"""SELECT repo_id, path, CASE WHEN k % 8 = 0 THEN 'tree' ELSE 'blob' END AS type, CAST(k * 10 AS BIGINT) AS size FROM (
        SELECT {_repo("p_partkey")} AS repo_id, path, p_partkey + length(path) AS k FROM (SELECT p_partkey, EACH(PATHS) AS path FROM part) x) y WHERE k % 3 <> 0""",
}
_PATHS = ", ".join(f"'{p}'" for p in TREE_PATHS)


def _dialect(sql: str, spark: bool) -> str:
    import re

    sql = re.sub(r"ADD\(([^,]+), ([^)]+)\)", r"timestampadd(HOUR, \2, \1)" if spark else r"(\1 + to_hours(\2))", sql)
    return sql.replace("EACH(PATHS)", f"explode(array({_PATHS}))" if spark else f"unnest([{_PATHS}])")


SOURCES = {"prs": "orders", "issues": "events", "reviews": "lineitem", "comments": "events", "repos": "part", "hygiene": "part", "tree": "part"}


class Star:
    """The derived tables of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        source = SOURCES[name]
        return self.spark.sql(_dialect(VIEWS[name], True).replace(f"FROM {source}", "FROM {source}"), source=self.source(source))

    def events(self, *metrics: str) -> DataFrame:
        """The long table of the named metrics, or of all."""
        return events_long(self.prs, self.issues, self.reviews, self.comments, metrics or METRICS)

    def facts(self, *metrics: str, timed: bool = False, before: Column | None = None) -> DataFrame:
        """One row per fact with a flag for each of the named metrics, or of all."""
        return facts_wide(self.prs, self.issues, self.reviews, self.comments, metrics or METRICS, timed, before)


_BOT = " OR ".join(f"contains(lower(login), '{p}')" for p in BOT_PARTS)
PEOPLE = f"NOT (login IS NULL OR user_type = 'Bot' OR {_BOT}) AND login <> ''"
DERIVED = {
    "events_long": f"""SELECT 'prs_opened' AS metric_key, repo_id, login, created_at AS ts, number AS item_id FROM prs WHERE {PEOPLE}
        UNION ALL SELECT 'prs_merged', repo_id, login, merged_at, number FROM prs WHERE {PEOPLE} AND merged_at IS NOT NULL
        UNION ALL SELECT 'issues_opened', repo_id, login, created_at, number FROM issues WHERE {PEOPLE} AND NOT is_pull_request
        UNION ALL SELECT 'issues_closed', repo_id, login, closed_at, number FROM issues WHERE {PEOPLE} AND NOT is_pull_request AND closed_at IS NOT NULL
        UNION ALL SELECT 'reviews_submitted', repo_id, login, submitted_at, number FROM reviews WHERE {PEOPLE}
        UNION ALL SELECT 'approvals', repo_id, login, submitted_at, number FROM reviews WHERE {PEOPLE} AND upper(state) = 'APPROVED'
        UNION ALL SELECT 'changes_requested', repo_id, login, submitted_at, number FROM reviews WHERE {PEOPLE} AND upper(state) = 'CHANGES_REQUESTED'
        UNION ALL SELECT 'comments_total', repo_id, login, created_at, number FROM comments WHERE {PEOPLE}
        UNION ALL SELECT 'review_comments_total', repo_id, login, created_at, number FROM comments WHERE {PEOPLE} AND comment_type IN ('pr', 'review')""",
    "users": f"""SELECT login, min(avatar_url) AS avatar_url, min(user_type) AS user_type, min(NOT ({PEOPLE})) AS is_bot FROM (
        SELECT login, user_type, avatar_url FROM prs UNION ALL SELECT login, user_type, avatar_url FROM reviews) u WHERE login IS NOT NULL GROUP BY login""",
    "counts": "SELECT metric_key, login, count(*) AS value FROM events_long GROUP BY ALL",
    "weekly": """SELECT metric_key, strftime(ts, '%G-W%V') AS period, login, count(*) AS count FROM events_long
        WHERE year(ts) = 1997 AND metric_key IN ('prs_opened','prs_merged','issues_opened','issues_closed','reviews_submitted','comments_total') GROUP BY ALL""",
    "dated": """SELECT *, CAST(strptime(period || '-1', '%G-W%V-%u') AS DATE) AS date FROM weekly""",
    "details": f"""SELECT repo_id, number, title, login, additions + deletions AS lines_changed, (epoch_us(merged_at) - epoch_us(created_at)) / 3.6e9 AS merge_time_hours
        FROM prs WHERE {PEOPLE} AND merged_at IS NOT NULL AND repo_id IN (SELECT repo_id FROM repos)""",
    "health": f"""SELECT r.repo_id, coalesce(contributor_count, 0) AS contributor_count, coalesce(pr_count, 0) AS pr_count, coalesce(issue_count, 0) AS issue_count,
        coalesce(review_count, 0) AS review_count, coalesce(comment_count, 0) AS comment_count,
        CASE WHEN coalesce(p.n, 0) = 0 THEN 0.0 ELSE coalesce(v.n, 0) * 100.0 / p.n END AS review_coverage, m.h AS median_time_to_merge, f.h AS median_time_to_first_review
        FROM (SELECT DISTINCT repo_id FROM repos) r
        LEFT JOIN (SELECT repo_id, count(DISTINCT login) AS contributor_count, count(*) FILTER (metric_key = 'prs_opened') AS pr_count, count(*) FILTER (metric_key = 'issues_opened') AS issue_count,
                   count(*) FILTER (metric_key = 'reviews_submitted') AS review_count, count(*) FILTER (metric_key = 'comments_total') AS comment_count
                   FROM events_long WHERE metric_key IN ('prs_opened','issues_opened','reviews_submitted','comments_total') GROUP BY repo_id) e USING (repo_id)
        LEFT JOIN (SELECT repo_id, count(*) AS n FROM prs WHERE {PEOPLE} GROUP BY repo_id) p USING (repo_id)
        LEFT JOIN (SELECT repo_id, count(DISTINCT number) AS n FROM reviews WHERE {PEOPLE} GROUP BY repo_id) v USING (repo_id)
        LEFT JOIN (SELECT repo_id, median((epoch_us(merged_at) - epoch_us(created_at)) / 3.6e9) AS h FROM prs WHERE {PEOPLE} AND merged_at IS NOT NULL GROUP BY repo_id) m USING (repo_id)
        LEFT JOIN (SELECT repo_id, median(h) AS h FROM first_review GROUP BY repo_id) f USING (repo_id)""",
    "first_review": f"""SELECT p.repo_id, p.number, (epoch_us(min(v.submitted_at)) - epoch_us(min(p.created_at))) / 3.6e9 AS h
        FROM (SELECT * FROM prs WHERE {PEOPLE}) p JOIN (SELECT * FROM reviews WHERE {PEOPLE}) v ON p.repo_id = v.repo_id AND p.number = v.number GROUP BY p.repo_id, p.number""",
    "scored": """SELECT *, CASE WHEN branch_protection_enabled THEN 25 ELSE 0 END + CASE WHEN has_security_md THEN 10 ELSE 0 END + CASE WHEN dependabot_enabled THEN 8 ELSE 0 END
        + CASE WHEN secret_scanning_enabled THEN 7 ELSE 0 END + CASE WHEN has_readme THEN 15 ELSE 0 END + CASE WHEN has_contributing THEN 5 ELSE 0 END + CASE WHEN has_license THEN 5 ELSE 0 END
        + CASE WHEN has_codeowners THEN 10 ELSE 0 END + CASE WHEN has_ci_workflows THEN 15 ELSE 0 END AS score FROM hygiene""",
    "merged": "SELECT login, " + ", ".join(f"CAST(coalesce(sum(value) FILTER (metric_key = '{m}'), 0) AS BIGINT) AS {m}" for m in (
        "prs_opened", "prs_merged", "issues_opened", "issues_closed", "reviews_submitted", "approvals", "changes_requested", "comments_total", "review_comments_total")) + " FROM counts GROUP BY login",
}


def oracle(select: str) -> str:
    """A SELECT over the derived tables as one SQL text with the tables it needs in front."""
    import re

    need: list[str] = []

    def visit(sql: str) -> None:
        for name in [*VIEWS, *DERIVED]:
            if name not in need and re.search(rf"(?i)\b(FROM|JOIN)\s+{name}\b", sql):
                visit(VIEWS.get(name) or DERIVED[name])
                if name not in need:
                    need.append(name)

    visit(select)
    parts = [f"{n} AS ({_dialect(VIEWS[n], False) if n in VIEWS else DERIVED[n]})" for n in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select
