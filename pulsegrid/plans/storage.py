"""Registered queries that write tables of a folder in the formats of the sources and read them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from ..sources import records
from ..sources.dimensions import StoredDimension, new_in_year
from ..streaming import counters
from .star import TREE_PATHS, Star, oracle
from .streams import fresh_folder, stream_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def q(name: str, sql: str):
    def register(f: Callable[[Star, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Star(spark, sf_dir), fresh_folder(spark))
        ORACLES[name] = oracle(sql)
        return f

    return register


@q("s1_s3_s19_enveloped_records", "SELECT repo_id AS repo, number, login, state, strftime(submitted_at, '%Y-%m-%d') AS day, 'rest' AS source, 'reviews' AS endpoint FROM reviews")
def _(s: Star, root: str) -> DataFrame:
    user = F.struct("login", "avatar_url", F.col("user_type").alias("type"))
    raw = s.reviews.select(F.col("repo_id").alias("repo"), "number", user.alias("user"), "state", F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("submitted_at"))
    records.write_enveloped(raw, f"{root}/raw", "rest", "reviews")
    good, _ = records.read_enveloped(s.spark, f"{root}/raw", "review")
    day = F.date_format(F.try_to_timestamp("data.submitted_at"), "yyyy-MM-dd")
    return good.select("data.repo", "data.number", "data.user.login", "data.state", day.alias("day"), "source", "endpoint")


@q("s2_malformed_lines", "SELECT count(*) FILTER (event_id % 7 <> 0) AS good, count(*) FILTER (event_id % 7 = 0) AS malformed FROM events")
def _(s: Star, root: str) -> DataFrame:
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("oops "), "props")).otherwise(F.concat(F.lit('{"source": "x", "data": '), "props", F.lit("}")))
    s.source("events").select(line.alias("value")).write.text(f"{root}/lines")
    good, bad = records.read_enveloped(s.spark, f"{root}/lines", "struct<k: bigint>")
    return good.agg(F.count("*").alias("good")).join(bad.agg(F.count("*").alias("malformed")), F.lit(True))


@q("s4_count_records", "SELECT (SELECT count(*) FROM events) AS n, CAST(0 AS BIGINT) AS missing")
def _(s: Star, root: str) -> DataFrame:
    s.source("events").select("props").write.text(f"{root}/lines")
    there, missing = records.counted_records(s.spark, f"{root}/lines"), records.counted_records(s.spark, f"{root}/none")
    return there.join(missing.withColumnRenamed("n", "missing"), F.lit(True))


@q("s5_raw_layout", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS target, count(*) AS n FROM orders GROUP BY ALL")
def _(s: Star, root: str) -> DataFrame:
    rows = s.source("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.lit("rest").alias("source"), F.col("o_orderpriority").alias("target"))
    records.write_raw(rows, f"{root}/raw")
    return s.spark.read.json(f"{root}/raw").groupBy("year", "target").agg(F.count("*").alias("n"))


@q("s7_s8_parquet_tables", "SELECT repo_id, number, login, additions FROM prs")
def _(s: Star, root: str) -> DataFrame:
    records.write_table(s.prs.select("repo_id", "number", "login", "additions"), f"{root}/fact_pull_request", ["repo_id", "number"])
    return s.spark.read.parquet(f"{root}/fact_pull_request")


@q("s9_s10_json_documents", "SELECT repo_id, score FROM scored")
def _(s: Star, root: str) -> DataFrame:
    from .activity import scored

    records.write_document(scored(s).select("repo_id", "score"), f"{root}/hygiene")
    records.require({"hygiene": records.read_optional(s.spark, f"{root}/hygiene", "repo_id string, score int")}, "hygiene")
    return records.read_optional(s.spark, f"{root}/hygiene", "repo_id string, score int")


@q("s11_s12_fallback_source", "SELECT repo_id, score FROM scored")
def _(s: Star, root: str) -> DataFrame:
    from .activity import scored

    main = records.read_optional(s.spark, f"{root}/missing", "repo_id string, score int")
    other = scored(s).select("repo_id", "score")
    records.require({"summary": other}, "summary")
    return records.first_nonempty(main, other)


@q("s17_repo_details", f"""SELECT repo_id, stars, CAST(id % 7 AS BIGINT) AS python, CASE WHEN id % 5 = 0 THEN 'main' ELSE 'trunk' END AS default_branch, coalesce(branch_protection_enabled, false) AS protected,
    coalesce(t.path IS NOT NULL, false) AS has_readme_file FROM repos JOIN (SELECT repo_id, branch_protection_enabled FROM hygiene) USING (repo_id) LEFT JOIN (SELECT * FROM tree WHERE path = '{TREE_PATHS[0]}') t USING (repo_id)""")  # fmt: skip
def _(s: Star, root: str) -> DataFrame:
    from ..operators.joins import file_presence

    languages = F.struct(F.array(F.struct((F.col("id") % 7).alias("size"), F.struct(F.lit("Python").alias("name")).alias("node"))).alias("edges"))
    counts = lambda a, b: F.struct(F.lit(1).cast("bigint").alias(a), F.lit(2).cast("bigint").alias(b))
    raw = s.repos.select(
        "full_name", languages.alias("languages"), "topics", F.struct(F.lit("MIT").alias("name")).alias("license"), F.struct(F.when(F.col("id") % 5 != 0, "trunk").alias("name")).alias("defaultBranchRef"),
        counts("open", "closed").alias("issues"), counts("open", "merged").alias("pulls"),
    )
    raw.write.json(f"{root}/details")
    details = s.spark.read.schema(records.payload("repo_detail")).json(f"{root}/details")
    protection = s.hygiene.select("repo_id", F.coalesce("branch_protection_enabled", F.lit(False)).alias("protected"))
    out = records.repo_details(details, s.repos.select("repo_id", "stars"), protection, file_presence(s.repos, [TREE_PATHS[0]], s.tree))
    return out.select("repo_id", "stars", F.element_at("languages", "Python").alias("python"), "default_branch", "protected", F.coalesce(F.element_at("files", TREE_PATHS[0]), F.lit(False)).alias("has_readme_file"))


@q("s18_manifest", "SELECT event_type AS outcome, count(*) AS repos FROM events GROUP BY ALL")
def _(s: Star, root: str) -> DataFrame:
    runs.write_manifest(runs.outcomes(s.source("events").withColumnRenamed("event_type", "outcome")), f"{root}/manifest")
    return s.spark.read.parquet(f"{root}/manifest").select("outcome", "repos")


@q("t3_resume", "SELECT count(*) AS rows, CAST(1 AS BIGINT) AS batches FROM events")
def _(s: Star, root: str) -> DataFrame:
    """The second run over the same checkpoint finds all files done and adds nothing."""
    for _ in range(2):
        counters.run_available(stream_of(s.spark, s.sf_dir, "events").select("event_id"), counters.parquet_per_batch(f"{root}/out"), f"{root}/state", "append").awaitTermination()
    return s.spark.read.parquet(f"{root}/out").agg(F.count("*").alias("rows"), F.count_distinct("batch").alias("batches"))


# --- tables that grow by loads -------------------------------------------------------------------------------------

_SEQUENCE = "(number * 7919) % 1000003"


@q("p3_w5_first_seen_over_loads", f"""SELECT login, arg_min(avatar_url || '?v=' || number, {_SEQUENCE}) AS avatar_url, arg_min(user_type, {_SEQUENCE}) AS user_type, min({_SEQUENCE}) AS sequence FROM prs
    WHERE login IS NOT NULL GROUP BY login""")  # fmt: skip
def _(s: Star, root: str) -> DataFrame:
    """Users over three loads, each given twice. What a later load saw earlier wins; the order of sights is not that of the values, and of equal ones the smallest number is first."""
    users = StoredDimension(s.spark, root, "login string, avatar_url string, user_type string, sequence long, number long", "login", "sequence", ties=("number",))
    seen = s.prs.select("login", F.concat("avatar_url", F.lit("?v="), "number").alias("avatar_url"), "user_type", F.expr(_SEQUENCE).alias("sequence"), "number")
    for load in (0, 1, 2, 0, 1, 2):
        users.load(seen.where(F.col("number") % 3 == load), load)
    return users.read().drop("number")


@q("p2_first_seen_repos_over_loads", f"SELECT repo_id, arg_min(title || ' ' || number, {_SEQUENCE}) AS description, min({_SEQUENCE}) AS sequence FROM prs GROUP BY repo_id")
def _(s: Star, root: str) -> DataFrame:
    repos = StoredDimension(s.spark, root, "repo_id string, description string, sequence long", "repo_id", "sequence")
    seen = s.prs.select("repo_id", F.concat_ws(" ", "title", "number").alias("description"), F.expr(_SEQUENCE).alias("sequence"), "number")
    for load in (1, 0):
        repos.load(seen.where(F.col("number") % 2 == load), load)
    return repos.read()


@q("a19_new_over_years", """SELECT repo_id, count(*) AS newcomers FROM (SELECT repo_id, login, min(ts) AS first_at FROM events_long
    WHERE metric_key IN ('prs_opened', 'reviews_submitted') AND year(ts) <= 1997 GROUP BY ALL) WHERE year(first_at) = 1997 GROUP BY repo_id""")  # fmt: skip
def _(s: Star, root: str) -> DataFrame:
    """People new to a repository in 1997, against the years before, whose loads come in any order."""
    pairs = StoredDimension(s.spark, root, "pair string, repo_id string, ts timestamp_ntz", "pair", "ts")
    events = s.events("prs_opened", "reviews_submitted").select(F.concat_ws(" ", "repo_id", "login").alias("pair"), "repo_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    for load, year in enumerate((1997, 1995, 1996)):
        pairs.load(events.where(F.year("ts") == year), load)
    new = new_in_year(pairs.read().withColumn("_key", F.struct("pair", "repo_id")), 1997, "_key", "ts")
    return new.groupBy(F.col("_key.repo_id").alias("repo_id")).agg(F.count("*").alias("newcomers"))


@q("s5_s13_year_partitions", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, 1 AS folders FROM orders
    WHERE year(o_orderdate) IN (1995, 1996) AND (year(o_orderdate) <> 1996 OR o_orderstatus = 'F') GROUP BY ALL""")  # fmt: skip
def _(s: Star, root: str) -> DataFrame:
    """All years are written, 1996 is written again with fewer rows, and two years are read: each from the files of one folder."""
    orders = s.source("orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    records.write_years(orders, f"{root}/orders")
    records.write_years(orders.where("year = 1996 AND o_orderstatus = 'F'"), f"{root}/orders")
    rows = records.read_years(s.spark, f"{root}/orders", 1995, 1996).withColumn("folder", F.regexp_extract(F.input_file_name(), "/(year=[^/]+)/", 1))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("folder").cast("int").alias("folders"))


@q("s13_stored_years", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) >= 2000")
def _(s: Star, root: str) -> DataFrame:
    records.write_years(s.source("orders").select("o_orderkey", F.year("o_orderdate").alias("year")), f"{root}/orders")
    return records.stored_years(s.spark, f"{root}/orders")


@q("s7_j1_bucketed_first_review", "SELECT p.repo_id, p.number, count(*) AS reviews, min(submitted_at) AS first_review FROM prs p JOIN reviews r ON p.repo_id = r.repo_id AND p.number = r.number GROUP BY ALL")
def _(s: Star, root: str) -> DataFrame:
    """Pull requests and reviews stored in buckets of (repo_id, number): their join and its grouping move no row."""
    keys = ["repo_id", "number"]
    records.write_bucketed(s.prs.select(*keys, "login", "created_at"), f"{root}/prs", keys)
    records.write_bucketed(s.reviews.select(*keys, "submitted_at"), f"{root}/reviews", keys)
    prs, reviews = (records.read_bucketed(s.spark, f"{root}/{t}", keys) for t in ("prs", "reviews"))
    return prs.select(*keys).join(reviews, keys).groupBy(*keys).agg(F.count("*").alias("reviews"), F.min("submitted_at").alias("first_review"))
