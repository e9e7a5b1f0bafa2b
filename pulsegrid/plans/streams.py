"""Registered queries that run as streams over the tables' files and return what the sink holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import commits, counters
from .star import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fresh_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared place, deleted with its scope."""
    return scratch.new_folder(spark, "stream")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. A table of one file is picked out of its folder by name."""
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


def drained(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Work the stream off and return the last state of every key (all rows for append)."""
    root = fresh_folder(spark)
    counters.run_available(stream, counters.parquet_per_batch(f"{root}/out"), f"{root}/state", mode).awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    if mode == "append":
        return out.drop("batch")
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    last = out.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stream_of(spark, sf_dir, "events")
    return raw.select(F.col("event_type").alias("metric_key"), F.lit("org").alias("repo_id"), F.format_string("user%d", "user_id").alias("login"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("item_id"))


def q(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLES[name] = oracle(sql)
        return f

    return register


@q("t1_t5_weekly_counts", "SELECT event_type AS metric_key, 'user' || user_id AS login, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS count FROM events GROUP BY ALL")
def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(spark, counters.weekly_counts(_events(spark, sf_dir), "60 days"), "update", ["metric_key", "login", "week"])
    return out.withColumn("week", F.col("week").cast("string"))


@q("t2_first_seen_users", "SELECT DISTINCT 'user' || user_id AS login FROM events")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, counters.first_seen_users(_events(spark, sf_dir).select("login", "ts")).select("login"), "append", ["login"])


@q("t2_first_reviews", "SELECT l_orderkey % 2100 AS repo_id, l_orderkey AS number, min(l_shipdate) AS first_review FROM lineitem GROUP BY ALL")
def first_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = stream_of(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2100).alias("repo_id"), F.col("l_orderkey").alias("number"), F.col("l_shipdate").alias("submitted_at"))
    return drained(spark, counters.first_reviews(reviews), "update", ["repo_id", "number"])


@q("t4_totals", "SELECT event_type AS metric_key, 'user' || user_id AS login, count(*) AS value FROM events GROUP BY ALL")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, counters.totals(_events(spark, sf_dir)), "update", ["metric_key", "login"])


@q("t1_active_weeks", "SELECT 'user' || user_id AS login, count(DISTINCT strftime(ts, '%G-W%V')) AS active_weeks FROM events GROUP BY 1")
def active_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = drained(spark, counters.active_pairs(counters.in_year(_events(spark, sf_dir), 2024)), "append", ["login", "week"])
    return pairs.groupBy("login").agg(F.count("*").alias("active_weeks"))


@q("t1_monthly_counts", "SELECT event_type AS metric_key, 'user' || user_id AS login, strftime(ts, '%Y-%m') AS month, count(*) AS count FROM events GROUP BY ALL")
def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = drained(spark, counters.monthly_counts(_events(spark, sf_dir), "60 days"), "update", ["metric_key", "login", "day"])
    return days.groupBy("metric_key", "login", "month").agg(F.sum("count").alias("count"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reviews of several years."""
    raw = stream_of(spark, sf_dir, "lineitem")
    return raw.select(F.lit("reviews_submitted").alias("metric_key"), F.lit("org").alias("repo_id"), F.format_string("user%d", "l_suppkey").alias("login"), F.col("l_shipdate").cast("timestamp").alias("ts"))


@q(
    "t4_year_gate",
    """SELECT login, value, in_year FROM (SELECT 'user' || l_suppkey AS login, count(*) AS value, count(*) FILTER (year(l_shipdate) = 1995) AS in_year FROM lineitem GROUP BY 1)""",
)
def year_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the year are missing in the weekly series and counted in the totals."""
    totals = drained(spark, counters.totals(_reviews(spark, sf_dir)), "update", ["metric_key", "login"])
    gated = drained(spark, counters.weekly_counts(counters.in_year(_reviews(spark, sf_dir), 1995), "400 days"), "update", ["metric_key", "login", "week"])
    weeks = gated.groupBy("login").agg(F.sum("count").alias("in_year"))
    return totals.join(weeks, "login", "left").select("login", "value", F.coalesce("in_year", F.lit(0)).alias("in_year"))


# --- streams in several batches: rows arrive a part at a time, and after each part the stream is started again ----


class Arrivals:
    """Rows of a table that arrive in parts, as files of a folder that streams read."""

    def __init__(self, rows: DataFrame, folder: str):
        self.rows, self.folder = rows, folder

    def arrive(self, part: int) -> None:
        self.rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(self.folder)

    def stream(self) -> DataFrame:
        return counters.read_events(self.rows.sparkSession, self.folder, self.rows.drop("part").schema)


DELAYED = "least(CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', ts) / 6) AS BIGINT) + CASE event_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, 4)"


def _delayed_events(spark: SparkSession, sf_dir: str, folder: str) -> Arrivals:
    """Events in five parts of six days; one in ten comes two parts late, one in ten a part late."""
    days = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 6)
    part = F.least(days + F.when(F.col("event_id") % 10 == 0, 2).when(F.col("event_id") % 10 == 1, 1).otherwise(0), F.lit(4))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Arrivals(rows.select(F.col("event_type").alias("metric_key"), F.lit("org").alias("repo_id"), F.format_string("user%d", "user_id").alias("login"), F.col("ts").cast("timestamp").alias("ts"), "event_id", part.alias("part")), folder)


@q(
    "t1_late_weeks",
    f"""WITH e AS (SELECT event_type, ts, date_trunc('week', ts) AS week, {DELAYED} AS part FROM events),
    m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3 DAYS AS mark FROM e GROUP BY part)
    SELECT event_type AS metric_key, strftime(week, '%Y-%m-%d') AS week, count(*) FILTER (NOT coalesce(week + INTERVAL 7 DAYS <= mark, false)) AS on_time,
           count(*) FILTER (week + INTERVAL 7 DAYS <= mark) AS late FROM e JOIN m USING (part) GROUP BY ALL""",
)
def late_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-time counts from the windowed state, whose watermark moves with every part, and late rows from where they are kept aside."""
    root = fresh_folder(spark)
    events = _delayed_events(spark, sf_dir, f"{root}/in")
    shape, note = counters.flag_late("3 days", counters.week_end())
    for part in range(5):
        events.arrive(part)
        counts = counters.run_available(counters.weekly_counts(events.stream(), "3 days"), commits.committed(f"{root}/weeks"), f"{root}/weeks-state")
        aside = counters.run_available(events.stream(), commits.committed(f"{root}/rows", shape, note), f"{root}/rows-state", "append")
        counts.awaitTermination()
        aside.awaitTermination()
    weeks = commits.read_committed(spark, f"{root}/weeks", "metric_key string, login string, week date, count long")
    counted = weeks.groupBy("metric_key", "login", "week").agg(F.max_by("count", "batch").alias("count")).groupBy("metric_key", "week").agg(F.sum("count").alias("on_time"))
    rows = commits.read_committed(spark, f"{root}/rows", "metric_key string, repo_id string, login string, ts timestamp, event_id long, late boolean")
    late = rows.where("late").groupBy("metric_key", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("late"))
    out = counted.join(late, ["metric_key", "week"], "full")
    return out.select("metric_key", F.col("week").cast("string").alias("week"), F.coalesce("on_time", F.lit(0)).alias("on_time"), F.coalesce("late", F.lit(0)).alias("late"))


@q("t3_t5_cut_off_runs", "SELECT event_type AS metric_key, count(*) AS n, count(DISTINCT event_id) AS n_distinct, CAST(3 AS BIGINT) AS batches, 1 AS left_over FROM events GROUP BY event_type")
def cut_off_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run dies with its second batch written and not committed, the next with the third committed and not checkpointed; a last one goes on."""
    root = fresh_folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = Arrivals(rows.select(F.col("event_type").alias("metric_key"), "event_id", (F.col("event_id") % 3).alias("part")), f"{root}/in")

    def run(dies: tuple[int, str] | None = None) -> None:
        def between(batch: int, step: str) -> None:
            if (batch, step) == dies:
                raise InterruptedError(f"cut off: batch {batch} {step}")

        try:
            counters.run_available(events.stream(), commits.committed(f"{root}/out", between=between), f"{root}/state", "append").awaitTermination()
        except StreamingQueryException as e:
            if "cut off" not in str(e):
                raise

    for part, dies in enumerate((None, (1, "written"), (2, "committed"))):
        events.arrive(part)
        run(dies)
    run()
    left = commits.CommitLog(spark, f"{root}/out").sweep()
    out = commits.read_committed(spark, f"{root}/out", "metric_key string, event_id long")
    batches = out.agg(F.count_distinct("batch").alias("batches"))
    return out.groupBy("metric_key").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct")).join(batches, F.lit(True)).withColumn("left_over", F.lit(left))


def _years(date: str) -> Column:
    return F.floor((F.year(date) - 1995) / 2)


@q(
    "t2_j1_streamed_first_review",
    """SELECT o_orderkey % 2100 AS repo_id, o_orderkey AS number, min(l_shipdate) AS first_review FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 400 DAYS GROUP BY ALL""",
)
def streamed_first_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests and reviews as two streams, two years at a time."""
    root = fresh_folder(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    prs = read("orders").select((F.col("o_orderkey") % 2100).alias("repo_id"), F.col("o_orderkey").alias("number"), F.col("o_orderdate").cast("timestamp").alias("created_at"), _years("o_orderdate").alias("part"))
    reviews = read("lineitem").select((F.col("l_orderkey") % 2100).alias("repo_id"), F.col("l_orderkey").alias("number"), F.col("l_shipdate").cast("timestamp").alias("submitted_at"), _years("l_shipdate").alias("part"))
    sides = Arrivals(prs, f"{root}/prs"), Arrivals(reviews, f"{root}/reviews")
    for part in range(4):
        for side in sides:
            side.arrive(part)
        joined = counters.joined_reviews(sides[0].stream(), sides[1].stream(), "400 days", "7 days")
        counters.run_available(joined, commits.committed(f"{root}/out"), f"{root}/state", "append").awaitTermination()
    pairs = commits.read_committed(spark, f"{root}/out", "repo_id long, number long, created_at timestamp, submitted_at timestamp")
    return pairs.groupBy("repo_id", "number").agg(F.min("submitted_at").cast("timestamp_ntz").alias("first_review"))


@q(
    "t2_seen_within_watermark",
    """WITH a AS (SELECT DISTINCT l_orderkey AS item, (year(l_shipdate) - 1995) // 2 AS part FROM lineitem)
    SELECT item, CAST(1 + CASE WHEN count(*) FILTER (part IN (0, 3)) = 2 THEN 1 ELSE 0 END AS BIGINT) AS times FROM a GROUP BY item""",
)
def seen_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sights with bounded state: a key is kept for 400 days past its time, so only one that comes in the first and the fourth part is seen again."""
    root = fresh_folder(spark)
    part = _years("l_shipdate")
    day = F.make_date((F.lit(1995) + 2 * part).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("login"), day.alias("ts"), part.alias("part"))
    seen = Arrivals(rows, f"{root}/in")
    for k in range(4):
        seen.arrive(k)
        counters.run_available(counters.first_seen_users(seen.stream(), "400 days"), commits.committed(f"{root}/out"), f"{root}/state", "append").awaitTermination()
    out = commits.read_committed(spark, f"{root}/out", "login string, ts timestamp")
    return out.groupBy(F.col("login").cast("long").alias("item")).agg(F.count("*").alias("times"))
