"""Counters that follow a stream of activity rows (metric_key, repo_id, login, ts).

Exact distinct counts and medians are no streaming aggregates: distinct (person, week) pairs are kept in state by
dropDuplicates and finished in batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import iso_week_key
from ..operators import filters


def read_events(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Files of a folder as a stream; with a checkpoint each is read once, also after an interruption."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def weekly_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """metric_key, login, window, count per Monday week. 1970-01-01 was a Thursday: weeks start 4 days later."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(week, "metric_key", "login").agg(F.count("*").alias("count")).select("metric_key", "login", F.col("window.start").cast("date").alias("week"), "count")


def monthly_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """metric_key, login, day, month, count: counts of a month's days, to be summed by month when read.

    Months have no fixed length and are no window; days are, so their state goes with the watermark.
    """
    by_day = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "metric_key", "login").agg(F.count("*").alias("count"))
    return by_day.select("metric_key", "login", F.col("window.start").cast("date").alias("day"), F.date_format("window.start", "yyyy-MM").alias("month"), "count")


def totals(events: DataFrame) -> DataFrame:
    """Leaderboard totals: no year gate, state of one row per metric and person."""
    return events.groupBy("metric_key", "login").agg(F.count("*").alias("value"))


def in_year(events: DataFrame, year: int) -> DataFrame:
    """The gate of the windowed branch only; totals take every row."""
    return filters.in_year(events, year, "ts")


def first_seen_users(events: DataFrame, late: str | None = None) -> DataFrame:
    """Each login once. With `late`, state older than the watermark goes and a login may come again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["login"]) if late else events.dropDuplicates(["login"])


def first_reviews(reviews: DataFrame) -> DataFrame:
    """repo_id, number, first_review: the earliest review so far (update mode)."""
    return reviews.groupBy("repo_id", "number").agg(F.min("submitted_at").alias("first_review"))


def active_pairs(events: DataFrame) -> DataFrame:
    """Distinct (login, week) pairs as they appear; counting them in batch gives active weeks."""
    return events.select("login", iso_week_key(F.col("ts")).alias("week")).dropDuplicates(["login", "week"])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Work off what has arrived, a batch at a time, through foreachBatch, and stop.

    Started again with the same checkpoint, it goes on where it stopped: finished files are not read again. A batch that
    was cut off comes again with the same number, so sinks should write per batch number.
    """
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def parquet_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that overwrites the folder of its batch: the same batch twice leaves one copy."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def flag_late(late: str, window_end: Column, ts: str = "ts") -> tuple[Callable[[DataFrame, dict[int, dict]], DataFrame], Callable[[DataFrame], dict]]:
    """shape and note of commits.committed: keep late rows, flagged, instead of losing them.

    A row is late when its window had ended by the watermark, the latest time of all earlier batches less `late`: the rule by which
    windowed counts drop it. The latest time of a batch is in its log entry. Rows without a time are not late.
    """

    def shape(df: DataFrame, entries: dict[int, dict]) -> DataFrame:
        seen = [e["latest"] for e in entries.values() if e.get("latest")]
        if not seen:
            return df.withColumn("late", F.lit(False))
        mark = F.lit(max(seen)).cast("timestamp") - F.expr(f"INTERVAL {late}")
        return df.withColumn("late", F.coalesce(window_end <= mark, F.lit(False)))

    def note(written: DataFrame) -> dict:
        return {"latest": written.agg(F.max(ts).cast("string")).first()[0]}

    return shape, note


def week_end(ts: str = "ts") -> Column:
    """The end of the Monday week of a time."""
    return F.date_trunc("week", ts) + F.expr("INTERVAL 7 DAYS")


def joined_reviews(prs: DataFrame, reviews: DataFrame, within: str, late: str) -> DataFrame:
    """repo_id, number, created_at, submitted_at of reviews that come within a time of their pull request: a join of two streams.

    Both sides have watermarks and the interval bounds both, so a side's rows leave the state once no partner can come any more.
    """
    left = prs.withWatermark("created_at", late).select("repo_id", "number", "created_at")
    right = reviews.withWatermark("submitted_at", late).select(F.col("repo_id").alias("_repo"), F.col("number").alias("_number"), "submitted_at")
    near = F.expr(f"submitted_at >= created_at AND submitted_at <= created_at + INTERVAL {within}")
    return left.join(right, (F.col("repo_id") == F.col("_repo")) & (F.col("number") == F.col("_number")) & near).select("repo_id", "number", "created_at", "submitted_at")
