import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import numbers, people, texts, times


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("day", "week"), [("2024-01-15", "2024-W03"), ("2024-12-30", "2025-W01"), ("2021-01-03", "2020-W53")])
def test_week_key(spark, day, week):
    assert one(spark, times.iso_week_key(F.col("d").cast("timestamp")), d=day) == week


@pytest.mark.parametrize(
    ("period", "date"),
    [("2025-W01", dt.date(2024, 12, 30)), ("2020-W53", dt.date(2020, 12, 28)), ("2025-02-03", dt.date(2025, 2, 3)), ("2025-02-30", None), ("2025-13", None), ("", None)],
)
def test_period_to_date(spark, period, date):
    assert one(spark, times.period_to_date(F.col("p")), p=period) == date


def test_times(spark):
    assert one(spark, times.iso_timestamp(F.col("t")).cast("string"), t="2024-03-01T10:00:00Z") == "2024-03-01 10:00:00"
    assert one(spark, times.iso_timestamp(F.col("t")), t="soon") is None
    a, b = F.lit("2024-01-01 12:00:00").cast("timestamp"), F.lit("2024-01-01 10:30:00").cast("timestamp")
    assert one(spark, times.hours_between(a, b)) == -1.5
    assert one(spark, times.month_key(a)) == "2024-01"
    assert one(spark, times.month_label(a)) == "January 2024"
    assert one(spark, times.date_label(a)) == "January 01, 2024"
    assert one(spark, times.inclusive_end(F.lit("2025-01-01").cast("date"))) == dt.date(2024, 12, 31)


@pytest.mark.parametrize(("hours", "short", "long"), [(0.5, "30m", "30 minutes"), (1.5, "1.5h", "1.5 hours"), (36.0, "1.5d", "1.5 days"), (0.999, "59m", "60 minutes")])
def test_durations(spark, hours, short, long):
    assert one(spark, texts.duration_short(F.col("h")), h=hours) == short
    assert one(spark, texts.duration_long(F.col("h")), h=hours) == long
    assert one(spark, texts.duration_short(F.lit(None).cast("double"))) == "N/A"


def test_numbers(spark):
    assert one(spark, numbers.first_nonzero(F.lit(0), F.lit(7))) == 7
    assert one(spark, numbers.first_nonzero(F.lit(None).cast("int"), F.lit(0))) == 0
    assert one(spark, numbers.percentage(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numbers.percentage(F.lit(1), F.lit(4))) == 25.0
    assert one(spark, numbers.scale_to_max(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, numbers.half_even(F.lit(2.5), 0)) == 2.0
    assert [one(spark, numbers.trend(F.lit(x))) for x in (1, -1, 0)] == ["up", "down", "neutral"]
    assert one(spark, numbers.trend(F.lit(1), inverse=True)) == "down"
    assert one(spark, texts.number_text(F.lit(1234567))) == "1,234,567"
    assert one(spark, texts.number_text(F.lit(None).cast("int"))) == "0"


@pytest.mark.parametrize(
    ("login", "kind", "bot"),
    [("dependabot[bot]", "User", True), ("Stale-Cleaner", "User", True), ("ann", "Bot", True), ("ann", "User", False), (None, "User", True), ("ann", None, False), ("robot", "User", False)],
)
def test_bots(spark, login, kind, bot):
    row = spark.createDataFrame([(login, kind)], "login string, kind string")
    assert row.select(people.is_bot(F.col("login"), F.col("kind"))).first()[0] is bot


def test_bot_reasons(spark):
    rows = spark.createDataFrame([("x[bot]", "User"), ("ann", "Bot"), ("ann", "User"), ("ci", "Bot"), ("dependabot", "User")], "login string, kind string")
    got = [r[0] for r in rows.select(people.bot_reason(F.col("login"), F.col("kind"), people=("ci",))).collect()]
    assert got == ["pattern: .*\\[bot\\]$", "type", "human", "override: human", "pattern: ^dependabot$"]


def test_redaction(spark):
    token = "ghp_" + "a" * 24
    text = f"use {token} and Authorization: abc, token=xyz api_key: q Bearer a.b-c"
    assert one(spark, texts.redact(F.col("t")), t=text) == "use [REDACTED_GH_TOKEN] and Authorization: [REDACTED], token=[REDACTED] api_key: [REDACTED] Bearer [REDACTED]"
    assert one(spark, texts.redaction_count(F.col("t")), t=text) == 5


def test_texts(spark):
    assert one(spark, texts.short_name(F.lit("org/repo"))) == "repo"
    assert one(spark, texts.count_label(F.lit(12), "reviews")) == "12 reviews"
    assert one(spark, texts.percent_label(F.lit(80.0), "coverage")) == "80% coverage"
    assert one(spark, texts.missing_notes({"README": F.lit(True), "CI": F.lit(None).cast("boolean")})) == "Missing: CI"
    assert one(spark, texts.stats_map(F.lit('{"a": 3}'))) == {"a": 3}
