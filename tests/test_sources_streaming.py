import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import metrics
from pulsegrid.sources import records
from pulsegrid.streaming import counters


def test_envelopes_round_trip_and_rejects(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.createDataFrame([("o/a", 1), ("o/b", 2)], "repo string, number long")
    records.write_enveloped(df, path, "rest", "reviews")
    (tmp_path / "raw" / "bad.json").write_text("not json\n\n")
    good, bad = records.read_enveloped(spark, path, "review")
    assert sorted((r["data"]["repo"], r["data"]["number"]) for r in good.collect()) == [("o/a", 1), ("o/b", 2)]
    assert [r["line"] for r in bad.collect()] == ["not json"]
    assert records.count_records(spark, path) == 3 and records.count_records(spark, str(tmp_path / "none")) == 0
    assert good.select(F.count_distinct("request_id")).first()[0] == 2


def test_envelopes_are_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "RECORDS_PER_FILE", 2_000)
    df = spark.range(10_000).select(F.lit("o/a").alias("repo"), F.col("id").alias("number"), F.lit("APPROVED").alias("state")).coalesce(1)
    records.write_enveloped(df, str(tmp_path / "raw"), "rest", "reviews")
    files = list((tmp_path / "raw").glob("part-*"))
    assert len(files) == 5 and all(f.name.endswith(".json.gz") for f in files)
    lines = spark.read.text(str(tmp_path / "raw")).agg(F.sum(F.length("value") + 1)).first()[0]
    assert 3 * sum(f.stat().st_size for f in files) < lines
    good, bad = records.read_enveloped(spark, str(tmp_path / "raw"), "review")
    assert sorted(r[0] for r in good.select("data.number").collect()) == list(range(10_000)) and bad.count() == 0


def test_layout_tables_and_fallbacks(spark, tmp_path):
    df = spark.createDataFrame([(2024, "rest", "o/a", 1), (2023, "rest", "o/b", 2)], "year int, source string, target string, n int")
    records.write_raw(df, str(tmp_path / "raw"))
    back = spark.read.json(str(tmp_path / "raw"))
    assert [r["year"] for r in records.years(back).collect()] == [2024, 2023]
    records.write_table(df, str(tmp_path / "t"), ["year"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    empty = records.read_optional(spark, str(tmp_path / "none"), "a int")
    assert empty.columns == ["a"] and empty.count() == 0
    assert records.first_nonempty(empty, spark.createDataFrame([(1,)], "a int")).count() == 1
    with pytest.raises(FileNotFoundError):
        records.require({"summary": df}, "summary", "leaderboards")


def test_csv_quotes_everything(spark, tmp_path):
    records.write_csv(spark.createDataFrame([('a "b"\n c ', 1)], "t string, n int").coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text == '"t","n"\n"a ""b"" c","1"\n'


def test_file_names(spark):
    df = spark.createDataFrame([("o/r.x",)], "r string")
    assert df.select(records.repo_from_file(F.concat(records.file_of_repo(F.col("r")), F.lit(".jsonl")))).first()[0] == "o/r.x"


EVENTS = "metric_key string, repo_id string, login string, ts timestamp, item_id long"


def _write(spark, path, rows):
    spark.createDataFrame(rows, "metric_key string, repo_id string, login string, ts string, item_id long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    path, state, out = str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "out")
    _write(spark, path, [("prs_opened", "r", "ann", "2024-01-01 10:00:00", 1), ("prs_opened", "r", "ann", "2024-01-07 23:00:00", 2), ("prs_opened", "r", "bob", "2024-01-08 00:00:00", 3)])
    stream = counters.weekly_counts(counters.read_events(spark, path, EVENTS))
    run = lambda: counters.run_available(stream, counters.parquet_per_batch(out), state).awaitTermination()
    run()
    batches = len(list((tmp_path / "out").glob("batch=*")))
    run()  # nothing new: nothing is read again
    assert len(list((tmp_path / "out").glob("batch=*"))) == batches
    _write(spark, path, [("prs_opened", "r", "bob", "2024-01-09 00:00:00", 4)])
    run()
    latest = spark.read.parquet(out).groupBy("metric_key", "login", "week").agg(F.max_by("count", "batch").alias("count"))
    got = {(r["login"], str(r["week"])): r["count"] for r in latest.collect()}
    assert got == {("ann", "2024-01-01"): 2, ("bob", "2024-01-08"): 2}
    batch = metrics.time_series(spark.read.parquet(path), 2024)
    assert {(r["login"], r["period"]): r["count"] for r in batch.collect()} == {("ann", "2024-W01"): 2, ("bob", "2024-W02"): 2}


def test_first_seen_and_totals_in_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    _write(spark, path, [("prs_opened", "r", "ann", "2023-01-01 10:00:00", 1), ("prs_opened", "r", "ann", "2024-01-01 10:00:00", 2)])
    seen, totals, weeks = [], [], []
    events = counters.read_events(spark, path, EVENTS)
    for name, df, into, mode in (("a", counters.first_seen_users(events), seen, "append"), ("b", counters.totals(events), totals, "update"), ("c", counters.active_pairs(counters.in_year(events, 2024)), weeks, "append")):
        counters.run_available(df, lambda d, _, into=into: into.extend(d.collect()), str(tmp_path / name), mode).awaitTermination()
    assert [r["login"] for r in seen] == ["ann"] and [r["value"] for r in totals] == [2] and [r["week"] for r in weeks] == ["2024-W01"]
