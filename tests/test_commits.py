from pyspark.sql import functions as F

from pulsegrid.plans import streams
from pulsegrid.streaming import commits, counters


def test_a_batch_counts_once_it_is_in_the_log(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = lambda *n: spark.createDataFrame([(x,) for x in n], "n int")
    assert commits.read_committed(spark, root, "n int").collect() == []
    sink = commits.committed(root)
    sink(rows(1, 2), 0)
    sink(rows(1, 2), 0)  # the batch comes again
    spark.createDataFrame([(9,)], "n int").write.parquet(f"{root}/data/batch=1/attempt=dead")  # written and never committed
    sink(rows(3), 1)
    read = lambda: sorted((r["batch"], r["n"]) for r in commits.read_committed(spark, root, "n int").collect())
    assert read() == [(0, 1), (0, 2), (1, 3)]
    assert commits.CommitLog(spark, root).sweep() == 1 and read() == [(0, 1), (0, 2), (1, 3)]


def test_the_log_folds_and_keeps_the_first_entry_of_a_batch(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    for b in range(commits.FOLD + 3):
        log.commit(b, {"attempt": f"a{b}"})
    log.commit(1, {"attempt": "again"})
    assert {b: e["attempt"] for b, e in log.entries().items()} == {b: f"a{b}" for b in range(commits.FOLD + 3)}
    (tmp_path / "_log" / "1.json").unlink()  # a fold holds what came before it
    assert log.entries()[1]["attempt"] == "a1"


def test_late_rows_are_kept_aside(spark, tmp_path):
    rows = [("m", "r", "ann", t, k, p) for k, (t, p) in enumerate([("2024-01-01", 0), ("2024-01-20", 0), ("2024-01-02", 1), ("2024-01-21", 1), (None, 1)])]
    df = spark.createDataFrame(rows, "metric_key string, repo_id string, login string, ts string, item_id long, part int").withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals = streams.Arrivals(df, str(tmp_path / "in"))
    shape, note = counters.flag_late("3 days", counters.week_end())
    for part in (0, 1):
        arrivals.arrive(part)
        counters.run_available(arrivals.stream(), commits.committed(str(tmp_path / "out"), shape, note), str(tmp_path / "state"), "append").awaitTermination()
    got = commits.read_committed(spark, str(tmp_path / "out"), "item_id long, late boolean").collect()
    assert {r["item_id"]: r["late"] for r in got} == {0: False, 1: False, 2: True, 3: False, 4: False}


def test_a_join_of_streams_keeps_to_its_interval(spark, tmp_path):
    prs = spark.createDataFrame([("r", 1, "2024-01-01", 0), ("r", 2, "2024-03-01", 1)], "repo_id string, number long, created_at string, part int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    reviews = [("r", 1, "2023-12-31", 0), ("r", 1, "2024-01-05", 0), ("r", 1, "2024-02-20", 1), ("r", 2, "2024-03-02", 1), (None, 2, "2024-03-02", 1)]
    reviews = spark.createDataFrame(reviews, "repo_id string, number long, submitted_at string, part int").withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    sides = streams.Arrivals(prs, str(tmp_path / "prs")), streams.Arrivals(reviews, str(tmp_path / "reviews"))
    for part in (0, 1):
        for s in sides:
            s.arrive(part)
        joined = counters.joined_reviews(sides[0].stream(), sides[1].stream(), "30 days", "1 day")
        counters.run_available(joined, commits.committed(str(tmp_path / "out")), str(tmp_path / "state"), "append").awaitTermination()
    got = commits.read_committed(spark, str(tmp_path / "out"), "number long, submitted_at timestamp").collect()
    assert sorted((r["number"], str(r["submitted_at"])[:10]) for r in got) == [(1, "2024-01-05"), (2, "2024-03-02")]
