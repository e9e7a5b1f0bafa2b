"""Positions and running sums in slices against one plain window."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators import charts, contributors, metrics, ordering, ranking
from pulsegrid.operators.ordering import _with_slice, ahead, positions

SCHEMA = "team string, login string, value long, _o0 int"


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), f"u{i}", rng.choice([1, 1, 1, 2, 7, None]), i) for i in range(3000)]
    return spark.createDataFrame([*rows, ("c", None, 4, -1)], SCHEMA)


@pytest.mark.parametrize("within", [(), ("team",)])
@pytest.mark.parametrize("slices", [1, 7, 64])
def test_slices_give_what_one_window_gives(people, within, slices):
    order = [-F.col("value"), F.col("login")]
    w = Window.partitionBy(*within).orderBy(*order)
    plain = people.withColumn("n", F.row_number().over(w)).withColumn("s", F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = ahead(positions(people, "n", order, within, slices), "s", order, within, "value", slices)
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_no_slice_holds_much_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_SLICE", 300)
    rows = spark.range(20_000).select(F.lit("m").alias("metric_key"), F.concat(F.lit("u"), "id").alias("login"), F.lit(1).cast("long").alias("value"))
    ranked = metrics.ranked(rows)
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("metric_key").orderBy(F.desc("value"), "login")))
    assert ranked.exceptAll(plain).count() == 0 and ranked.count() == 20_000
    placed = rows.withColumn("_place", F.struct("metric_key", -F.col("value"), "login"))
    cut = _with_slice(placed, 64, 20_000).groupBy("_slice").count()
    assert cut.count() > 50 and cut.agg(F.max("count")).first()[0] < 20_000 / 64 * 2


@pytest.mark.parametrize("limit", [100, 700, 10_000])
def test_large_groups_are_cut_and_small_ones_are_not(people, monkeypatch, limit):
    monkeypatch.setattr(ordering, "ROWS_PER_SLICE", limit)
    order = [-F.col("value"), F.col("login")]
    w = Window.partitionBy("team").orderBy(*order)
    plain = people.withColumn("n", F.row_number().over(w)).withColumn("s", F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = ahead(positions(people, "n", order, ("team",)), "s", order, ("team",), "value")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_repeated_rows_and_empty_tables(spark):
    same = spark.createDataFrame([("m", "a", 1)] * 5, "metric_key string, login string, value long")
    assert sorted(r["rank"] for r in metrics.ranked(same).collect()) == [1, 2, 3, 4, 5]
    none = same.limit(0)
    assert metrics.ranked(none).collect() == [] and ranking.visible_rank(none, "value", "login").collect() == []
    assert [tuple(r) for r in metrics.bus_factor(none).collect()] == [(0,)] and metrics.bus_factor(none, "metric_key").collect() == []
    assert contributors.overall(none).collect() == []


def test_shares_and_first_items(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("c", 4)], "k string, v long")
    got = charts.running_share(df, "v", "k").orderBy("cumulative")
    assert [tuple(r) for r in got.collect()] == [("b", 5, 5, 0.5), ("c", 4, 9, 0.9), ("a", 1, 10, 1.0)]
    items = spark.createDataFrame([("x", "3"), ("x", "1"), ("x", "2"), ("y", "9"), (None, "7"), (None, None)], "k string, i string")
    got = {r["k"]: (r["shown"], r["more"]) for r in ranking.first_items(items, "k", "i", 2).collect()}
    assert got == {"x": ("1, 2", 1), "y": ("9", 0), None: ("7", 0)}


def test_bus_factor_of_keys(spark):
    rows = spark.createDataFrame([("r", "a", 5), ("r", "b", 4), ("r", "c", 4), ("q", "a", 1), (None, "z", 2)], "repo_id string, login string, value long")
    assert {tuple(r) for r in metrics.bus_factor(rows, "repo_id").collect()} == {("r", 2), ("q", 1), (None, 1)}
