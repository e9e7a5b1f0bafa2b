"""Tables that grow, rules and prefixes that come as tables, postings, medians, scopes."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import identity, joins, normalize, search, selection
from pulsegrid.sources import records, scratch
from pulsegrid.sources.dimensions import StoredDimension


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_sights_over_loads(spark, tmp_path):
    dim = StoredDimension(spark, str(tmp_path), "login string, avatar string, seq long", "login", "seq")
    rows = lambda *r: spark.createDataFrame(r, "login string, avatar string, seq long, extra int").drop("extra")
    read = lambda: {r["login"]: (r["avatar"], r["seq"]) for r in dim.read().collect()}
    assert read() == {}
    dim.load(rows(("ann", "z", 5, 0), ("ann", "a", 6, 0), ("bob", "b", 9, 0), (None, "n", 1, 0), ("eve", "e", None, 0)), 1)
    assert read() == {"ann": ("z", 5), "bob": ("b", 9)}
    dim.load(rows(("ann", "y", 7, 0), ("bob", "c", 2, 0), ("eve", "e", 3, 0)), 2)  # bob was seen earlier after all
    assert read() == {"ann": ("z", 5), "bob": ("c", 2), "eve": ("e", 3)}
    dim.load(rows(("ann", "x", 1, 0)), 2)  # a load that was taken before
    assert read() == {"ann": ("z", 5), "bob": ("c", 2), "eve": ("e", 3)}
    dim.load(rows(("ann", "z", 5, 0), ("eve", "e", 3, 0)), 3)
    assert spark.read.parquet(str(tmp_path / "data")).count() == 4  # nothing new was appended


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_equal_sequences_over_loads_have_one_winner(spark, tmp_path, order):
    loads = [("ann", "b", 5, 10), ("ann", "a", 5, 9), ("ann", "c", 6, 1)], [("ann", "z", 5, 2), ("bob", "x", 1, None)], [("bob", "w", 1, None), ("bob", "v", 1, 3)]
    for ties, expected in (("number",), [("ann", "z", 5, 2), ("bob", "w", 1, None)]), ((), [("ann", "a", 5, 9), ("bob", "v", 1, 3)]):
        dim = StoredDimension(spark, str(tmp_path / f"by-{len(ties)}"), "login string, avatar string, seq long, number long", "login", "seq", ties=ties)
        for n in order:
            dim.load(spark.createDataFrame(loads[n], "login string, avatar string, seq long, number long"), n)
        assert sorted(map(tuple, dim.read().collect())) == expected


def test_first_seen_users_of_one_sequence(spark, tmp_path):
    from pulsegrid.plans import storage

    orders = spark.createDataFrame([(n, 1, "F", 1.0, "1-URGENT") for n in (1000008, 5, 2000011)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders.withColumn("o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "orders.parquet"))
    with scratch.scope():
        got = storage.QUERIES["p3_w5_first_seen_over_loads"](spark, str(tmp_path)).collect()
    assert list(map(tuple, got)) == [("user1", "https://avatars/1?v=5", "User", 5 * 7919)]


def test_years_are_replaced_and_pruned_alone(spark, tmp_path):
    root = str(tmp_path / "t")
    records.write_years(spark.createDataFrame([(1, 2023), (2, 2024), (3, 2024), (4, 1999)], "n int, year int"), root)
    old = sorted(p.name for p in (tmp_path / "t" / "year=2023").glob("part-*"))
    records.write_years(spark.createDataFrame([(9, 2024)], "n int, year int"), root)
    assert sorted(p.name for p in (tmp_path / "t" / "year=2023").glob("part-*")) == old
    one = records.read_years(spark, root, 2024)
    assert [r["n"] for r in one.collect()] == [9] and "PartitionFilters: [isnotnull(year" in plan(one)
    assert {r[0].split("/year=")[1][:4] for r in one.select(F.input_file_name()).collect()} == {"2024"}
    assert records.read_years(spark, root).count() == 3
    (tmp_path / "t" / "year=later").mkdir()
    assert [r["year"] for r in records.stored_years(spark, root).collect()] == [2024, 2023]
    assert records.stored_years(spark, str(tmp_path / "none")).collect() == []


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    keys = ["repo_id", "number"]
    left = spark.createDataFrame([("r", 1, "a"), ("q", 2, "b")], "repo_id string, number long, x string")
    right = spark.createDataFrame([("r", 1, 5), ("r", 1, 6), (None, 1, 7)], "repo_id string, number long, y int")
    for name, df in (("left", left), ("right", right)):
        records.write_bucketed(df, str(tmp_path / name), keys, 4)
        records.write_bucketed(df, str(tmp_path / name), keys, 4)  # again, over the old one
    read = lambda n: records.read_bucketed(spark, str(tmp_path / n), keys, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = read("left").join(read("right"), keys).groupBy(*keys).agg(F.sum("y").alias("y"))
        assert "Exchange" not in plan(joined)
        assert [tuple(r) for r in joined.collect()] == [("r", 1, 11)]
        spark.sql(f"DROP TABLE {records._bucket_table(str(tmp_path / 'left'))}")  # as another session would find it
        assert "Exchange" not in plan(read("left").join(read("right"), keys)) and read("left").count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prefixes_of_a_table(spark):
    files = spark.createDataFrame([("r", ".github/workflows/ci.yml"), ("r", "docs/a"), ("r", ""), ("r", None), ("r", "docs/a")], "repo_id string, path string")
    prefixes = spark.createDataFrame([(p,) for p in (".github/", ".github/workflows/", "doc", "doc", "nothing", "", None)], "prefix string")
    out = joins.under_prefixes(files, prefixes)
    got = sorted((r["path"], r["prefix"]) for r in out.collect())
    assert got == sorted([(".github/workflows/ci.yml", p) for p in ("", ".github/", ".github/workflows/")] + 2 * [("docs/a", p) for p in ("", "doc")] + [("", "")])
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert joins.under_prefixes(files, prefixes.limit(0)).collect() == []


def test_rules_decide_by_rank(spark, monkeypatch):
    rules = [(1, "human", "ann", 0), (2, "bot", "ann", 1), (3, "bot", "zed", 1), (4, "type", "Bot", 2), (5, "pattern", "z.*", 3), (6, "pattern", ".*-ci$", 3), (7, "pattern", None, 0), (8, "bot", "zed", 1)]
    rules = spark.createDataFrame(rules, "rule_id int, kind string, value string, rank int")
    people = spark.createDataFrame([("ann", "Bot", 1), ("zed", "User", 2), ("zoe", "User", 3), ("x-ci", "User", 4), ("x-ci-y", "User", 5), (None, "Bot", 6), (None, None, 7), ("zip", "Bot", 8)], "login string, user_type string, reason int")
    want = {"ann": (1, "override: human", False), "zed": (3, "override: bot", True), "zoe": (5, "pattern: z.*", True), "x-ci": (6, "pattern: .*-ci$", True), "x-ci-y": (None, "human", False), "zip": (4, "type", True)}
    for small, block in ((identity.SMALL, identity.BLOCK), (0, 1)):
        monkeypatch.setattr(identity, "SMALL", small)
        monkeypatch.setattr(identity, "BLOCK", block)
        out = identity.classify(people.drop("reason"), rules).collect()
        assert {r["login"]: (r["rule_id"], r["reason"], r["is_bot"]) for r in out if r["login"]} == want
        assert sorted((r["user_type"] or "", r["reason"]) for r in out if not r["login"]) == [("", "human"), ("Bot", "type")]
    assert {r["reason"] for r in identity.classify(people.drop("reason"), rules.limit(0)).collect()} == {"human"}
    with pytest.raises(ValueError):
        identity.classify(people, rules, most_patterns=1)


@pytest.mark.parametrize("rows", [1, 2, 5, 400, 401])
def test_medians_by_selection(spark, rows):
    rng = random.Random(rows)
    values = [rng.choice([7, 7, 7, rng.randrange(1000)]) for _ in range(rows)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    assert selection.median(df, "v", rows_per_slice=20).first()[0] == statistics.median(values)
    assert selection.median(df.limit(0), "v").first()[0] is None


def test_names_are_found_through_postings(spark, tmp_path):
    names = spark.createDataFrame([("contributor", "Ann-Lee", 3), ("contributor", "annika", 9), ("repository", "org/annex", 1), ("repository", "x", 1), ("repository", None, 1), ("repository", "Ünü", 2)], "kind string, name string, weight long")
    index = search.NameIndex(spark, str(tmp_path))
    index.build(names)
    terms = spark.createDataFrame([(t,) for t in ("ANN", "n-", "nnex", "x", "zzz", None, "ann", "", "anna", "ünü")], "term string")
    got = sorted((r["term"], r["name"]) for r in index.find(terms).collect())
    assert got == sorted([(t, n) for t in ("ANN", "ann") for n in ("Ann-Lee", "annika", "org/annex")] + [("n-", "Ann-Lee"), ("nnex", "org/annex"), ("ünü", "Ünü")])
    assert [r["name"] for r in index.first_hits(terms.where("term = 'ann'"), 2).orderBy("place").collect()] == ["annika", "Ann-Lee"]


def test_shapes_through_variants(spark):
    health = ['{"a": {"repo": "A", "review_coverage": 12.5}}', '[{"repo_id": "b", "prs_merged": 3}]', '{"repositories": {"c": {"review_coverage": null}}}', '{"repositories": [{"repo_full_name": "D"}]}', "nonsense", None, "[]", "5"]
    got = normalize.health_from_shapes(spark.createDataFrame([(h,) for h in health], "health string")).collect()
    assert sorted(map(tuple, got)) == sorted([("a", "A", 0, 12.5), ("b", "b", 3, None), ("c", "c", 0, None), ("D", "D", 0, None)], key=lambda r: r[0])
    awards = ['{"top": {"user": "u", "count": 2}}', '{"individual": {"top": {"user": "v", "count": 3}}}', '{"individual": [{"award_key": "top", "user": "w", "count": 4}]}', "{}", None]
    got = normalize.awards_from_shapes(spark.createDataFrame([(a,) for a in awards], "awards string")).collect()
    assert sorted(map(tuple, got)) == [("top", "u", 2), ("top", "v", 3), ("top", "w", 4)]


def test_a_scope_deletes_what_it_wrote(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    with scratch.scope():
        outer = scratch.written(spark.range(5).toDF("n"), "outer")
        with scratch.scope():
            assert scratch.written(outer, "inner").count() == 5
        assert len(list(tmp_path.iterdir())) == 1 and outer.count() == 5
    assert list(tmp_path.iterdir()) == []


@pytest.mark.parametrize("name", ["w2_d10_scoped_leaderboards", "a20_a38_size_stats", "f23_f24_s14_postings", "p3_w5_first_seen_over_loads", "t2_first_seen_users"])
def test_a_query_in_a_scope_leaves_nothing(spark, tmp_path, monkeypatch, name):
    from pulsegrid.plans import activity, storage, streams

    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    with scratch.scope():
        assert (activity.QUERIES | storage.QUERIES | streams.QUERIES)[name](spark, "/root/testdata/sf0.001").count() > 0
        assert list(tmp_path.iterdir())
    assert list(tmp_path.iterdir()) == []
