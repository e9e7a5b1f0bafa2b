import corpus_pipeline
from pyspark.sql import functions as F

from pulsegrid.llm.decontaminate import find_leaks
from pulsegrid.llm.toxicity import score_held_out
from pulsegrid.sources import scratch

from .conftest import documents
from .test_dedup import brute


def test_every_stage_acts_on_what_the_last_one_kept(spark, tmp_path, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            gone = {r["doc_id"] for r in score_held_out(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
        elif name == "exact dedup":
            best = {}
            for i, t in before.items():
                best[t] = max(i, best.get(t, i))
            gone = set(before) - set(best.values())
        elif name == "near dedup":
            rows = sorted(before.items())
            gone = {i for i, (_, c) in brute(rows, 5).items() if c != i}
        elif name == "decontamination":
            gone = {r["doc_id"] for r in find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
        else:
            gone = set()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r["doc_id"] for r in docs.collect()} == set(before) - gone, name
        if name != "bpe":
            assert docs.columns == columns
    final = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{shared}")
    with scratch.scope():
        assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == final
        assert len(list(shared.glob("pipeline-*"))) == 1  # what the last stage reads
    assert list(shared.iterdir()) == []


def test_copies_stage_leaves_one_of_repeated_rows(spark, messy, empty):
    out = corpus_pipeline.drop_copies(spark, messy, "")
    assert out.columns == messy.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert ids == sorted([3, 4, 5, 6, 7, 8, None], key=str)
    assert corpus_pipeline.drop_copies(spark, empty, "").count() == 0


def test_near_stage_takes_five_words(spark):
    words = [f"w{i}" for i in range(60)]
    edited = words[:30] + ["other"] + words[31:]
    docs = documents(spark, [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1]))])
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {1, 3}
    assert docs.select(F.count("*")).first()[0] == 3


UNIQUE = "a text that nothing else in this small table is like, at all or in part"
SEVERAL = [(5, "A plain text"), (9, "A plain text"), (5, UNIQUE), (9, UNIQUE + " but longer"), (None, "A plain text")]


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_no_stage_loses_another_text_of_an_id(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:30] + ["other"] + words[31:])
    docs = documents(spark, [*SEVERAL, (1, " ".join(words)), (5, near), (0, "short one"), (0, near + " x")])
    out = corpus_pipeline.drop_copies(spark, docs, "")
    assert pairs(out) == sorted([(9, "A plain text"), (5, UNIQUE), (9, UNIQUE + " but longer"), (None, "A plain text"), (1, " ".join(words)), (5, near), (0, "short one"), (0, near + " x")], key=str)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    left = pairs(out)
    # the two ids of the near class are larger than 0; the other texts of 5 and 9 stay
    assert (5, UNIQUE) in left and (0, "short one") in left and (0, near + " x") in left and (None, "A plain text") in left
    assert (1, " ".join(words)) not in left and (5, near) not in left and (5, "A plain text") in left and (9, "A plain text") not in left
    sf_dir = str(tmp_path)
    spark.createDataFrame([(1, near)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    left = pairs(corpus_pipeline.drop_contaminated(spark, docs, sf_dir))
    assert (5, UNIQUE) in left and (5, "A plain text") in left and (5, near) not in left and (0, "short one") in left


def test_toxic_stage_drops_the_toxic_text_alone(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = score_held_out(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = scores.where("predicted = 1").join(docs, "doc_id").orderBy("doc_id").first()
    clean = scores.where("predicted = 0 and score < 0.1").join(docs.where("length(text) > 300"), "doc_id").orderBy("doc_id").first()
    more = docs.unionByName(docs.where(F.col("doc_id") == toxic["doc_id"]).withColumn("text", F.lit(clean["text"])))
    left = pairs(corpus_pipeline.drop_toxic(spark, more, sf_dir))
    assert (toxic["doc_id"], clean["text"]) in left and (toxic["doc_id"], toxic["text"]) not in left


def test_stages_on_messy_and_empty_tables(spark, messy, empty):
    sf_dir = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, messy, sf_dir), stage(spark, empty, sf_dir)
        assert none.count() == 0
        if name == "bpe":
            assert out.count() == messy.count()
            continue
        assert out.columns == messy.columns == none.columns
        ids = [r["doc_id"] for r in out.collect()]
        assert None in ids and {3, 6, 7, 8} <= set(ids), name
        if name in ("toxicity", "decontamination"):
            assert len(ids) == messy.count()
