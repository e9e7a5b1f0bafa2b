import pytest

CLASHING = "kept boolean, component_id long, shard int, bucket string, sha string, score double, lang string, size long, text_sha256 string, src string"
SCHEMA = f"doc_id long, text string, {CLASHING}"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, 1, 2, "b", "s", 0.5, "xx", 3, "t", "u") for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 997}x{i}" for i in range(40_000))
MESSY = [(1, "Same text here, five words"), (2, None), (3, ""), (4, "Same text here, five words"), (4, "Same text here, five words"), (5, " \t\n"), (6, LONG), (7, "one"), (None, "no id at all here"), (8, "🎉 日本語 é́ \x00 ΣΑΣ İ")]


@pytest.fixture(scope="module")
def messy(spark):
    return documents(spark, MESSY)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"
