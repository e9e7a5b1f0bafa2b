import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import minhash
from pulsegrid.llm.components import connected_components
from pulsegrid.llm.exact_dedup import build_directory, exact_dedup
from pulsegrid.llm.hashing import hash_words, shingle_sets
from pulsegrid.llm.minhash import near_dup_classes

from .conftest import MESSY, documents


def test_exact_on_messy_rows(messy, empty):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(messy).collect()), key=str)
    groups = {}
    for i, t in MESSY:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in MESSY:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup(empty).count() == 0


def test_directory_doubles_and_covers_every_slot(spark):
    crowded = spark.range(5000).select(F.shiftrightunsigned(F.xxhash64("id"), 2).alias("pseudo_key"))  # all in one quarter
    keys = crowded.unionByName(spark.range(90).select(F.xxhash64("id").alias("pseudo_key")))
    d = build_directory(keys, capacity=100, max_depth=10)
    rows = d.collect()
    depth = rows[0]["global_depth"]
    assert depth >= 6 and sorted(r["slot"] for r in rows) == list(range(1 << depth))
    slot = F.shiftrightunsigned("pseudo_key", 64 - depth)
    held = keys.select(slot.alias("slot")).join(d, "slot").groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert held <= 100
    assert len({r["bucket"] for r in rows}) < 1 << depth  # shallow buckets are shared by slots
    skewed = spark.range(300).select(F.lit(7).cast("long").alias("pseudo_key"))
    assert build_directory(skewed, capacity=100, max_depth=3).count() == 8  # cannot be split: stops at max_depth
    assert build_directory(spark.range(20_000).select(F.xxhash64("id").alias("pseudo_key"))).agg(F.max("local_depth")).first()[0] in (3, 4)
    assert [r["slot"] for r in build_directory(keys.limit(0)).collect()] == [0]


def test_exact_over_many_buckets(spark):
    random.seed(5)
    rows = [(i, f"text {random.randrange(700)}") for i in range(2000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(documents(spark, rows), capacity=16, max_depth=8).collect()}
    best, n = {}, {}
    for i, t in rows:
        best[t], n[t] = i, n.get(t, 0) + 1
    assert got == {i: (best[t], n[t]) for i, t in rows}


def test_the_directory_decides(spark):
    from pulsegrid.llm.common import materialize
    from pulsegrid.llm.exact_dedup import build_index, look_up

    rows = [(i, f"text {i % 50}") for i in range(200)]
    docs = documents(spark, rows)
    keys = docs.select(F.xxhash64("text").alias("pseudo_key")).distinct()
    directory = materialize(build_directory(keys, capacity=8, max_depth=6), "test-directory")
    index = build_index(docs, directory)
    assert look_up(docs, directory, index).count() == 200 and index.count() == 50
    assert index.select("bucket").distinct().count() > 4
    lost = directory.where("slot > 0")  # a slot is gone: what belongs there is neither inserted nor found
    assert 0 < look_up(docs, lost, index).count() < 200 and build_index(docs, lost).count() < 50
    astray = directory.withColumn("bucket", F.when(F.col("slot") == 0, "elsewhere").otherwise(F.col("bucket")))
    assert 0 < look_up(docs, astray, index).count() < 200
    owners = index.select("bucket", F.spark_partition_id().alias("p")).distinct().groupBy("bucket").count()
    assert owners.agg(F.max("count")).first()[0] == 1  # one owner task a bucket


def words(text):
    return (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def test_word_hashes_do_not_depend_on_where_pieces_are_cut(monkeypatch):
    data = b" ".join(b"w%d" % (i % 50) for i in range(5000)) + b" " + b"y" * 3000
    import pulsegrid.llm.hashing as h

    s1, h1 = hash_words(data)
    monkeypatch.setattr(h, "PIECE", 97)
    s2, h2 = hash_words(data)
    assert (s1 == s2).all() and (h1 == h2).all() and len(set(h1.tolist())) == 51
    assert [data[s : s + 3].split()[0] for s in s1[:5]] == [b"w0", b"w1", b"w2", b"w3", b"w4"]


def test_shingle_counts():
    texts = [t for _, t in MESSY] + ["a b c", "A B C d", "a a a a a a"]
    for k in (1, 4, 5):
        assert [len(s) for s in shingle_sets(texts, k)] == [len(shingles(t, k)) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)  # so that keys and clusters of many cells take part
    random.seed(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [random.choices(vocabulary, k=random.choice([3, 6, 20, 60, 150])) for _ in range(25)]
    rows = []
    for i in range(300):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 1, 2, 4, 8])):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        rows.append((i, " ".join(w)))
    want = brute(rows, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup_classes(documents(spark, rows), width=4).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < 250


def test_near_on_messy_rows(messy, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup_classes(messy, width=4).collect()}
    sizes = {i: len(shingles(t, 4)) for i, t in MESSY}
    assert got == {(i, sizes[i], None if i is None else {4: 1}.get(i, i), i != 4) for i, _ in MESSY}
    assert near_dup_classes(empty).count() == 0


def test_estimates_follow_the_true_similarity():
    rng = np.random.default_rng(3)
    for j in (0.2, 0.5, 0.8, 0.95):
        n = 4000
        both = int(n * 2 * j / (1 + j))
        pool = np.unique(rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
        got, error = minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None], np.array([n]), np.array([n]))
        assert abs(got[0] - j) < 5 * max(error[0], 0.02)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame(chain + hub + [(5, 5), (3, 2)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 201), 1), **dict.fromkeys(range(1000, 1300), 1000)}
    assert connected_components(links.limit(0)).count() == 0
