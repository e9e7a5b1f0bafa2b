"""Nearest neighbours and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from pulsegrid.llm import ann, hard_negatives
from pulsegrid.llm.common import table
from pulsegrid.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, rank int, score double, tile int, list int, v binary, twin string"


def frame(spark, rows):
    """Rows (vec_id, embedding, label) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, 0.5, 3, 4, b"x", "t") for r in rows], SCHEMA)


def messy_rows(n: int, d: int = 6, seed: int = 3):
    """Random vectors with a hot one, near copies of it, ties, repeated rows and rows that take no part."""
    rng = random.Random(seed)
    hot = [rng.gauss(0, 1) for _ in range(d)]
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else [x + rng.gauss(0, 0.01) for x in hot] if i % 7 == 0 else [rng.gauss(0, 1) for _ in range(d)]
        rows.append((i, [float(np.float32(x)) for x in v], rng.randrange(4)))
    rows += [rows[5], rows[100], rows[100], (rows[20][0], rows[20][1], rows[20][2])]
    bad = [None, [0.0] * d, [1.0] * (d - 1) + [None], [math.nan] * d, [math.inf] + [1.0] * (d - 1), [1.0] * (d + 1), []]
    return rows + [(n + k, v, 1) for k, v in enumerate(bad)] + [(None, [1.0] * d, 1), (n + 50, [1.0] * d, None)]


def taking_part(rows, d=6, label=False, zero=False):
    ok = [(i, v, c) for i, v, c in rows if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)) and (not label or c is not None)]
    return sorted({(i, tuple(v), c if label else 0) for i, v, c in ok})


def plain_negatives(rows, d=6, every=50):
    rows = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in taking_part(rows, d, label=True, zero=True)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, v, c in rows:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, e) for j, w, e in rows)
        for p, j, _ in [x for x in scored if x[2] == c and x[1] != i][:5]:
            fit = [x for x in scored if x[2] != c and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(i, j, r, x[1], -p, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"tile_rows": 64, "sample_rows": 100, "block_rows": 40, "anchor_rows": 5}])
def test_negatives_equal_brute_force(spark, blocks):
    rows = messy_rows(900)
    got = hard_negatives.hard_negatives(frame(spark, rows), **blocks)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_negatives_of_small_and_empty_tables(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.7, 0.0], 2), (3, [-1.0, 0.0], 2)], [(0, None, 1)], [(0, [], 1), (1, [], 2)]):
        assert sorted(map(tuple, hard_negatives.hard_negatives(frame(spark, rows)).collect())) == plain_negatives(rows, 2)
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(frame(spark, [(0, [1e30, 1.0], 1)])).collect()


def test_intervals_hold_every_product_of_a_box():
    rng = np.random.default_rng(1)
    v, q = rng.integers(-50, 50, (200, 5)).astype(float), rng.integers(-50, 50, (9, 5)).astype(float)
    tree = hard_negatives.Tree(v)
    assert sorted(tree.order.tolist()) == list(range(200))
    for lo, hi in zip(tree.lo, tree.hi, strict=True):
        per = math.ceil(200 / len(lo)) if len(lo) > 1 else 200
        low, high = hard_negatives.intervals(q, lo, hi)
        for b in range(len(lo)):
            s = q @ tree.v[b * per : (b + 1) * per].T if len(lo) == math.ceil(200 / hard_negatives.PAGE) else q @ tree.v.T
            if len(lo) in (1, math.ceil(200 / hard_negatives.PAGE)):
                per = hard_negatives.PAGE if len(lo) > 1 else 200
                s = q @ tree.v[b * per : (b + 1) * per].T
                assert (low[:, b] <= s.min(axis=1)).all() and (high[:, b] >= s.max(axis=1)).all()
    seen = []
    tree.search(q, lambda who, low, high: high >= 0, lambda who, rows, scores: seen.append(scores.max()))
    assert max(seen) == (q @ v.T).max()  # a box with the largest product is never passed over


def plain_nearest(rows, k=20, every=20, d=6):
    rows = taking_part(rows, d)
    out = {}
    for i, v, _ in rows:
        if i % every == 0:
            scored = []
            for j, w, _ in rows:
                if j != i:
                    s = 0.0
                    for x, y in zip(v, w, strict=True):
                        s += x * y
                    scored.append((-s, j))
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def test_one_list_gives_the_exact_neighbours(spark):
    rows = messy_rows(300)
    got = {}
    for r in ann.nearest(frame(spark, rows), list_rows=1_000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = plain_nearest(rows)
    assert got == {q: [(n, j, s) for n, (j, s) in enumerate(found, 1)] for q, found in want.items()}


def test_many_lists_reach_the_recall_and_fill_every_rank(spark):
    rows = messy_rows(2_000, seed=8)
    found = ann.nearest(frame(spark, rows), list_rows=32, block_rows=50, query_rows=30, bound_rows=200).cache()
    want = plain_nearest(rows)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in got.values())
    # copies of the hot vector tie in hundreds: a neighbour of the same score is as near
    near = sum(s >= want[q][-1][1] for q, x in got.items() for _, s in x) / (20 * len(want))
    assert near >= 0.9
    true = {(q, j): s for q, x in plain_nearest(rows, k=10_000).items() for j, s in x}
    assert all(true[q, j] == s for q, x in got.items() for j, s in x)  # scores are exact


def test_neighbours_of_small_and_empty_tables(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, None, 1)], [(0, [0.0, 0.0], 1)], [(i, [1.0, float(i)], 1) for i in range(8)], [(i, [1.0, 1.0], 1) for i in range(30)], [(1, [1.0, 1.0], 1), (2, [1.0, 0.5], 1)]):
        got = ann.nearest(frame(spark, rows)).orderBy("query_id", "rank").collect()
        want = plain_nearest(rows, d=2)
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(q, j, s) for q in sorted(want) for j, s in want[q]]


def test_recall_of_the_query_on_the_given_table(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    found = QUERIES["op11_balanced_postings"](spark, "/root/testdata/sf0.1").cache()
    assert ann.recall_of(found, vectors) >= 0.9
    assert found.count() == 20 * 100


def test_centroids_are_balanced_and_the_graph_reaches_all():
    rng = np.random.default_rng(4)
    x = np.concatenate([np.zeros((500, 4)), rng.normal(size=(500, 4))]).astype(np.float32)  # half of all rows are equal
    centers = ann.balanced_centroids(x, 32)
    assert centers.shape == (32, 4)
    graph = ann.CentroidGraph(centers, x, links=2, entries=1)
    far = graph.search(x[::50], ratio=1e9)
    assert np.isfinite(far).all()
    assert np.allclose(far, graph._to(x[::50]), atol=1e-3)
    rows, lists = graph.lists_of(x, 0.2, 3)
    assert sorted(set(rows.tolist())) == list(range(len(x))) and np.bincount(rows).max() <= 3
