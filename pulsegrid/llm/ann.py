"""Approximate nearest neighbours by inner product: balanced posting lists behind an in-memory centroid graph.

Inner products become distances: vectors get one more coordinate so that all have the same length, queries a zero there, and the
nearest point is then the one with the largest product. Centroids come from a bounded sample by splitting it into
halves of equal size, so that lists are balanced; every row of the table is then indexed. A row goes to its nearest list and, if it lies near a
boundary, to up to `replicas` lists whose centroids are almost as near and not nearer to one another than to the row.

The centroids (`most_lists` at most) are nodes of a graph with links to their nearest ones; a search starts at a few nodes spread
over the whole and follows links while nodes lie within a distance ratio of the nearest so far. The same ratio prunes: a query
reads the lists whose centroid is at most so many times as far as the nearest one. The ratio is measured: for a few queries the
exact neighbours among all rows are found in one pass, and the ratio is the least at which `recall` of them are in
selected lists. So it follows the data: where vectors have no structure, many lists are read.

Lists are cut into blocks by hash, and the queries of a list too, so a task holds a block of rows and a block of queries, whatever
is hot. A query starts with a bound for its k-th neighbour, from a sample of the rows in the lists that it reads; blocks return only what reaches it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ship
from .sampling import bounded_sample
from .vectors import first_of_each, matrix, packed, shape, taking_part

_ROWS_AT_ONCE = 512
_PAIRS_AT_ONCE = 1 << 17


def balanced_centroids(x: np.ndarray, n: int) -> np.ndarray:
    """n (a power of two) means of groups of equal size: each group is split at the median along the line between two means."""
    parts = [np.arange(len(x))]
    while len(parts) < n:
        halves = []
        for p in parts:
            a, b = x[p[0]], x[p[np.argmax(((x[p] - x[p[0]]) ** 2).sum(axis=1))]]
            for _ in range(8):
                side = x[p] @ (b - a)
                order = np.argsort(side, kind="stable")
                left, right = p[order[: len(p) // 2]], p[order[len(p) // 2 :]]
                a, b = x[left].mean(axis=0), x[right].mean(axis=0)
            halves += [left, right]
        parts = halves
    return np.array([x[p].mean(axis=0) for p in parts], np.float32)


class CentroidGraph:
    """Centroids linked to their nearest ones, those that count them among theirs, and the next in the order of splitting (so all are connected)."""

    def __init__(self, centers: np.ndarray, points: np.ndarray, links: int = 16, entries: int = 32):
        n = len(centers)
        self.centers, self.square = centers, (centers**2).sum(axis=1)
        # ratios are of this distance at least: a query on top of a centroid (of copies) is near others too
        self.unit = float(self._to(points[:2048]).min(axis=1).mean())
        near = [np.argsort(self._to(centers[i : i + 1])[0], kind="stable")[1 : links + 1] for i in range(n)]
        linked: list[set[int]] = [set(x.tolist()) for x in near]
        for i, x in enumerate(near):
            for j in x.tolist():
                if len(linked[j]) < 2 * links:
                    linked[j].add(i)
        for i in range(n):
            linked[i] |= {(i + 1) % n, (i - 1) % n}
        most = max(map(len, linked))
        self.links = np.array([sorted(x) + [i] * (most - len(x)) for i, x in enumerate(linked)])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, entries)).astype(int))

    def _to(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + self.square - 2 * (x @ self.centers.T), 0))

    def reach(self, nearest: np.ndarray, ratio: float) -> np.ndarray:
        return np.maximum(nearest, self.unit) * (1 + ratio)

    def search(self, x: np.ndarray, ratio: float, least: int = 8) -> np.ndarray:
        """Distances to the centroids that the search met, infinite for the others: it goes on from all within reach of the nearest, and from the `least` nearest."""
        n, k = len(x), len(self.centers)
        square = (x**2).sum(axis=1)
        far = np.full((n, k), np.inf, np.float32)
        done = np.zeros((n, k), bool)
        new = np.zeros((n, k), bool)
        new[:, self.entries] = True
        while True:
            rows, nodes = np.nonzero(new)
            for i in range(0, len(rows), _PAIRS_AT_ONCE):
                r, c = rows[i : i + _PAIRS_AT_ONCE], nodes[i : i + _PAIRS_AT_ONCE]
                d = square[r] + self.square[c] - 2 * np.einsum("ij,ij->i", x[r], self.centers[c])
                far[r, c] = np.sqrt(np.maximum(d, 0))
            within = np.maximum(self.reach(far.min(axis=1), ratio), np.partition(far, min(least, k) - 1, axis=1)[:, min(least, k) - 1])
            rows, nodes = np.nonzero((far <= within[:, None]) & ~done & np.isfinite(far))
            if not len(rows):
                return far
            done[rows, nodes] = True
            new = np.zeros((n, k), bool)
            new[rows[:, None], self.links[nodes]] = True
            new &= np.isinf(far)

    def lists_of(self, x: np.ndarray, ratio: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every row, the nearest list first: others within the ratio that are not nearer to a chosen one than to the row."""
        far = self.search(x, ratio)
        m = min(2 * replicas, len(self.centers))
        order = np.argpartition(far, m - 1, axis=1)[:, :m]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(far, order, 1), axis=1, kind="stable"), 1)
        d = np.take_along_axis(far, order, 1)
        chosen = np.zeros(order.shape, bool)
        chosen[:, 0] = True
        for j in range(1, m):
            between = ((self.centers[order[:, j], None] - self.centers[order[:, :j]]) ** 2).sum(axis=2)
            crowded = (chosen[:, :j] & (between < d[:, j, None] ** 2)).any(axis=1)
            chosen[:, j] = (d[:, j] <= d[:, 0] * (1 + ratio)) & ~crowded & (chosen[:, :j].sum(axis=1) < replicas)
        rows, at = np.nonzero(chosen)
        return rows, order[rows, at]


def _points(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors on a sphere: scaled by the longest, with what is missing in one more coordinate."""
    v = v.astype(float) / longest
    return np.concatenate([v, np.sqrt(np.maximum(1 - (v**2).sum(axis=1), 0))[:, None]], axis=1).astype(np.float32)


def _askers(v: np.ndarray) -> np.ndarray:
    """Queries on that sphere: their length does not matter, the added coordinate is 0."""
    v = v.astype(float)
    return np.concatenate([v / np.sqrt((v**2).sum(axis=1))[:, None], np.zeros((len(v), 1))], axis=1).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows in double precision, summed from the first component to the last: equal vectors get equal scores everywhere."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j].astype(float) * b[:, j].astype(float)
    return out


def best_pairs(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): each query's k best rows of other ids with a score of its floor at least, ties to the smaller id."""
    out = []
    v8 = v.astype(float)
    for i in range(0, len(q), 256):
        q8 = q[i : i + 256].astype(float)
        scores = np.where(ids[None] == q_ids[i : i + 256, None], -np.inf, q8 @ v8.T)
        slack = 1e-9 * np.sqrt((q8**2).sum(axis=1) * (v8**2).sum(axis=1).max(initial=0))  # of the order of summing
        near = floor[i : i + 256] - slack
        if len(v) > k:
            near = np.maximum(near, np.partition(scores, len(v) - k, axis=1)[:, len(v) - k] - slack)
        a, r = np.nonzero((scores >= near[:, None]) & np.isfinite(scores))
        s = np.concatenate([np.zeros(0), *(exact_scores(q8[a[j : j + _PAIRS_AT_ONCE]], v8[r[j : j + _PAIRS_AT_ONCE]]) for j in range(0, len(a), _PAIRS_AT_ONCE))])
        order = np.lexsort((ids[r], -s, a))
        order = order[first_of_each(a[order], k)]
        out.append((a[order] + i, r[order], s[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


_HIT = "query_id long, twin long, vec_id long, score double"


def _exact(q_ids, q_twins, q, d, dtype, k):
    """The k best rows of a task for a few queries, with the lists that hold them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for f in frames:
            for i in range(0, len(f), 4 * _ROWS_AT_ONCE):
                g = f.iloc[i : i + 4 * _ROWS_AT_ONCE]
                a, r, s = best_pairs(q, q_ids, np.full(len(q), -np.inf), matrix(g["v"], dtype, d), g["vec_id"].to_numpy(np.int64), k)
                new = pd.DataFrame({"query_id": q_ids[a], "twin": q_twins[a], "vec_id": g["vec_id"].to_numpy()[r], "score": s, "lists": g["lists"].to_numpy()[r]})
                kept = new if kept is None else pd.concat([kept, new])
                kept = kept.sort_values(["query_id", "twin", "score", "vec_id"], ascending=[True, True, False, True]).groupby(["query_id", "twin"]).head(k)
        if kept is not None:
            yield kept

    return run


def measured_ratio(graph: CentroidGraph, askers: np.ndarray, needed: list[tuple[int, list[int]]], recall: float) -> float:
    """The least distance ratio at which that share of the (query, lists that hold the neighbour) can be found."""
    if not needed:
        return 0.0
    far = graph._to(askers)
    unit = np.maximum(graph.reach(far.min(axis=1), 0.0), 1e-9)
    ratios = np.sort([far[a, lists].min() / unit[a] - 1 for a, lists in needed])
    return max(float(ratios[math.ceil(recall * len(ratios)) - 1]), 0.0) + 1e-6


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20, sample_rows: int = 16_384, bound_rows: int = 4_096, list_rows: int = 128,
    most_lists: int = 2_048, replicas: int = 4, boundary: float = 0.1, recall: float = 0.95, measured: int = 128, block_rows: int = 2_048, query_rows: int = 4_096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first, ties to the smaller vec_id.

    Queries are rows whose id is a multiple of `query_every`, candidates all rows but those of the query's id. score is the inner product
    in double precision. Every query gets k rows, or all candidates if they are fewer.

    Rows with a null id, a null or zero vector, null or non-finite components, or a vector of another length than most take no part.
    Repeated rows count once; different rows of an id are candidates each and searched each (ranks then start anew). An empty
    table gives no rows. Samples: `sample_rows` rows place centroids,
    `measured` queries set the distance ratio, `bound_rows` rows start bounds; every row is indexed.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    every = taking_part(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    n, d = shape(every)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialize(every.where(F.size("v") == d).distinct(), "ann-rows")
    longest = math.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    if not math.isfinite(longest):
        raise ValueError("vectors are too long for double precision")

    sample = bounded_sample(rows, "vec_id", sample_rows).toPandas()  # sample_rows at most
    s_v = np.array(sample["v"].tolist(), float).reshape(-1, d)
    n_lists = 1 << max(0, math.ceil(math.log2(min(most_lists, max(1, n / list_rows), max(1, len(s_v) / 8)))))
    points = _points(s_v, longest)
    graph = CentroidGraph(balanced_centroids(points, n_lists), points)
    del points, s_v, sample

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), _ROWS_AT_ONCE):
                g = f.iloc[i : i + _ROWS_AT_ONCE]
                v = np.array(g["v"].tolist(), float).reshape(-1, d)
                at, lists = graph.lists_of(_points(v, longest), boundary, replicas)
                yield pd.DataFrame({"vec_id": g["vec_id"], "lists": np.split(lists, np.flatnonzero(np.diff(at)) + 1), "v": packed(v, dtype)})

    posted = materialize(rows.mapInPandas(index, "vec_id long, lists array<int>, v binary"), "ann-postings")
    discard(rows)
    count = posted.select(F.posexplode("lists").alias("place", "list")).groupBy("list").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 0).alias("first")).toPandas()  # a row per list
    size, first = np.zeros((2, len(graph.centers)), np.int64)
    size[count["list"]], first[count["list"]] = count["n"], count["first"]

    asking = posted.where(F.pmod("vec_id", F.lit(query_every)) == 0).select(F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 62)).alias("twin"), "v")
    few = bounded_sample(asking, "query_id", measured).toPandas()
    f_ids, f_twins, f_v = few["query_id"].to_numpy(np.int64), few["twin"].to_numpy(np.int64), matrix(few["v"], dtype, d)
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    if len(few):
        true = posted.mapInPandas(_exact(f_ids, f_twins, f_v, d, dtype, k), f"{_HIT}, lists array<int>")
        true = true.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect()  # measured * k at most
        at = {key: i for i, key in enumerate(zip(f_ids.tolist(), f_twins.tolist(), strict=True))}
        ratio = measured_ratio(graph, _askers(f_v), [(at[r["query_id"], r["twin"]], r["lists"]) for r in true], recall)
    else:
        ratio = 0.0

    # rows whose list a query reads are found for sure: the k-th best of them bounds its k-th neighbour
    known = bounded_sample(posted.select("vec_id", F.element_at("lists", 1).alias("list"), "v"), "vec_id", bound_rows).toPandas()
    b_ids, b_list, b_v = known["vec_id"].to_numpy(np.int64), known["list"].to_numpy(), matrix(known["v"], dtype, d).astype(float)
    blocks = np.maximum(-(-size // block_rows), 1)
    qblocks = max(1, math.ceil(asking.count() / query_rows))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 64):
                g = f.iloc[i : i + 64]
                q = matrix(g["v"], dtype, d)
                far = graph.search(_askers(q), ratio)
                near = np.argsort(far, axis=1, kind="stable")
                sorted_far = np.take_along_axis(far, near, 1)
                held = np.cumsum(first[near], axis=1) - first[near]  # rows in the lists before
                take = (sorted_far <= graph.reach(sorted_far[:, :1], ratio)) | (held <= 2 * k)
                take &= size[near] > 0
                a, t = np.nonzero(take)
                t = near[a, t]
                read = np.zeros(take.shape, bool)
                read[a, t] = True
                scores = np.where(read[:, b_list] & (b_ids[None] != g["query_id"].to_numpy(np.int64)[:, None]), q.astype(float) @ b_v.T, -np.inf)
                floor = np.partition(scores, len(b_v) - k, axis=1)[:, len(b_v) - k] if len(b_v) > k else np.full(len(g), -np.inf)
                a, t = np.repeat(a, blocks[t]), np.repeat(t, blocks[t])
                begins = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]) if len(a) else np.zeros(0, bool)
                step = np.arange(len(a))
                out = g.iloc[a].reset_index(drop=True)
                yield out.assign(list=t, block=step - np.maximum.accumulate(np.where(begins, step, 0)), qblock=out["twin"] % qblocks, floor=floor[a])

    def match(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({"query_id": pd.array([], "int64"), "twin": pd.array([], "int64"), "vec_id": pd.array([], "int64"), "score": []})
        ids, q_ids = held["vec_id"].to_numpy(np.int64), asked["query_id"].to_numpy(np.int64)
        a, r, s = best_pairs(matrix(asked["v"], dtype, d), q_ids, asked["floor"].to_numpy(), matrix(held["v"], dtype, d), ids, k)
        return pd.DataFrame({"query_id": q_ids[a], "twin": asked["twin"].to_numpy(np.int64)[a], "vec_id": ids[r], "score": s})

    number = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "list int, blocks int")
    lists = posted.select("vec_id", "v", F.explode("lists").alias("list")).join(F.broadcast(number), "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qblock"), "vec_id", "v"
    )
    probes = asking.mapInPandas(probe, "query_id long, twin long, v binary, list int, block int, qblock int, floor double")
    keys = ["list", "block", "qblock"]
    hits = lists.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(match, _HIT)
    hits = hits.repartition("query_id", "twin").distinct()  # a row of several lists is found in each
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall_of(found: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20) -> float:
    """The share of all queries' true k nearest that are in found: every query against all rows, in blocks. 1 where there are none.

    A check by brute force: it holds the queries of the table in every task, so it is for tables and query sets of moderate size.
    """
    every = taking_part(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    n, d = shape(every)
    if not n:
        return 1.0
    rows = every.where(F.size("v") == d).distinct()
    ask = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).toPandas()
    q_ids, q = ask["vec_id"].to_numpy(np.int64), np.array(ask["v"].tolist(), float).reshape(-1, d)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v, ids = np.array(f["v"].tolist(), float).reshape(-1, d), f["vec_id"].to_numpy(np.int64)
            a, r, s = best_pairs(q, q_ids, np.full(len(q), -np.inf), v, ids, k)
            yield pd.DataFrame({"query_id": q_ids[a], "vec_id": ids[r], "score": s})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = rows.mapInPandas(run, "query_id long, vec_id long, score double").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    both = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return both["hits"] / both["n"] if both["n"] else 1.0
