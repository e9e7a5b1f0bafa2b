"""Hard negatives by exact search in an STR-packed R-tree of integer vectors.

Sort-Tile-Recursive packing has two levels here. Medians of a bounded sample, coordinate by coordinate in the order of variance,
cut the space into tiles; every row goes to its tile. Inside a task the rows of a block of a tile are packed again into
pages and upper nodes. A minimum bounding box gives every coordinate's product with an anchor an interval, and their
sum an interval of inner products. Anchors go only to tiles whose interval can matter, and a best-first queue over a tree's nodes
passes over boxes that lie outside an anchor's score windows or strictly below its k-th best score so far; the scores of a
sample of rows start that bound. Boxes only ever leave out rows that cannot be in the result, so the result is exact.

A tile with many rows is cut into blocks by hash, and so are the anchors that meet a block: no task holds more than
`block_rows` rows and `anchor_rows` anchors or so. Two passes: the positives of each anchor, then the negatives of
each anchor and positive, whose windows follow from the positive's score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ship
from .sampling import bounded_sample
from .vectors import first_of_each, matrix, packed, shape, taking_part

PAGE, FAN = 64, 16
_ANCHORS_AT_ONCE = 256


def tile_cuts(sample: np.ndarray, tiles: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The coordinates to cut, and for each the median of every part that the earlier cuts made."""
    dims = np.argsort(-sample.var(axis=0), kind="stable")[: math.ceil(math.log2(tiles)) if tiles > 1 else 0]
    at, cuts = np.zeros(len(sample), np.int64), []
    for level, d in enumerate(dims):
        cut = np.zeros(1 << level)
        for k in np.unique(at):
            cut[k] = np.ceil(np.median(sample[at == k, d]))
        cuts.append(cut)
        at = 2 * at + (sample[:, d] >= cut[at])
    return dims, cuts


def tile_of(v: np.ndarray, dims: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    at = np.zeros(len(v), np.int64)
    for d, cut in zip(dims, cuts, strict=True):
        at = 2 * at + (v[:, d] >= cut[at])
    return at


def str_order(v: np.ndarray, page: int) -> np.ndarray:
    """An order of the rows whose consecutive pages are the tiles of Sort-Tile-Recursive packing."""
    dims = np.argsort(-v.var(axis=0), kind="stable")[: max(1, math.ceil(math.log2(max(2, len(v) / page))))]

    def tiled(rows: np.ndarray, k: int) -> list[np.ndarray]:
        pages = math.ceil(len(rows) / page)
        if pages <= 1 or k == len(dims):
            return [rows]
        slabs = math.ceil(pages ** (1 / (len(dims) - k)))
        rows = rows[np.argsort(v[rows, dims[k]], kind="stable")]
        step = math.ceil(pages / slabs) * page
        return [x for i in range(0, len(rows), step) for x in tiled(rows[i : i + step], k + 1)]

    return np.concatenate(tiled(np.arange(len(v)), 0))


class Tree:
    """Boxes over pages of PAGE rows, and over FAN boxes each, up to one root."""

    def __init__(self, v: np.ndarray):
        self.order = str_order(v, PAGE)
        v = v[self.order]
        first = np.arange(0, len(v), PAGE)
        lo, hi = np.minimum.reduceat(v, first, axis=0), np.maximum.reduceat(v, first, axis=0)
        self.lo, self.hi = [lo], [hi]
        while len(self.lo[-1]) > 1:
            first = np.arange(0, len(self.lo[-1]), FAN)
            self.lo.append(np.minimum.reduceat(self.lo[-1], first, axis=0))
            self.hi.append(np.maximum.reduceat(self.hi[-1], first, axis=0))
        self.v = v

    def search(self, q: np.ndarray, wanted, visit) -> None:
        """Visit pages best-first. wanted(anchors, low, high): which (anchor, box) intervals matter now; visit(anchors, rows, scores)."""
        top = len(self.lo) - 1
        every = np.arange(len(q))
        low, high = intervals(q, self.lo[top], self.hi[top])
        heap = [(-float(high.max(initial=-np.inf)), top, 0, every, low[:, 0], high[:, 0])]
        while heap:
            _, level, box, who, low, high = heapq.heappop(heap)
            still = wanted(who, low[:, None], high[:, None])[:, 0]
            who = who[still]
            if not len(who):
                continue
            if level == 0:
                rows = slice(box * PAGE, (box + 1) * PAGE)
                visit(who, self.order[rows], q[who] @ self.v[rows].T)
                continue
            below = slice(box * FAN, (box + 1) * FAN)
            low, high = intervals(q[who], self.lo[level - 1][below], self.hi[level - 1][below])
            keep = wanted(who, low, high)
            for j in np.flatnonzero(keep.any(axis=0)):
                m = keep[:, j]
                heapq.heappush(heap, (-float(high[m, j].max()), level - 1, box * FAN + int(j), who[m], low[m, j], high[m, j]))


def intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every anchor with what a box may hold."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k largest values of each row, padded with -inf, in any order."""
    if values.shape[1] < k:
        values = np.pad(values, ((0, 0), (0, k - values.shape[1])), constant_values=-np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k :]


class Positives:
    """The k best rows of the anchor's label, other ids than its own."""

    def __init__(self, ids, labels, floor, k):
        self.ids, self.labels, self.k = ids, labels, k
        self.best = np.full((len(ids), k), -np.inf)
        self.kth = floor.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def wanted(self, who, low, high):
        return high >= self.kth[who, None]

    def visit(self, rows_ids, rows_labels):
        def on(who, rows, scores):
            able = (rows_labels[rows][None] == self.labels[who, None]) & (rows_ids[rows][None] != self.ids[who, None])
            scores = np.where(able, scores, -np.inf)
            a, r = np.nonzero(able & (scores >= self.kth[who, None]))
            if len(a):
                self.found.append((who[a], rows_ids[rows[r]], scores[a, r]))
                self.best[who] = _largest(np.concatenate([self.best[who], scores], axis=1), self.k)
                self.kth[who] = np.maximum(self.kth[who], self.best[who].min(axis=1))

        return on

    def result(self):
        """(anchor, 0, id, score), the k first of each anchor."""
        return _first(self.found, self.kth, self.k)


class Negatives:
    """For each of an anchor's windows of scores, the k best rows of another label."""

    def __init__(self, labels, low, high, floor, k):
        self.labels, self.low, self.high, self.k = labels, low, high, k
        self.kth = np.maximum(floor, low)
        self.best = np.full((*low.shape, k), -np.inf)
        self.found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(low.shape[1])]

    def wanted(self, who, low, high):
        return ((high[:, :, None] >= self.kth[who][:, None]) & (low[:, :, None] <= self.high[who][:, None])).any(axis=2)

    def visit(self, rows_ids, rows_labels):
        def on(who, rows, scores):
            able = rows_labels[rows][None] != self.labels[who, None]
            for p, found in enumerate(self.found):
                inside = able & (scores >= self.kth[who, p, None]) & (scores <= self.high[who, p, None])
                a, r = np.nonzero(inside)
                if len(a):
                    found.append((who[a], rows_ids[rows[r]], scores[a, r]))
                    some = np.unique(a)
                    merged = np.concatenate([self.best[who[some], p], np.where(inside[some], scores[some], -np.inf)], axis=1)
                    self.best[who[some], p] = _largest(merged, self.k)
                    self.kth[who[some], p] = np.maximum(self.kth[who[some], p], self.best[who[some], p].min(axis=1))

        return on

    def result(self):
        parts = [_first(f, self.kth[:, p], self.k) for p, f in enumerate(self.found)]
        slot = np.concatenate([np.full(len(x[0]), p) for p, x in enumerate(parts)])
        return *(np.concatenate(x) for x in zip(*parts, strict=True)), slot


def _first(found, kth, k):
    """The k first rows of each anchor, highest scores first, ties to the smaller id."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
    near = s >= kth[a]
    a, i, s = a[near], i[near], s[near]
    order = np.lexsort((i, -s, a))
    order = order[first_of_each(a[order], k)]
    return a[order], i[order], s[order]


def windows_of(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers n with low * score <= 100 * n <= high * score."""
    return -((-low * scores) // 100), (high * scores) // 100


_PROBE = "tile int, block int, ablock int, anchor_id long, twin long, label long, v binary, slots binary, floors binary"
_HIT = "anchor_id long, twin long, positive_id long, positive_score long, vec_id long, score long"


def _slots(column) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the positives of each anchor, -1 in front of none: rows padded to the longest."""
    rows = [np.frombuffer(b, np.int64).reshape(2, -1) for b in column]
    most = max((r.shape[1] for r in rows), default=0)
    ids, scores, there = np.zeros((len(rows), most), np.int64), np.zeros((len(rows), most), np.int64), np.zeros((len(rows), most), bool)
    for k, r in enumerate(rows):
        ids[k, : r.shape[1]], scores[k, : r.shape[1]], there[k, : r.shape[1]] = *r, True
    return ids, scores, there


def _bounds(scores: np.ndarray, there: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = windows_of(scores, low, high)
    return np.where(there, a, np.inf).astype(float), np.where(there, b, -np.inf).astype(float)


def _route(d, boxes, blocks, ablocks, sample, positives, window):
    """Anchors to the tiles that can matter, with the bound that a sample of rows gives."""
    lo, hi = boxes
    s_ids, s_labels, s_v = sample
    k = positives or window[2]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), _ANCHORS_AT_ONCE):
                g = f.iloc[i : i + _ANCHORS_AT_ONCE]
                q = matrix(g["v"], "<i4", d).astype(float)
                ids, labels = g["anchor_id"].to_numpy(np.int64), g["label"].to_numpy(np.int64)
                scores = q @ s_v.T
                same = s_labels[None] == labels[:, None]
                low, high = intervals(q, lo, hi)
                if positives:
                    other = same & (s_ids[None] != ids[:, None])
                    floors = _largest(np.where(other, scores, -np.inf), k).min(axis=1)[:, None]
                    keep = high >= floors
                else:
                    _, of, there = _slots(g["slots"])
                    a, b = _bounds(of, there, *window[:2])
                    inside = lambda p: np.where(~same & (scores >= a[:, p, None]) & (scores <= b[:, p, None]), scores, -np.inf)  # noqa: E731, B023
                    floors = np.stack([np.maximum(a[:, p], _largest(inside(p), k).min(axis=1)) for p in range(a.shape[1])], axis=1)
                    keep = ((high[:, :, None] >= floors[:, None]) & (low[:, :, None] <= b[:, None])).any(axis=2)
                for first in range(0, len(g), 16):  # few anchors at a time: an anchor may go to every tile
                    a, t = np.nonzero(keep[first : first + 16])
                    a, t = np.repeat(a + first, blocks[t]), np.repeat(t, blocks[t])
                    begins = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]) if len(a) else np.zeros(0, bool)
                    at = np.arange(len(a))
                    out = g.iloc[a].reset_index(drop=True)
                    yield pd.DataFrame({
                        "tile": t, "block": at - np.maximum.accumulate(np.where(begins, at, 0)), "ablock": out["twin"].to_numpy(np.int64) % ablocks,
                        "anchor_id": out["anchor_id"], "twin": out["twin"], "label": out["label"], "v": out["v"], "slots": out["slots"],
                        "floors": [floors[x].tobytes() for x in a],
                    })

    return run


def _search(d, positives, window):
    """What a block of rows has for a block of anchors."""

    def run(rows: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(probes):
            tree = Tree(matrix(rows["v"], "<i4", d).astype(float))
            r_ids, r_labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
            for i in range(0, len(probes), _ANCHORS_AT_ONCE):
                g = probes.iloc[i : i + _ANCHORS_AT_ONCE]
                ids, labels, twins = (g[c].to_numpy(np.int64) for c in ("anchor_id", "label", "twin"))
                if positives:
                    found = Positives(ids, labels, matrix(g["floors"], "<f8", 1)[:, 0].copy(), positives)
                else:
                    of_ids, of, there = _slots(g["slots"])
                    floors = np.full(of.shape, np.inf)
                    for k, b in enumerate(g["floors"]):  # as many as the longest of another batch; the rest is padding
                        x = np.frombuffer(b, np.float64)[: of.shape[1]]
                        floors[k, : len(x)] = x
                    found = Negatives(labels, *_bounds(of, there, *window[:2]), floors, window[2])
                tree.search(matrix(g["v"], "<i4", d).astype(float), found.wanted, found.visit(r_ids, r_labels))
                a, i_, s, *slot = found.result()
                p = (of_ids[a, slot[0]], of[a, slot[0]]) if slot else (0, 0)
                out.append(pd.DataFrame({"anchor_id": ids[a], "twin": twins[a], "positive_id": p[0], "positive_score": p[1], "vec_id": i_, "score": s.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: pd.array([], "int64") for c in _HIT.split(", ")})

    return run


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 50, n_positives: int = 5, n_negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256, sample_rows: int = 8_192, tile_rows: int = 2_048, most_tiles: int = 1_024, block_rows: int = 2_048, anchor_rows: int = 4_096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, positive and negative.

    Components become floor(scale * x); scores are their whole-number inner products. Anchors are rows whose id is a multiple of
    `anchor_every`. An anchor's positives are its n_positives best other rows of the same label; for each, the n_negatives best rows
    of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are given. Ties go to the smaller id.

    Rows with a null id, label or vector, with a null or non-finite component, or of another length than most take no
    part. Repeated rows count once; different rows of an id count each, as anchors too, but are no positives of each other.
    Where few rows fit, all of them are given, and none for an anchor without positives. An empty table gives no rows. The sample
    only places cuts and starts bounds. Scores must stay below 2**53 (a ValueError says so otherwise).
    """
    spark = vectors.sparkSession
    ship(spark)
    every = taking_part(vectors, id_col, vector_col, F.col(label_col).cast("long").alias("label")).where("label is not null")
    every = every.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)))
    n, d = shape(every)
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not d:
        return spark.createDataFrame([], out_schema)
    every = every.where(F.size("v") == d)
    if (every.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0) ** 2 * d >= 2**53:
        raise ValueError("components are too large for exact scores")
    rows = materialize(every.distinct(), "hard-rows")

    sample = bounded_sample(rows, "vec_id", sample_rows).toPandas()  # sample_rows at most
    s_v = np.array(sample["v"].tolist(), float).reshape(-1, d)
    tiles = min(most_tiles, math.ceil(n / tile_rows))
    dims, cuts = tile_cuts(s_v, tiles)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = np.array(f["v"].tolist(), np.int64).reshape(-1, d)
            yield pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "tile": tile_of(v, dims, cuts), "v": packed(v, "<i4")})

    placed = materialize(rows.mapInPandas(place, "vec_id long, label long, tile int, v binary"), "hard-placed")
    discard(rows)

    def corners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi, count = {}, {}, {}
        for f in frames:
            v = matrix(f["v"], "<i4", d)
            for t, at in f.groupby("tile").indices.items():
                a, b = v[at].min(axis=0), v[at].max(axis=0)
                lo[t], hi[t], count[t] = np.minimum(lo.get(t, a), a), np.maximum(hi.get(t, b), b), count.get(t, 0) + len(at)
        for t in lo:
            yield pd.DataFrame({"tile": t, "dim": range(d), "lo": lo[t], "hi": hi[t], "n": count[t]})

    summed = placed.select("tile", "v").mapInPandas(corners, "tile int, dim int, lo long, hi long, n long").groupBy("tile", "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    box = summed.toPandas()  # tiles times coordinates
    n_tiles = int(box["tile"].max()) + 1
    lo, hi, count = np.full((n_tiles, d), np.inf), np.full((n_tiles, d), -np.inf), np.zeros(n_tiles, np.int64)
    at = box["tile"].to_numpy(), box["dim"].to_numpy()
    lo[at], hi[at], count[at[0]] = box["lo"], box["hi"], box["n"]
    full = np.flatnonzero(count)  # tiles are numbered anew without the empty ones
    blocks = -(-count[full] // block_rows)

    anchors = placed.where(F.pmod("vec_id", F.lit(anchor_every)) == 0)
    ablocks = max(1, math.ceil(anchors.count() / anchor_rows))
    number = spark.createDataFrame([(int(t), k, int(b)) for k, (t, b) in enumerate(zip(full, blocks, strict=True))], "tile int, k int, blocks int")
    dealt = placed.join(F.broadcast(number), "tile").select(
        F.col("k").alias("tile"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(ablocks - 1))).alias("ablock"), "vec_id", "label", "v"
    )
    anchors = anchors.select(F.col("vec_id").alias("anchor_id"), F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(1 << 62)).alias("twin"), "label", "v")
    bound = (sample["vec_id"].to_numpy(np.int64), sample["label"].to_numpy(np.int64), s_v)
    keys = ["tile", "block", "ablock"]

    def searched(probes: DataFrame, positives: int, window) -> DataFrame:
        probes = probes.mapInPandas(_route(d, (lo[full], hi[full]), blocks, ablocks, bound, positives, window), _PROBE)
        return dealt.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(_search(d, positives, window), _HIT)

    def first(hits: DataFrame, k: int, *of: str) -> DataFrame:
        order = Window.partitionBy(*of).orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    empty = F.lit(b"")
    best = first(searched(anchors.withColumns({"slots": empty, "floors": empty}), n_positives, None), n_positives, "anchor_id", "twin")
    best = materialize(best.select("anchor_id", "twin", F.col("vec_id").alias("positive_id"), "score"), "hard-positives")

    def bind(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            slots = [np.array([[r["positive_id"] for r in x], [r["score"] for r in x]], np.int64).tobytes() for x in f["slots"]]
            yield f[["anchor_id", "twin", "label", "v"]].assign(slots=slots)

    lists = best.groupBy("anchor_id", "twin").agg(F.sort_array(F.collect_set(F.struct("score", "positive_id"))).alias("slots"))  # n_positives at most
    asked = anchors.join(lists, ["anchor_id", "twin"]).mapInPandas(bind, "anchor_id long, twin long, label long, v binary, slots binary")
    hits = first(searched(asked, 0, (low, high, n_negatives)), n_negatives, "anchor_id", "twin", "positive_id", "positive_score")
    return hits.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
