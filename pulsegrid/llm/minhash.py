"""Near-duplicate classes by HyperMinHash sketches, banding, and exact verification.

Sketch: shingle hashes fall into buckets by their top bits; a bucket's register keeps, of its smallest
remaining hash, the number of leading zeros and the next mantissa bits (16 bits in all).

Jobs:
1. Sketch every text. Equal shingle sets collapse into one representative (combined in map tasks), so
   thousands of copies cost one row from here on.
2. Bands of compressed registers are hashed to keys. Each band key has a star: its smallest id
   against every other. The pairs are few (at most one per row and band), their Jaccard similarity is
   estimated from the registers with the collision correction, and those that may reach the threshold
   within five standard errors are confirmed on full shingle sets.
3. Links that no star shows can only join different classes inside one band key. Keys whose rows
   already are one class are settled. In the others, registers are compared in cells of bounded size: rows
   outside the hub's class meet each other and the hub's class, which does not meet itself. Rows of different
   classes whose registers leave a link possible are tied into clusters by forests, never by all pairs. Clusters
   are then compared on full sets, again in cells of bounded size, and return a forest of links between classes.
4. Classes are connected components of the confirmed links, found by joins.

Recall: a pair at the threshold of 0.8 misses all 32 bands of four registers with probability
(1 - 0.8**4)**32, about 5e-8; confirmed links are exact up to 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, maybe_among, ship
from .components import connected_components
from .hashing import chunks, shingle_sets

BUCKET_BITS = 7  # 128 registers
MANTISSA_BITS = 10
BAND_ROWS = 4
EMPTY = 0xFFFF
BLOCK = 512  # rows of one side of a cell, on average


def registers(shingles: np.ndarray, bits: int = BUCKET_BITS, mantissa: int = MANTISSA_BITS) -> np.ndarray:
    """One uint16 per bucket: (63 - leading zeros) above the mantissa bits, EMPTY for no shingle.

    With this order a smaller register is a smaller hash, so the register of a union is the minimum.
    """
    out = np.full(1 << bits, EMPTY, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - bits)).astype(np.int64)
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]])  # sorted: the first is the smallest
        rest = (shingles[first] << np.uint64(bits)) | np.uint64(1)
        top = np.minimum(np.floor(np.log2(rest.astype(np.float64))), 63).astype(np.int64)
        top = np.where((rest >> top.astype(np.uint64)) == 0, top - 1, top)  # the float was rounded up
        below = np.where(top >= mantissa, rest >> np.maximum(top - mantissa, 0).astype(np.uint64), rest << np.maximum(mantissa - top, 0).astype(np.uint64))
        code = (top.astype(np.uint64) << np.uint64(mantissa)) | (below & np.uint64((1 << mantissa) - 1))
        out[bucket[first]] = np.minimum(code, EMPTY - 1).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and their standard errors at 0.8."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    # two unrelated minima of about n shingles over k buckets agree in leading zeros and mantissa with
    # probability about 2**-mantissa / 3 once buckets are filled; sparse buckets collide less
    chance = used * (2.0**-MANTISSA_BITS / 3.0) * np.minimum(1.0, np.minimum(n_a, n_b) / a.shape[-1])
    n = np.maximum(used, 1)
    return np.clip((same - chance) / np.maximum(n - chance, 1e-9), 0.0, 1.0), np.sqrt(0.16 / n)


def _as_registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u2").reshape(len(column), -1)


def _sketch(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, texts = f["doc_id"].tolist(), f["text"].tolist()
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], width)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(ids[a:b], "Int64"),
                        "n_shingles": [len(s) for s in sets],
                        "print": [hashlib.sha256(s.tobytes()).digest() for s in sets],  # sets are sorted: equal sets, equal digests
                        "sketch": [registers(s).astype(">u2").tobytes() for s in sets],
                    }
                )

    return run


SKETCH_SCHEMA = "doc_id long, n_shingles long, print binary, sketch binary"


def _may_link(threshold: int):
    @F.pandas_udf("boolean")
    def may_link(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        low, high = np.minimum(na, nb).to_numpy(), np.maximum(na, nb).to_numpy()
        j, error = estimate(_as_registers(sa), _as_registers(sb), na.to_numpy(), nb.to_numpy())
        return pd.Series((j >= threshold / 100 - 5 * error) & (100 * low >= threshold * high))

    return may_link


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(width: int, threshold: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = f[["src", "dst", "src_text", "dst_text"]].values.tolist()
            for a, b in chunks([x[2] + x[3] for x in rows]):
                part = rows[a:b]
                texts = list(dict.fromkeys(t for x in part for t in x[2:]))
                sets = dict(zip(texts, shingle_sets(texts, width), strict=True))
                out = []
                for s, d, s_text, d_text in part:
                    x, y = sets[s_text], sets[d_text]
                    both = _shared(x, y)
                    if 100 * both >= threshold * (len(x) + len(y) - both):
                        out.append((s, d))
                yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return run


def _whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Batches of rows that arrive sorted by key, cut so that no group is split, with each group's row range."""
    held: list[pd.DataFrame] = []

    def ranges(f: pd.DataFrame) -> list[tuple[int, int]]:
        k = f[key].to_numpy()
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(f)]
        return list(zip(edges[:-1], edges[1:], strict=True))

    for f in frames:
        if not len(f):
            continue
        if held and held[-1][key].iloc[-1] == f[key].iloc[0] == f[key].iloc[-1]:
            held.append(f)  # one group goes on and on
            continue
        whole = pd.concat([*held, f], ignore_index=True)
        cut = ranges(whole)
        held = [whole.iloc[cut[-1][0] :]]
        if len(cut) > 1:
            yield whole.iloc[: cut[-1][0]], cut[:-1]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, ranges(whole)


class _Forest:
    """Edges that join what was apart, over all that one task has seen since the last flush."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        parent = self.parent
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, x: int, y: int, edge: tuple[int, int] | None = None) -> None:
        a, b = self._root(x), self._root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append(edge or (x, y))

    def flush(self, at_least: int = 0) -> Iterator[pd.DataFrame]:
        if len(self.edges) >= at_least:
            yield pd.DataFrame(self.edges, columns=["src", "dst"], dtype="int64")
            self.parent.clear()
            self.edges = []


def _open_pairs(threshold: int):
    """In a cell of registers, rows of different classes that may be linked, as a forest.

    A cell with two sides compares one with the other, a cell with one side its rows with each other.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = _Forest()
        for whole, cut in _whole_groups(frames, "cell"):
            ids, side, component, n = (whole[c].to_numpy() for c in ("doc_id", "side", "component", "n_shingles"))
            sketch = _as_registers(whole["sketch"])
            for a, b in cut:
                if (component[a:b] == component[a]).all():
                    continue
                at, sided = np.arange(a, b), side[a:b]
                few, many = sorted((at[sided == 0], at[sided == 1]), key=len)
                for i, p in enumerate(few if len(few) else many):
                    q = many if len(few) else many[i + 1 :]
                    q = q[(component[q] != component[p]) & (100 * np.minimum(n[q], n[p]) >= threshold * np.maximum(n[q], n[p]))]
                    if len(q):
                        j, error = estimate(sketch[q], sketch[p][None, :], n[q], n[p : p + 1])
                        for r in q[j >= threshold / 100 - 5 * error].tolist():
                            forest.join(int(ids[p]), int(ids[r]))
            yield from forest.flush(100_000)
        yield from forest.flush()

    return run


def _blocks(width: int, threshold: int):
    """Exact links between different classes in one block comparison, as a forest over classes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = _Forest()
        for whole, cut in _whole_groups(frames, "cell"):
            for first, last in cut:
                g = whole.iloc[first:last]
                component = g["component"].to_numpy()
                if (component == component[0]).all():
                    continue
                ids, side = g["doc_id"].to_numpy(), g["side"].to_numpy()
                sets = shingle_sets(g["text"].tolist(), width)
                size = np.array([len(s) for s in sets])
                values = np.concatenate(sets)
                order = np.argsort(values, kind="stable")
                values, owner = values[order], np.repeat(np.arange(len(sets)), size)[order]
                two_sided = len(set(side.tolist())) > 1
                for i, s in enumerate(sets):
                    if two_sided and side[i] == 1:
                        continue
                    a, b = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                    n = b - a
                    at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(sets))
                    linked = (100 * both >= threshold * (size + len(s) - both)) & (component != component[i])
                    linked &= (side == 1) if two_sided else (np.arange(len(sets)) > i)
                    for k in np.flatnonzero(linked).tolist():
                        forest.join(int(component[i]), int(component[k]), (int(ids[i]), int(ids[k])))
            yield from forest.flush(100_000)
        yield from forest.flush()

    return run


LINKS = "src long, dst long"


def _cells(key: str, own: Column, n_own: Column, n_other: Column) -> list[Column]:
    """Columns cell and side of rows that are to be compared within `key` in blocks of about BLOCK rows.

    Own rows fill the first blocks and are compared with those of others only; others are compared with all. A key
    with few rows is one cell.
    """
    one = n_own + n_other <= BLOCK
    first = F.when(one, 0).otherwise(F.ceil(n_own / BLOCK)).cast("int")  # blocks of own rows
    rest = F.when(one, 1).otherwise(F.ceil(n_other / BLOCK)).cast("int")
    at = F.pmod(F.xxhash64("doc_id"), F.when(own & ~one, first).otherwise(rest)).cast("int")
    block = F.when(own & ~one, at).otherwise(at + first)
    other = F.explode(F.sequence(F.when(own, first).otherwise(F.lit(0)), first + rest - 1))
    return [key, "doc_id", "component", block.alias("_block"), other.alias("_other")]


def _celled(rows: DataFrame, key: str, *keep: str) -> DataFrame:
    return rows.select(
        *keep, F.xxhash64(key, F.least("_block", "_other"), F.greatest("_block", "_other")).alias("cell"), (F.col("_block") > F.col("_other")).cast("int").alias("side")
    )


def _texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct rows (doc_id, text) of unique ids.

    An inner join, since a semi join would be pushed below the bitmap and move all texts. Dealt by id and text, so that a
    later join by id has a shuffle of its own, which adaptive execution can split where one id has many partners.
    """
    return maybe_among(rows, ids, "doc_id").join(ids, "doc_id").repartition("doc_id", "text").distinct()


def near_dup_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two texts are linked when 100 * |intersection| >= threshold * |union| of their distinct `width`-word
    shingles; a text with fewer words is one shingle; a null or wordless text has none and is linked with
    nothing. component_id is the smallest id reachable over links, kept tells doc_id = component_id.
    Rows with a null id are given back with their n_shingles, a null component_id and kept = true.
    Repeated rows are copies of each other; an id with several texts stands for each of them. An empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(rows.mapInPandas(_sketch(width), SKETCH_SCHEMA), "near-sketches")

    # equal sets: one representative each
    reps = materialize(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("print", "n_shingles", "sketch").agg(F.min("doc_id").alias("rep")),
        "near-reps",
    )
    bands = (1 << BUCKET_BITS) // BAND_ROWS
    wide = BAND_ROWS * 2
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("i"), F.substring("sketch", i * wide + 1, F.lit(wide)).alias("part")))
    banded = (
        reps.select(F.col("rep").alias("doc_id"), F.explode(cut).alias("x"))
        .where(F.col("x.part") != F.lit(b"\xff" * wide))
        .select("doc_id", F.xxhash64("x.i", "x.part").alias("band"))
    )
    stars = materialize(banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("rows")).where("rows > 1"), "near-stars")
    members = materialize(banded.join(stars, "band").select("band", "doc_id", "hub", "rows"), "near-members")

    # star pairs that may reach the threshold, confirmed on full sets
    sketches = reps.select(F.col("rep").alias("id"), "n_shingles", "sketch")
    pairs = members.where("doc_id <> hub").select(F.col("hub").alias("src"), F.col("doc_id").alias("dst")).distinct()
    scored = (
        pairs.join(sketches.toDF("src", "na", "sa"), "src")
        .join(sketches.toDF("dst", "nb", "sb"), "dst")
        .where(_may_link(threshold)("sa", "sb", "na", "nb"))
        .select("src", "dst")
    )
    scored = materialize(scored.distinct(), "near-scored")
    ids = materialize(scored.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct(), "near-ids")
    texts = _texts_of(rows, ids)
    confirmed = (
        scored.join(texts.toDF("dst", "dst_text"), "dst")
        .join(texts.toDF("src", "src_text"), "src")
        .select("src", "dst", "src_text", "dst_text")
        .mapInPandas(_linked(width, threshold), LINKS)
    )
    confirmed = materialize(confirmed, "near-confirmed")
    first = connected_components(confirmed)
    class_of = first.withColumnRenamed("id", "doc_id")

    # band keys that still hold several classes: compare registers
    labelled = (
        members.where("rows > 2").join(class_of, "doc_id", "left").select("band", "doc_id", "hub", F.coalesce("component", "doc_id").alias("component"))
    )
    of_hub = F.max(F.when(F.col("doc_id") == F.col("hub"), F.col("component")))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), of_hub.alias("hub_class"))
    mixed = materialize(mixed.where("low <> high").select("band", "hub_class"), "near-mixed")
    own = F.col("component") == F.col("hub_class")
    unsettled = materialize(labelled.where("doc_id <> hub").join(mixed, "band").select("band", "doc_id", "component", own.alias("own")), "near-unsettled")
    sizes = unsettled.groupBy("band").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_other")).where("n_other > 0 and n_own + n_other > 1")
    band_sizes = materialize(sizes, "near-sizes")
    open_rows = unsettled.join(band_sizes, "band").select(*_cells("band", F.col("own"), F.col("n_own"), F.col("n_other")))
    ties = (
        _celled(open_rows, "band", "doc_id", "component")
        .join(sketches.withColumnRenamed("id", "doc_id"), "doc_id")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInPandas(_open_pairs(threshold), LINKS)
    )

    # clusters of rows that registers leave open: compare full sets
    clusters = connected_components(ties).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
    clustered = clusters.join(class_of, "doc_id", "left").select("doc_id", "cluster", F.coalesce("component", "doc_id").alias("component"))
    clustered = materialize(clustered, "near-clustered")
    sizes = clustered.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows"))
    sizes = materialize(sizes.where("low <> high").select("cluster", "rows"), "near-cluster-sizes")
    cells = clustered.join(sizes, "cluster").select(*_cells("cluster", F.lit(False), F.lit(0), F.col("rows")))
    cells = materialize(_celled(cells, "cluster", "doc_id", "component"), "near-cells")
    # cells of one class alone need no texts
    open_cells = cells.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("cell")
    cells = materialize(cells.join(open_cells, "cell", "left_semi"), "near-open-cells")
    cell_texts = _texts_of(rows, materialize(cells.select("doc_id").distinct(), "near-cell-ids"))
    rest = cells.join(cell_texts, "doc_id").repartition("cell").sortWithinPartitions("cell").mapInPandas(_blocks(width, threshold), LINKS)
    rest = materialize(rest, "near-rest")
    labels = connected_components(confirmed.unionByName(rest))

    # every row: through its representative to its class
    named = reps.join(labels, reps["rep"] == labels["id"], "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named, "near-named")
    discard(reps, stars, members, scored, ids, confirmed, mixed, unsettled, band_sizes, clustered, sizes, cells, rest, first, labels)
    return signed.join(named, "print", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )
