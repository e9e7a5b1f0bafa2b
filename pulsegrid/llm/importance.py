"""Importance resampling towards a target: hashed n-gram features, log ratios, Gumbel-perturbed top draws.

Features are runs of one to three words. Each falls into a bucket by the CRC-32 of its bytes, for which no feature is ever
made a string: a CRC is linear, so that of a span is the XOR of what each byte gives at its distance from the span's end,
and of a constant of the span's length. Both come from tables made once; one gather and one `bitwise_xor.reduceat` give the
CRCs of all spans of a piece of text. Spans longer than the tables reach are folded block by block.

The texts are read twice, once to count buckets (10,000 numbers a task, whatever it read) and once to weigh documents with the
gains; only rows of five numbers are shuffled. Ranks come from slices of the order, whose sizes are added up, so no
task sees all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ship
from .hashing import LOWER, chunks

#: Bytes that the position table reaches; longer spans are folded in blocks of it.
REACH = 64
_SPAN_BYTES = 1 << 18  # of spans that are gathered at once
_WORD = np.zeros(256, bool)
_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def _contributions(reach: int) -> np.ndarray:
    """[d, b]: what byte b gives to a CRC-32 with d bytes after it; the next row lets one more zero byte pass."""
    of_byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    rows = [of_byte]
    for _ in range(reach - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ of_byte[rows[-1] & np.uint32(255)])
    return np.array(rows)


_TABLE = _contributions(REACH)
_FLAT = _TABLE.ravel()
#: The CRC-32 of n zero bytes.
_LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)
_ONES = np.uint32(0xFFFFFFFF)


def _linear(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The XOR of the contributions of each span of 1 to REACH bytes."""
    out = np.empty(len(start), np.uint32)
    done = np.cumsum(size)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + _SPAN_BYTES, "right")))
        n = size[a:b]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum()), dtype=np.int32)
        base = int(start[a:b].min())
        at = step + np.repeat((start[a:b] - base - first).astype(np.int32), n)
        left = np.repeat((first + n - 1).astype(np.int32), n) - step
        out[a:b] = np.bitwise_xor.reduceat(_FLAT[(left << 8) | raw[base:][at]], first)
        a = b
    return out


def _pass_block(register: np.ndarray) -> np.ndarray:
    """Registers after REACH zero bytes: a register's four bytes act as the next four bytes of the text."""
    out = np.zeros_like(register)
    for k in range(4):
        out ^= _TABLE[REACH - 1 - k][(register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def span_crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of raw[start[i]:end[i]] for every i; spans hold a byte at least."""
    size = end - start
    out = np.empty(len(start), np.uint32)
    short = size <= REACH
    out[short] = _linear(raw, start[short], size[short]) ^ _LENGTH[size[short]]
    left = np.flatnonzero(~short)
    if len(left):
        at, lead = start[left], (size[left] - 1) % REACH + 1  # the first block takes the odd length
        register = _linear(raw, at, lead) ^ _LENGTH[lead] ^ _ONES
        at = at + lead
        while len(left):
            open_ = at < end[left]
            out[left[~open_]] = register[~open_] ^ _ONES
            left, at, register = left[open_], at[open_], register[open_]
            if len(left):
                register = _pass_block(register) ^ _linear(raw, at, np.full(len(at), REACH))
                at = at + REACH
    return out


def features(texts: list[str | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a few texts: (owner, CRC-32) of runs of 1 to width words, in pieces, and with the first piece each text's words."""
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    word = _WORD[raw]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the byte after a word becomes the one space between words
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).astype(np.int8)))
    owner = np.searchsorted(begin, edge[0::2], "right") - 1
    raw = np.where(word, raw, np.uint8(32))[keep]
    end = np.flatnonzero(np.diff(np.concatenate([word[keep], [False]]).astype(np.int8)) == -1) + 1
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    words = np.bincount(owner, minlength=len(texts))
    for a in range(0, max(len(start), 1), 1 << 16):
        found = [(owner[:0], np.zeros(0, np.uint32))]
        for k in range(width):
            first = np.arange(a, min(a + (1 << 16), len(start) - k))
            first = first[owner[first] == owner[first + k]]
            found.append((owner[first], span_crcs(raw, start[first], end[first + k])))
        yield np.concatenate([o for o, _ in found]), np.concatenate([c for _, c in found]), words if a == 0 else words * 0


def _count(buckets: int, width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for f in frames:
            texts = f["text"].tolist()
            for a, b in chunks(texts):
                for _, crc, _ in features(texts[a:b], width):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return run


def _weigh(gain: np.ndarray, width: int):
    buckets = np.uint32(len(gain))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, texts = f["doc_id"].tolist(), f["text"].tolist()
            for a, b in chunks(texts):
                n, words, weight = np.zeros((3, b - a), np.int64)
                for owner, crc, more in features(texts[a:b], width):
                    n += np.bincount(owner, minlength=b - a)
                    words += more
                    weight += np.bincount(owner, weights=gain[crc % buckets], minlength=b - a).astype(np.int64)  # sums far below 2**53
                yield pd.DataFrame({"doc_id": pd.array(ids[a:b], "Int64"), "n_features": n, "n_words": words, "weight": weight})

    return run


def bucket_counts(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """(bucket, n) of the features of the column text: each task sends one row per bucket at most."""
    return texts.mapInPandas(_count(buckets, width), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): a thousand times the log ratio of smoothed shares in target and source, rounded down."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    for side, total in ((source, "of_s"), (target, "of_t")):
        both = both.crossJoin(F.broadcast(side.agg(F.sum("n").alias(total))))  # one row
    one = lambda c, extra: F.coalesce(c, F.lit(0)).cast("double") + F.lit(float(extra))
    ratio = one("t", 1) * one("of_s", buckets) / (one("s", 1) * one("of_t", buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(name: str, seed: int) -> Column:
    """Minus a thousand log minus log of a uniform number that the seed and the key decide, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, width: int = 3,
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank; rows that are not drawn have a null rank.

    Of the rows with `least_words` words at least, `percent` in a hundred (rounded down) are drawn, highest scores first, ties to the
    smaller doc_id (null last). A null or empty text has no features and weight 0. A null id counts as empty text in its draw.
    Repeated rows count, are weighed and may be drawn each. An empty table gives no rows; without
    targets every gain comes from the documents alone. Columns other than the named ones are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    goal = targets.select(F.col(target_text_col).cast("string").alias("text"))
    source = materialize(bucket_counts(rows.select("text"), buckets, width), "gain-source")
    target = materialize(bucket_counts(goal, buckets, width), "gain-target")
    gain = np.zeros(buckets, np.int64)
    for r in bucket_gains(source, target, buckets).collect():  # as many rows as buckets, at any size
        gain[r["bucket"]] = r["gain"]
    discard(source, target)

    weighed = rows.mapInPandas(_weigh(gain, width), "doc_id long, n_features long, n_words long, weight long")
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel("doc_id", seed)).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    scored = materialize(scored, "gain-scored")  # cutting ranges reads it twice
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    # once written, the places stay what they are: the slice above, the position inside it below
    placed = materialize(dealt.withColumns({"slice": F.shiftright("place", 33), "inside": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))}).drop("place"), "gain-placed")
    discard(scored)
    sizes = placed.groupBy("slice").agg(F.count("*").alias("n"), F.count_if("able").alias("able"))  # a row per slice
    before = F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    every = F.sum("able").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = sizes.select("slice", F.coalesce(before, F.lit(0)).alias("before"), F.floor(every * F.lit(percent) / F.lit(100)).alias("drawn"))
    rank = F.col("before") + F.col("inside") + 1
    return placed.join(F.broadcast(offsets), "slice").select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= F.col("drawn")), rank).alias("rank"))
