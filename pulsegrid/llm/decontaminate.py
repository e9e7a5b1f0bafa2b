"""Benchmark decontamination: rare word-pair seeds (2-grams, also with a gap), then Smith-Waterman alignment.

Test items come in blocks of bounded size (by their words), so what tasks receive is bounded however
large the benchmark is; each block is held against the whole corpus.

1. One pass over the texts counts, for every word pair of the block, the documents that hold it, as neighbours or with one word between.
   A local alignment that reaches half of a perfect score holds such a pair: without one every two matches pay for a change
   between them, and only items whose words all stand one apart still reach it.
2. Seeds of an item are its rare pairs: held by at most `RARE_SHARE` of all documents or by `RARE_DOCS`,
   or at most four times as often as the item's own median, so that an item keeps its seeds even if a
   third of the corpus copies it.
3. A second pass looks seeds up, gathers the diagonals they suggest into windows, aligns each window that holds enough of
   the item's words with them, and keeps the best score. No text is shuffled, so no key can be hot.

The score is the local alignment score over that of a perfect copy: words equal +1, different or skipped
-0.5. Words are lower-cased runs without ASCII punctuation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, without
from .hashing import _PLACE, chunks, hash_words, mix

THRESHOLD = 0.5
RARE_SHARE, RARE_DOCS = 0.001, 50
SPREAD = (1, 2)  # how far apart the words of a seed may stand in a text
BLOCK_WORDS = 1_000_000  # words of test items per block
_PUNCTUATION = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a few texts, and where each text's words begin (one more at the end)."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION) for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    starts, hashes = hash_words(b"\n".join(parts))
    return hashes, np.searchsorted(starts, begin, "left")


def grams_of(words: np.ndarray, begin: np.ndarray, steps: tuple[int, ...] = (1,)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ordered word pairs inside texts, as many words apart as a step says, and the word at which each begins."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    grams, starts = [], []
    for step in steps:
        n = max(0, len(words) - step)
        at = np.flatnonzero(owner[:n] == owner[step:]) if n else np.zeros(0, np.int64)
        grams.append(mix(words[at] * _PLACE[0] + words[at + step] * _PLACE[1]))
        starts.append(at)
    return np.concatenate(grams), np.concatenate(starts)


def align(item: np.ndarray, window: np.ndarray, penalty: float = 0.5) -> tuple[float, int]:
    """Best local alignment score of two word sequences, and the window's word where it ends."""
    steps = np.arange(1, len(window) + 1) * penalty
    row = np.zeros(len(window) + 1)
    best, end = 0.0, 0
    for w in item:
        diagonal = row[:-1] + np.where(window == w, 1.0, -penalty)
        new = np.maximum(np.maximum(diagonal, row[1:] - penalty), 0.0)
        new = np.maximum.accumulate(new + steps) - steps  # gaps along the window
        k = int(new.argmax())
        if new[k] > best:
            best, end = float(new[k]), k + 1
        row[1:] = new
    return best, end


def _windows(starts: np.ndarray, length: int, size: int) -> list[tuple[int, int]]:
    """Merged ranges of a text in which copies that begin near the given words would lie."""
    slack = length // 2 + 2
    out: list[list[int]] = []
    for s in np.unique(starts).tolist():
        a, b = max(0, s - slack), min(size, s + length + slack)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _count_grams(grams: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(grams), np.int64)
        for f in frames:
            texts = f["text"].tolist()
            for a, b in chunks(texts):
                words, begin = words_of(texts[a:b])
                found, at = grams_of(words, begin, SPREAD)
                where = np.searchsorted(grams, found)
                where[where == len(grams)] = 0
                hit = grams[where] == found
                owner = np.searchsorted(begin, at[hit], "right") - 1
                pairs = np.unique(owner * len(grams) + where[hit])  # each document once
                total += np.bincount(pairs % len(grams), minlength=len(grams))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    return run


def _match(item_ids: list[int], words: np.ndarray, begin: np.ndarray, grams: np.ndarray, first: np.ndarray, owner: np.ndarray, start: np.ndarray, threshold: float):
    """first[i] : first[i + 1] are the (item, word) places of seed i in owner and start."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, texts = f["doc_id"].tolist(), f["text"].tolist()
            out = []
            for a, b in chunks(texts):
                dw, db = words_of(texts[a:b])
                found, at = grams_of(dw, db, SPREAD)
                where = np.searchsorted(grams, found)
                where[where == len(grams)] = 0
                hit = np.flatnonzero(grams[where] == found)
                if not len(hit):
                    continue
                seed, at = where[hit], at[hit]
                doc = np.searchsorted(db, at, "right") - 1
                n = first[seed + 1] - first[seed]
                flat = np.repeat(first[seed] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                doc, at, seed = np.repeat(doc, n), np.repeat(at, n), np.repeat(seed, n)
                item, shift = owner[flat], at - db[doc] - start[flat]
                order = np.lexsort((shift, item, doc))
                doc, item, shift, seed = doc[order], item[order], shift[order], seed[order]
                cut = np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) + 1
                for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
                    d, i = int(doc[x]), int(item[x])
                    text = dw[db[d] : db[d + 1]]
                    target = words[begin[i] : begin[i + 1]]
                    best, end = 0.0, 0
                    for p, q in _windows(shift[x:y], len(target), len(text)):
                        if np.isin(target, text[p:q]).sum() < threshold * len(target):
                            continue  # no alignment scores more than the words that are there
                        score, stop = align(target, text[p:q])
                        if score > best:
                            best, end = score, p + stop
                    if best >= threshold * len(target):
                        sha = hashlib.sha256(texts[a + d].encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((ids[a + d], item_ids[i], best / len(target), len(np.unique(seed[x:y])), end, sha))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "n_seeds", "end_word", "text_sha256"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return run


MATCHES = "doc_id long, item_id long, score double, n_seeds int, end_word int, text_sha256 string"


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and test item that match: doc_id, item_id, score, n_seeds, end_word, text_sha256.

    score is 1 for a whole copy. A pair at the threshold is lost only if all its seeds are common ones. Null or empty texts match nothing; items of one word have no
    pair and match nothing, of two or three words they match only with a pair. Repeated documents or items match each on their own. An empty table on either
    side gives no rows. Columns other than the named ones are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    n_docs = rows.count()
    size = tests.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block_words))
    numbered = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        block = numbered.where(F.col("block") == k).orderBy("item_id", "text").select("item_id", "text").toPandas()  # about block_words words
        words, begin = words_of(block["text"].tolist())
        gram, at = grams_of(words, begin)
        if not len(gram):
            continue
        owner = np.searchsorted(begin, at, "right") - 1
        grams, place = np.unique(gram, return_inverse=True)
        held = rows.select("text").mapInPandas(_count_grams(grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
        df = np.zeros(len(grams))
        df[held["gram"].to_numpy(int)] = held["n"]
        own = pd.DataFrame({"item": owner, "df": df[place]})
        median = own.groupby("item")["df"].transform("median").to_numpy()
        rare = own["df"].to_numpy() <= np.maximum(max(RARE_SHARE * n_docs, RARE_DOCS), 4 * median)
        order = np.flatnonzero(rare)[np.argsort(place[rare], kind="stable")]
        seeds, first = np.unique(place[order], return_index=True)
        first = np.append(first, len(order))
        start = at[order] - begin[owner[order]]
        part = rows.mapInPandas(_match(block["item_id"].tolist(), words, begin, grams[seeds], first, owner[order], start, threshold), MATCHES)
        part = materialize(part, "leaks") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], MATCHES)


def drop_leaked(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that match no test item, with all their columns. Rows without an id stay, and so do other texts of an id."""
    return without(docs, leaks, id_col, text_col)
