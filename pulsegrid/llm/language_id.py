"""Language identification of spans and whole texts.

Learning: hashed byte-trigram counts of words per language, from a bounded hash sample of the labelled
rows of each language, summed by Spark; the model's size is languages x bins, whatever the number of rows.
Which scripts a language is written in is learnt with it.

Prediction: a word's script range narrows the languages that may own it; those get the word's mean
log-probability as a score. A Viterbi path over the words, with a penalty for each switch, labels every
word; equal neighbours are spans. A text's language owns most of its letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, discard, materialize, maybe_among, ship
from .hashing import chunks
from .sampling import sample_per_group

BINS = 1 << 15
SAMPLE_ROWS = 10_000  # bound on the ids of one language that are learnt from
SWITCH = 6.0
WORDS = re.compile(r"[^\W\d_]+")  # letters and some other numerals
# fixed values: first code points of script ranges, and the script that begins there
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0780, 0x0900, 0x0E00, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3130, 0x3400, 0xAC00, 0xD7B0)
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "indic", "southeast", "hangul", "ethiopic", "latin", "greek", "other", "kana", "hangul", "han", "hangul", "other")
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))
_SCRIPT_OF = np.array([SCRIPTS.index(s) for s in SCRIPT_NAMES])


def words_of(text: str) -> list[str]:
    """The maximal runs of letters (Unicode categories L*), lower-cased."""
    out = []
    for w in WORDS.findall(text.lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def word_scripts(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words])
    return _SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, first, "right") - 1]


def word_trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of space-bounded words, and where each word's trigrams begin (one more at the end)."""
    parts = [w.encode("utf-8", "surrogatepass") for w in words]
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8).astype(np.uint32)
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    # trigrams that start at a word's last byte span two words; drop them
    size = np.array([len(p) for p in parts])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    keep = np.ones(len(code), bool)
    keep[start[1:-1] - 1] = False
    code = code[keep]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def _count(langs: list[str]):
    place = {name: i for i, name in enumerate(langs)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = np.zeros((len(langs), BINS), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS)), np.int64)
        for f in frames:
            owner, texts = f["lang"].tolist(), f["text"].tolist()
            for a, b in chunks(texts):
                for name in set(owner[a:b]):
                    words = words_of("\n".join(t or "" for t, o in zip(texts[a:b], owner[a:b], strict=True) if o == name))
                    if words:
                        grams[place[name]] += np.bincount(word_trigrams(words)[0], minlength=BINS)
                        scripts[place[name]] += np.bincount(word_scripts(words), minlength=len(SCRIPTS))
        for i, name in enumerate(langs):
            for kind, counts in (("gram", grams[i]), ("script", scripts[i])):
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": name, "kind": kind, "bin": at, "n": counts[at]})

    return run


class LanguageModel:
    """Log-probabilities (bins x languages) and the scripts that each language uses."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        smooth = grams + 0.5
        self.langs = langs
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        uses = (share >= 0.01).T
        uses[~uses.any(axis=1)] = True  # a script that nobody uses narrows nothing
        self.mask = np.where(uses, 0.0, -50.0).astype(np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        grams, begin = word_trigrams(words)
        total = np.add.reduceat(self.logp[grams], begin[:-1], axis=0)
        return total + self.mask[word_scripts(words)]


def viterbi(scores: np.ndarray, begin: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word of several texts at once; text i owns words begin[i] to begin[i + 1].

    Texts advance together, the longest first, so every step is one array operation over those still running.
    """
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    at, size = begin[:-1][order], size[order]
    labels = np.zeros(len(scores), np.int32)
    if not len(size) or size[0] == 0:
        return labels
    running = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts with more than t words
    best = scores[at[: running[0]]].astype(np.float64)
    stay = np.ones(scores.shape, bool)
    top_of = np.zeros(len(scores), np.int32)
    for t in range(1, int(size[0])):
        n = running[t]
        prev, where = best[:n], at[:n] + t
        top = prev.argmax(axis=1)
        moved = prev[np.arange(n), top][:, None] - switch
        stay[where] = prev >= moved
        top_of[where] = top
        best[:n] = np.maximum(prev, moved) + scores[where]
    n = running[0]
    label = best[:n].argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = running[t]
        where = at[:n] + t
        labels[where] = label[:n]
        if t:
            kept = stay[where, label[:n]]
            label[:n] = np.where(kept, label[:n], top_of[where])
    return labels


def _label(texts: list[str | None], model: LanguageModel, switch: float):
    """Words and their number per text, their labels and their scores."""
    lists = [words_of(t or "") for t in texts]
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in lists for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum([len(w) for w in lists])])
    if not known:
        return lists, begin, np.zeros(0, np.int32), np.zeros((0, len(model.langs)), np.float32), np.zeros(0)
    vocabulary = list(known)
    scores = model.word_scores(vocabulary)[ids]
    letters = np.array([len(w) for w in vocabulary])[ids]
    return lists, begin, viterbi(scores, begin, switch), scores, letters


def _predict(model: LanguageModel, switch: float, with_spans: bool = False):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs = np.array([*model.langs, "und"])
        k = len(model.langs)
        for f in frames:
            ids, texts = f["doc_id"].tolist(), f["text"].tolist()
            for a, b in chunks(texts):
                lists, begin, labels, scores, letters = _label(texts[a:b], model, switch)
                n = b - a
                owner = np.repeat(np.arange(n), np.diff(begin))
                mass = np.zeros((n, k))
                np.add.at(mass, (owner, labels), letters)
                total = mass.sum(axis=1)
                best = np.where(total > 0, mass.argmax(axis=1), k)
                # the share of letters, tempered by how sure the whole text's scores are
                whole = np.zeros((n, k))
                np.add.at(whole, owner, scores)
                odds = np.exp(np.clip(whole - whole.max(axis=1, keepdims=True, initial=-np.inf) if k else whole, -60, 0))
                sure = odds[np.arange(n), np.minimum(best, k - 1)] / odds.sum(axis=1)
                share = mass.max(axis=1) / np.maximum(total, 1)
                out = {
                    "doc_id": pd.array(ids[a:b], "Int64"),
                    "lang_pred": langs[best],
                    "score": np.where(total > 0, np.clip(share * (0.5 + 0.5 * sure), 0, 1), 0.0),
                }
                if with_spans:
                    out["spans"] = [_spans(labels[begin[i] : begin[i + 1]], model.langs) for i in range(n)]
                yield pd.DataFrame(out)

    return run


def _spans(labels: np.ndarray, langs: list[str]) -> list[dict]:
    if not len(labels):
        return []
    cut = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
    return [{"first_word": a, "last_word": b, "lang": langs[labels[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most `rows` ids of each language, with one text each (the smallest, where an id has several).

    Every language of the table is learnt; the model grows with their number alone. Rows without a language or an id
    teach nothing.
    """
    spark = labelled.sparkSession
    ship(spark)
    named = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    named = named.where("lang is not null and doc_id is not null")
    chosen = materialize(sample_per_group(named.select("lang", "doc_id"), "lang", "doc_id", rows), "lang-chosen")
    langs = [r[0] for r in chosen.select("lang").distinct().orderBy("lang").collect()]  # one short value a language
    sample = maybe_among(named, chosen.select("doc_id"), "doc_id").join(chosen, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")
    counts = sample.mapInPandas(_count(langs), "lang string, kind string, bin long, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")).toPandas() if langs else None
    grams, scripts = np.zeros((len(langs), BINS)), np.zeros((len(langs), len(SCRIPTS)))
    if langs:
        for kind, into in (("gram", grams), ("script", scripts)):
            part = counts[counts["kind"] == kind]
            place = {name: i for i, name in enumerate(langs)}
            into[[place[x] for x in part["lang"]], part["bin"].to_numpy(int)] = part["n"]
    discard(chosen)
    return LanguageModel(langs, grams, scripts)


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, with_spans: bool = False
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (and word spans).

    Null texts and texts without a letter are `und` with score 0, as is everything if the model knows no
    language. Only id and text are read, so labels cannot leak into a prediction. No shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<first_word: int, last_word: int, lang: string>>" * with_spans
    if not model.langs:
        blank = rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
        return blank.withColumn("spans", F.expr("cast(array() as array<struct<first_word: int, last_word: int, lang: string>>)")) if with_spans else blank
    return rows.mapInPandas(_predict(model, switch, with_spans), schema)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from rows outside the held-out fold (crc32 of the id modulo 4 is 2), predict every row."""
    fold = crc_bucket("doc_id", 4) == 2
    model = train(docs.where(~fold))
    return identify(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
