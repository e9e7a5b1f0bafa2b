"""Toxicity scores by weak supervision.

Voters: families of fixed lexicon words, single mined words, and style patterns; each votes or abstains on a text.
Mined words come, by likelihood ratio, from a bounded hash sample of the labelled training rows.

Label model: P(label) * P(votes | label), where each class has a tree of dependent voters (Chow and Liu 1968): a voter's
rate depends on the label and on its parent in the tree, which is the voter it is most correlated with given the label.
Rates (accuracies) and trees (correlations) are re-estimated by EM over the vote patterns of all training rows. Labelled rows
keep their label in EM and so anchor the classes. The pattern table stays in Spark; a round brings back pair counts, whose
number depends on that of the voters alone.

Classifier: logistic regression over mined words and style features, fitted on the label model's posterior of a bounded
sample of labelled and of unlabelled training rows, scores every text. The labels themselves are not its target.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, discard, materialize, ship
from .hashing import chunks
from .sampling import bounded_sample

SAMPLE_ROWS = 20_000  # bound on the labelled rows that words are mined from, and on the labelled and the unlabelled rows of the classifier
VOCABULARY = 2_000  # bound on mined words
WORD_VOTERS = 24  # mined words that vote alone; the others of the lexicon vote together
LEXICON_GAIN, LEXICON_PURITY = 18.0, 0.5  # a mined word joins the lexicon from here on
ROUNDS = 8  # of EM
# fixed values: families of insults and threats that need no mining
FAMILIES = (
    ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "retard", "retarded"),
    ("loser", "losers", "pathetic", "worthless", "clown", "clowns"),
    ("scum", "scumbag", "trash", "garbage", "vermin", "filth", "disgusting"),
    ("freak", "creep", "bastard", "bitch", "asshole"),
    ("hate", "kill", "die"),
    ("crap", "shit", "fuck", "fucking"),
)
SEED_WORDS = tuple(w for family in FAMILIES for w in family)
WORDS = re.compile(r"[^\W\d_]+")
#: Vote bits in order: families, mined words, the other mined words, two lexicon words, their density, second-person insult, shouting, exclamations.
N_LEXICON = len(FAMILIES) + WORD_VOTERS + 1
N_VOTERS = N_LEXICON + 5
INSULT = re.compile(r"\b(?:you|your|u|ur)\b[^.!?\n]{0,20}\b(?:" + "|".join(SEED_WORDS) + r")\b")
STYLE = ("capitals", "exclamations", "repeats", "length", "lexicon_density", "lexicon_words", "any_lexicon_word")


def word_lists(texts: list[str | None]) -> list[list[str]]:
    return [WORDS.findall((t or "").lower()) for t in texts]


def _sample_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts, toxic = f["text"].tolist(), f["toxic"].tolist()
        for a, b in chunks(texts, 4 << 20):
            n, t = Counter(), Counter()
            for words, label in zip(word_lists(texts[a:b]), toxic[a:b], strict=True):
                seen = set(words)
                n.update(seen)
                if label:
                    t.update(seen)
            n.update({"": b - a})  # the empty word counts the texts
            t.update({"": sum(toxic[a:b])})
            yield pd.DataFrame({"word": list(n), "n": list(n.values()), "toxic": [t[w] for w in n]})


def mine_vocabulary(sample: DataFrame, size: int = VOCABULARY) -> pd.DataFrame:
    """The words that tell most: word, weight (signed likelihood-ratio statistic), purity (toxic share of its texts)."""
    counts = materialize(
        sample.mapInPandas(_sample_counts, "word string, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")),
        "tox-words",
    )
    total = counts.where("word = ''").first()
    if total is None or not total["toxic"] or total["toxic"] == total["n"]:
        return pd.DataFrame({"word": [], "weight": [], "purity": []})
    share = float(total["toxic"]) / float(total["n"])
    a, n = F.col("toxic").cast("double"), F.col("n").cast("double")
    gain = 2 * (F.coalesce(a * F.log(a / (n * share)), F.lit(0.0)) + F.coalesce((n - a) * F.log((n - a) / (n * (1 - share))), F.lit(0.0)))
    ranked = counts.where((F.col("word") != "") & (F.col("n") >= 4)).select("word", F.when(a < n * share, -gain).otherwise(gain).alias("weight"), (a / n).alias("purity"))
    return ranked.orderBy(F.abs("weight").desc(), "word").limit(size).toPandas()


class Voters:
    """Votes (a bit each) and features of texts, for a mined vocabulary."""

    def __init__(self, words: list[str], weights: list[float], purities: list[float]):
        self.column = {w: i for i, w in enumerate(words)}
        self.voter = {w: i for i, family in enumerate(FAMILIES) for w in family}
        strong = [w for w, g, p in zip(words, weights, purities, strict=True) if g >= LEXICON_GAIN and p >= LEXICON_PURITY and w not in self.voter]
        for i, w in enumerate(strong):  # the strongest first
            self.voter[w] = len(FAMILIES) + min(i, WORD_VOTERS)

    def look(self, text: str, words: list[str]) -> tuple[int, list[int], list[float]]:
        counts = Counter(words)
        present = counts.keys()
        votes, hits = 0, 0
        found = present & self.voter.keys()
        for w in found:
            votes |= 1 << self.voter[w]
            hits += counts[w]
        n = max(len(words), 1)
        capitals = sum(1 for _ in re.finditer(r"[A-Z]{3,}", text)) / n
        marks = text.count("!") / n
        repeats = 1 - len(present) / n
        extra = (len(found) >= 2, hits / n >= 0.02, bool(found) and INSULT.search(text.lower()) is not None, capitals > 0.5, marks > 0.5)
        for i, on in enumerate(extra):
            votes |= on << (N_LEXICON + i)
        at = sorted(self.column[w] for w in present & self.column.keys())
        return votes, at, [min(capitals, 1.0), min(marks, 1.0), repeats, min(math.log1p(n) / 10, 1.0), min(hits / n * 10, 1.0), min(len(found), 4) / 4, float(bool(found))]


def _look(voters: Voters):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, texts, sha = f["doc_id"].tolist(), f["text"].tolist(), f["sha"].tolist()
            for a, b in chunks(texts):
                seen = [voters.look(t or "", w) for t, w in zip(texts[a:b], word_lists(texts[a:b]), strict=True)]
                yield pd.DataFrame(
                    {"doc_id": pd.array(ids[a:b], "Int64"), "sha": sha[a:b], "votes": [s[0] for s in seen], "words": [s[1] for s in seen], "style": [s[2] for s in seen]}
                )

    return run


def _bits(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64)[:, None] >> np.arange(N_VOTERS) & 1).astype(np.int8)


class LabelModel:
    """P(label), and per label a tree of voters: rate[label, voter, vote of its parent] is the chance of a vote."""

    def __init__(self, prior: float, parent: np.ndarray, rate: np.ndarray):
        self.prior, self.parent, self.rate = prior, parent, np.clip(rate, 1e-6, 1 - 1e-6)

    @staticmethod
    def start() -> LabelModel:
        """The belief that voters speak up on 30 % of toxic texts and on 2 % of others, and independently."""
        rate = np.empty((2, N_VOTERS, 2))
        rate[0], rate[1] = 0.02, 0.3
        return LabelModel(0.1, np.zeros((2, N_VOTERS), int), rate)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        x = _bits(votes)
        odds = np.full(len(x), math.log(self.prior / (1 - self.prior)))
        for label, sign in ((1, 1.0), (0, -1.0)):
            chance = self.rate[label][np.arange(N_VOTERS), x[:, self.parent[label]]]
            odds += sign * np.log(np.where(x == 1, chance, 1 - chance)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    @staticmethod
    def of_counts(both: np.ndarray, total: np.ndarray, strength: float = 20.0) -> LabelModel:
        """From both[label, i, j], the texts on which voters i and j vote (i = j: on which i votes), and total[label].

        `strength` pseudo texts of independent voters with the starting rates smooth the counts.
        """
        first = LabelModel.start()
        n = total + strength
        parent, rate = np.zeros((2, N_VOTERS), int), np.empty((2, N_VOTERS, 2))
        for label in range(2):
            r = first.rate[label, :, 0]
            alone = (np.diag(both[label]) + strength * r) / n[label]
            pair = (both[label] + strength * np.outer(r, r)) / n[label]
            parent[label] = _spanning_tree(_mutual_information(alone, pair))
            up = parent[label]
            on = pair[np.arange(N_VOTERS), up]
            rate[label, :, 1] = on / alone[up]
            rate[label, :, 0] = (alone - on) / (1 - alone[up])
            root = int(np.flatnonzero(up == np.arange(N_VOTERS))[0])
            rate[label, root] = alone[root]
        prior = (total[1] + 1) / (total.sum() + 10)
        return LabelModel(min(max(float(prior), 1e-4), 0.9999), parent, rate)


def _mutual_information(alone: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Of every two voters, from their rates and joint rates."""
    out = np.zeros_like(pair)
    a, b = alone[:, None], alone[None, :]
    for joint, expected in ((pair, a * b), (a - pair, a * (1 - b)), (b - pair, (1 - a) * b), (1 - a - b + pair, (1 - a) * (1 - b))):
        joint = np.maximum(joint, 1e-12)
        out += joint * np.log(joint / np.maximum(expected, 1e-12))
    return out


def _spanning_tree(weight: np.ndarray) -> np.ndarray:
    """Parents in the maximum spanning tree from voter 0, which is its own parent."""
    n = len(weight)
    parent, best, inside = np.zeros(n, int), weight[0].copy(), np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        k = int(np.where(inside, -np.inf, best).argmax())
        inside[k] = True
        closer = ~inside & (weight[k] > best)
        best[closer], parent[closer] = weight[k][closer], k
    return parent


def _pair_counts(model: LabelModel):
    """Expected pair counts of a part of the pattern table, as (place, value); the last two places are the labels' totals."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, total = np.zeros((2, N_VOTERS, N_VOTERS)), np.zeros(2)
        for f in frames:
            votes, known, n = (f[c].to_numpy() for c in ("votes", "toxic", "n"))
            q = np.where(known >= 0, known, model.posterior(votes))
            x = _bits(votes).astype(float)
            for label, mass in ((0, n * (1 - q)), (1, n * q)):
                both[label] += (x * mass[:, None]).T @ x
                total[label] += mass.sum()
        value = np.concatenate([both.ravel(), total])
        at = np.flatnonzero(value)
        yield pd.DataFrame({"place": at, "value": value[at]})

    return run


def fit_label_model(patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """EM over patterns: votes, toxic (0, 1 or -1 for unknown), n."""
    model = LabelModel.start()
    for _ in range(rounds):
        sums = patterns.mapInPandas(_pair_counts(model), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        value = np.zeros(2 * N_VOTERS * N_VOTERS + 2)
        value[sums["place"].to_numpy(int)] = sums["value"]
        model = LabelModel.of_counts(value[:-2].reshape(2, N_VOTERS, N_VOTERS), value[-2:])
    return model


def fit_linear(rows: list[np.ndarray], style: np.ndarray, target: np.ndarray, n_words: int, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by full-gradient Adam: weights of words, style features and a constant."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    k = style.shape[1]
    w = np.zeros(n_words + k + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(owner, w[column], len(rows)) + style @ w[n_words:-1] + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        g = np.concatenate([np.bincount(column, error[owner], n_words), style.T @ error, [error.sum()]]) / max(len(rows), 1) + 2e-4 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def score_toxicity(
    docs: DataFrame, labels: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), text_sha256.

    held_out (a column over doc_id) names rows of which neither label nor votes are learnt from. Labels are
    joined for learning only; of repeated labels of an id the largest counts, null labels none; of an id with
    several texts one trains. Null texts are empty, and empty texts are scored like any other. Without any usable label the
    label model starts from its belief about voters. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    fold = F.lit(False) if held_out is None else held_out
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("sha"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = materialize(bounded_sample(known, "doc_id", sample_rows), "tox-chosen")  # at most sample_rows ids
    sample = rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    mined = mine_vocabulary(sample)
    voters = Voters(mined["word"].tolist(), mined["weight"].tolist(), mined["purity"].tolist())
    looked = materialize(rows.mapInPandas(_look(voters), "doc_id long, sha string, votes long, words array<int>, style array<double>"), "tox-votes")

    learning = looked.where(~fold).select("doc_id", "votes").join(known, "doc_id", "left")
    patterns = materialize(learning.groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("toxic")).agg(F.count("*").alias("n")), "tox-patterns")
    model = fit_label_model(patterns)

    others = materialize(bounded_sample(learning.where("toxic is null").select("doc_id"), "doc_id", sample_rows), "tox-others")
    ids = chosen.select("doc_id").unionByName(others).distinct()  # at most 2 * sample_rows
    one = F.min(F.struct("votes", "words", "style")).alias("x")
    fit = looked.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(one).select("x.*").toPandas()
    believed = model.posterior(fit["votes"].to_numpy(np.int64))
    n_words = len(mined)
    style = np.array(fit["style"].tolist(), float).reshape(len(fit), len(STYLE))
    w = fit_linear([np.asarray(x, np.int64) for x in fit["words"]], style, believed, n_words) if len(fit) else None
    discard(chosen, patterns, others)

    if w is None:  # nothing to train on: the label model alone decides
        score = F.pandas_udf(lambda v: pd.Series(model.posterior(v.to_numpy(np.int64))), "double")("votes")
    else:
        weights = F.array(*[F.lit(float(x)) for x in w[:n_words]]) if n_words else F.array(F.lit(0.0))
        of_words = F.aggregate("words", F.lit(0.0), lambda acc, i: acc + F.element_at("weights", i + 1))
        of_style = sum((F.element_at("style", i + 1) * float(x) for i, x in enumerate(w[n_words:-1])), F.lit(float(w[-1])))
        looked = looked.crossJoin(F.broadcast(spark.range(1).select(weights.alias("weights"))))  # one row of fixed size
        score = 1 / (1 + F.exp(-(of_words + of_style)))
    scored = looked.select("doc_id", fold.alias("held_out"), score.alias("score"), F.col("sha").alias("text_sha256"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_sha256")


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from rows whose crc32 of the id modulo 5 is not 0; score every row."""
    return score_toxicity(docs, labels, crc_bucket("doc_id", 5) == 0)
