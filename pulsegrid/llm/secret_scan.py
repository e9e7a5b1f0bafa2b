"""Secret scans: fixed patterns, and random-looking strings by a battery of randomness tests.

Base kinds are plain patterns. The method adds spans of kind `random`. Runs of key characters are cut at the signs that join a key to
what stands next to it (`key=`, `?sig=`, `path/`, `name-`): parts between signs, and parts without the plain words at their ends, are
candidates. A candidate is given the smallest encoding that holds it; strings of one letter case are tested over their 26 letters, and a capital
followed by lower case is a word and not tested. Five tests ask whether a run looks like uniform draws from its
alphabet: chi-squared on symbol counts, runs above and below the middle of the alphabet, serial correlation,
counts of upper case, lower case, digits and signs, and the share of letters that are frequent in prose. Their
p-values combine to one per run, the chance that the smallest of five falls so low.

False discoveries (structured runs among those reported) are controlled per length class. p-values of genuine keys are
uniform, those of structured runs pile up near 0: the distinct runs with p over a half tell how many genuine ones there are
(Storey 2002), and what is reported above a cut beyond their expected number is false. The cut of a class is the lowest at
which that share is at most `FALSE_SHARE`, between two fixed bounds. So a genuine key is lost at a rate of 0.2 % to 5 %, whatever
else the corpus holds. Every distinct run counts once, so copies do not move a cut.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .hashing import chunks

# fixed values: the base patterns and the least length of a secret of each kind
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

#: The least length of a random string that is looked for: a parameter of scan_secrets. Shorter ones leave the tests little to see.
LEAST = 18
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
LENGTH_CLASSES = (19, 24, 32, 48, 64, 128)  # upper ends; longer runs share the last class
#: The share of genuine keys a class loses at least; longer runs give the tests more power and need less.
NULL_REJECTION = (0.01, 0.01, 0.01, 0.005, 0.005, 0.002, 0.002)
MOST_REJECTION = 0.05  # and at most
FALSE_SHARE = 0.1  # of a class's reported runs
BINS = 1000  # of p-values

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("dec", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]
#: A capital followed by lower case, capitals alone, or words glued in camel case: never tested, and no candidate begins or ends with one.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[A-Za-z][a-z]+(?:[A-Z][a-z]{2,})+")
_ONE_CASE = tuple({c: i for i, c in enumerate(a)} for a in (_LOWER, _UPPER))
# letters of prose in a thousand, about the mean of English, German, French and Spanish
_PROSE = dict(zip(_LOWER, (84, 14, 33, 46, 145, 13, 16, 29, 74, 4, 6, 45, 26, 80, 59, 23, 6, 68, 70, 69, 41, 12, 8, 3, 9, 6), strict=True))
_WEIGHT = {c: math.log(26 * n / sum(_PROSE.values())) for c, n in _PROSE.items()}
_WEIGHT_MEAN = sum(_WEIGHT.values()) / 26
_WEIGHT_VAR = sum((w - _WEIGHT_MEAN) ** 2 for w in _WEIGHT.values()) / 26

_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[ord(c) for c in _UPPER + _LOWER + _DIGITS + "+/_=-"]] = True


def infer_encoding(run: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that holds all characters; none for words and for runs outside every alphabet."""
    body = run.rstrip("=")
    if not body or WORD.fullmatch(body):
        return None
    chars = set(body)
    return next(((name, index) for name, allowed, index in _SETS if chars <= allowed), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(symbols: np.ndarray, k: int) -> float:
    """Upper tail of the uniformity statistic, by the Wilson-Hilferty approximation."""
    expected = len(symbols) / k
    x = float(((np.bincount(symbols, minlength=k) - expected) ** 2).sum() / expected)
    d = k - 1
    z = ((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(symbols: np.ndarray, k: int) -> float:
    high = symbols >= k / 2
    a, n = int(high.sum()), len(symbols)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(symbols: np.ndarray) -> float:
    x = symbols - symbols.mean()
    v = float((x * x).sum())
    n = len(x)
    if v == 0:
        return 0.0
    return _two_sided((float((x[1:] * x[:-1]).sum()) / v + 1 / n) * math.sqrt(n))


def _binomial_p(x: int, n: int, share: float) -> float:
    """Two-sided: twice the smaller tail, exact for short runs."""
    if n > 256:
        return _two_sided((abs(x - n * share) - 0.5) / math.sqrt(n * share * (1 - share)))
    mass = lambda i: math.comb(n, i) * share**i * (1 - share) ** (n - i)
    return min(1.0, 2 * min(sum(map(mass, range(x + 1))), sum(map(mass, range(x, n + 1)))))


def kinds_p(body: str, index: dict[str, int]) -> float:
    """Counts of upper case, lower case, digits and signs against their shares of the alphabet: smallest p-value, times the kinds."""
    kind = lambda c: 0 if c in _UPPER else 1 if c in _LOWER else 2 if c in _DIGITS else 3
    sizes, counts = Counter(map(kind, index)), Counter(map(kind, body))
    return 1.0 if len(sizes) == 1 else len(sizes) * min(_binomial_p(counts[k], len(body), m / len(index)) for k, m in sizes.items())


def prose_p(body: str, index: dict[str, int]) -> float:
    """Upper tail of the log-likelihood of prose letters against equally likely ones; alphabets without all letters say nothing."""
    weights = [_WEIGHT[c] for c in body.lower() if c in _WEIGHT]
    if len(index) < 26 or not weights:
        return 1.0
    return 0.5 * math.erfc((sum(weights) - len(weights) * _WEIGHT_MEAN) / math.sqrt(2 * len(weights) * _WEIGHT_VAR))


def battery(run: str) -> float | None:
    """The combined p-value of a run under "uniform draws from its alphabet"; None if it is not tested."""
    body = run.rstrip("=")
    found = infer_encoding(run)
    index = found[1] if found else next((i for i in _ONE_CASE if body and i.keys() >= set(body)), None)
    if index is None:
        return None
    symbols, k = np.array([index[c] for c in body]), len(index)
    least = min(chi_squared_p(symbols, k), runs_p(symbols, k), serial_p(symbols), kinds_p(body, index), prose_p(body, index))
    return -math.expm1(5 * math.log1p(-min(least, 1 - 1e-12)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in code points, in order of start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def candidates(run: str, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run that may be a key of its own, those to try first in front.

    Parts lie between `=` signs. A key may hold + and / or - and _, so a part is cut at either pair, and what is left loses the
    words at its ends; after these, longest first, come the pieces between any signs. Padding belongs to the last part.
    """
    trimmed, pieces = set(), set()
    for part in re.finditer(r"[^=]+", run):
        for signs in ("-_", "+/"):
            for seg in re.finditer(rf"[^{signs}]+", part[0]):
                at = part.start() + seg.start()
                spans = [(at + m.start(), at + m.end()) for m in re.finditer(r"[^+/_-]+", seg[0])]
                pieces.update(spans)
                others = [x for x in spans if not WORD.fullmatch(run[x[0] : x[1]])] or (spans if len(spans) == 1 else [])
                if others:
                    trimmed.add((others[0][0], others[-1][1]))
    end = len(run.rstrip("="))
    ordered = [x for group in (trimmed, pieces - trimmed) for x in sorted(group, key=lambda x: (x[0] - x[1], x[0]))]
    return [(a, len(run) if b == end else b) for a, b in ordered if b - a >= least]


def random_spans(text: str, known: list[tuple[int, int, int]], least: int = LEAST) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of candidates that no base span touches and that may be random: the p-value exceeds the lower bound of their class.

    Of candidates that overlap the first that may be random is taken.
    """
    out = []
    for m in RUN.finditer(text):
        if m.end() - m.start() < least:
            continue
        taken = [(s, e) for s, _, e in known]
        for a, b in candidates(m[0], least):
            a, b = m.start() + a, m.start() + b
            if any(s < b and a < e for s, e in taken):
                continue
            p = battery(text[a:b])
            if p is not None and p > NULL_REJECTION[length_class(b - a)]:
                out.append((a, b, p))
                taken.append((a, b))
    return sorted(out)


def length_class(length: int) -> int:
    return bisect.bisect_left(LENGTH_CLASSES, length)


def cuts_of(counts: np.ndarray) -> list[float]:
    """The cut of each length class. counts[class, bin]: distinct runs whose p-value lies in the bin of width 1 / BINS."""
    out = []
    for level, n in zip(NULL_REJECTION, counts, strict=True):
        genuine = 2 * n[BINS // 2 :].sum()  # of which half lie above a half
        cut = MOST_REJECTION
        for k in range(round(level * BINS), round(MOST_REJECTION * BINS) + 1):
            reported = n[k:].sum()
            if reported - genuine * (1 - k / BINS) <= FALSE_SHARE * reported:
                cut = max(level, k / BINS)
                break
        out.append(cut)
    return out


def _long_runs(texts: list[str], least: int) -> np.ndarray:
    """Which texts hold a run of so many key characters: one vectorised look at the bytes."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _CANDIDATE[raw]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(begin, start[end - start >= least], "right") - 1] = True
    return out


def _run_id(run: str) -> int:
    return int.from_bytes(hashlib.blake2b(run.encode(), digest_size=8).digest(), "little", signed=True)


def _scan(least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, texts = f["doc_id"].tolist(), [t or "" for t in f["text"].tolist()]
            for a, b in chunks(texts):
                base, runs = [], []
                for t, long in zip(texts[a:b], _long_runs(texts[a:b], min(least, MIN_ACCESS)), strict=True):
                    low = t.lower() if not long else ""
                    # a base secret needs a key word, the access prefix, or a long run
                    spans = base_spans(t) if long or "AKIA" in t or any(k in low for k in KEYWORDS) else []
                    found = random_spans(t, spans, least) if long else []
                    base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                    runs.append([{"start": s, "end": e, "p": p, "class": length_class(e - s), "run": _run_id(t[s:e])} for s, e, p in found])
                yield pd.DataFrame({"doc_id": pd.array(ids[a:b], "Int64"), "base": base, "runs": runs})

    return run


SCAN_SCHEMA = "doc_id long, base array<struct<start: int, kind: int, end: int>>, runs array<struct<start: int, end: int, p: double, class: int, run: long>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    `least` is the length from which a random string is looked for; shorter ones are never reported, nor is a word (a
    capital followed by lower case, or such words in camel case). Letters of one case are tested over 26 letters.

    A span is kind:start:end in code points, the end exclusive; an assignment's span is its whole match. A null
    text is empty: counts of 0, the digest of the empty text and no spans. Repeated rows are scanned each;
    an empty table gives no rows. Other columns are not read. The texts are read once; what is counted over all of them comes
    back as one number per length class and bin of p-values.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = materialize(rows.mapInPandas(_scan(least), SCAN_SCHEMA), "secret-scan")
    distinct = scanned.where(F.size("runs") > 0).select(F.inline("runs")).select("class", "run", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).distinct()
    binned = distinct.groupBy("class", "bin").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros((len(NULL_REJECTION), BINS))
    counts[binned["class"].to_numpy(int), binned["bin"].to_numpy(int)] = binned["n"]
    cut = F.array(*[F.lit(float(c)) for c in cuts_of(counts)])
    random = F.transform(
        F.filter("runs", lambda r: r["p"] > F.element_at(cut, r["class"] + 1)),
        lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")),
    )
    scanned = scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def n(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )
