"""Importance resampling against a plain version that builds every feature as a string."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from pulsegrid.llm import importance

from .conftest import LONG, MESSY, documents

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, targets):
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % 10_000
    held = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in held for f in fs), Counter(bucket(f) for x in targets for f in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0))))
    out = []
    for i, n, fs in held:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def test_crc_of_spans():
    rng = random.Random(1)
    raw = np.frombuffer(rng.randbytes(9000), np.uint8)
    start = np.array([rng.randrange(8000) for _ in range(2000)])
    end = start + np.array([rng.choice([1, 2, 3, 4, 5, 40, 63, 64, 65, 127, 128, 129, 192, 193, 1000]) for _ in range(2000)])
    assert importance.span_crcs(raw, start, end).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    assert importance.span_crcs(raw, start[:0], end[:0]).tolist() == []


def test_features_of_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(importance, "_SPAN_BYTES", 300)
    texts = ["Ünïcode ABC a-b_c 007", "", None, "one", "x" * 700 + " Y " + "z" * 65, " ".join(f"w{i}" for i in range(70_000)), "\x00\x7f", "日本 語"]
    got, words = [Counter() for _ in texts], np.zeros(len(texts), int)
    for owner, crc, n in importance.features(texts, 3):
        words += n
        for o, c in zip(owner.tolist(), crc.tolist(), strict=True):
            got[o][c] += 1
    for k, t in enumerate(texts):
        n, fs = plain_features(t)
        assert words[k] == n and got[k] == Counter(zlib.crc32(f.encode()) for f in fs)


def test_resampling_equals_the_plain_version(spark):
    rng = random.Random(5)
    word = lambda: f"k{rng.randrange(400)}"
    hot = " ".join(word() for _ in range(60))
    rows = [(i, hot if i % 3 == 0 else " ".join(word() for _ in range(rng.randrange(5, 50)))) for i in range(1, 400)]
    rows += [*MESSY, rows[7], rows[7], (500, LONG)]
    targets = [" ".join(f"k{rng.randrange(60)}" for _ in range(30)) for _ in range(12)] + [None, ""]
    goal = spark.createDataFrame([(k, t, 0.5, 1) for k, t in enumerate(targets)], "item_id long, text string, score double, rank int")
    got = importance.resample(documents(spark, rows), goal)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_resample(rows, targets)


def test_empty_tables(spark, empty, messy):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(empty, none).collect() == []
    assert Counter(map(tuple, importance.resample(messy, none).collect())) == plain_resample(MESSY, [])
