"""Vectorised word and shingle hashing over whole texts (numpy, inside Spark tasks).

Words are maximal runs of bytes other than space and \\x09-\\x0D, after A-Z are lower-cased.
A word's hash is a polynomial over per-byte random values, so it depends on the word alone and
is the same in every process. Work goes through the text in pieces of about a megabyte, cut at
white space, so memory stays bounded by the longest single word, not by the text.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for uint64 values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))
_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n positions at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b & _MASK, np.uint64)]))
            for b in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def _piece_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[0::2], edge[1::2]
    power, inverse = _places(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=run[1:])
    return start, mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of already lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + PIECE)
        while stop < len(raw):
            ahead = np.flatnonzero(_SPACE[raw[stop : stop + PIECE]])
            if len(ahead):
                stop += int(ahead[0])
                break
            stop = min(len(raw), stop + PIECE)
        s, h = _piece_words(raw[at:stop])
        starts.append(s + at)
        hashes.append(h)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def chunks(texts: list[str | None], size: int = PIECE):
    """Consecutive slices (first, last) of the list that hold about `size` characters each."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t or "") + 1
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def doc_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of a few texts: the word hashes in order, and where each text's words begin (one more at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    starts, hashes = hash_words(b"\n".join(parts))
    return hashes, np.searchsorted(starts, begin, "left")


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, a wordless one none."""
    out: list[np.ndarray] = []
    place = _PLACE[:width]
    for first, last in chunks(texts):
        words, begin = doc_words(texts[first:last])
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled += words[j : n + j] * place[j]
        rolled = mix(rolled)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                short = words[a:b] * place[: b - a]
                out.append(mix(np.array([short.sum(dtype=np.uint64)]) ^ np.uint64(_GOLDEN + int(b - a))))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
