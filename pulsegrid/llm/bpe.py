"""BPE encoding and decoding through a pair occurrence index.

A batch's distinct words that no earlier batch of this worker has met are split into symbols, and
every adjacent pair is mapped to the list of all its places. A heap holds the ranks of pairs that
occur; the lowest is applied at all its places, left to right, and only the lists of the neighbouring
pairs change. This equals merging each word on its own, as a word's lowest active rank is always
applied before any higher one.

Texts are then a lookup of words. The worker's memory is bounded: the word table is emptied when it
reaches `CACHE_WORDS`, and a batch holds about 2 MB of text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .hashing import chunks

CACHE_WORDS = 200_000
#: The tokenizer's split for texts within Latin letters, where the standard module can do it faster.
_LETTER, _NUMBER, _BLANK = "a-zªµºß-öø-ÿ\u0100-\u017f", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN = re.compile("[\\x00-\u017f]*")
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Encoder and decoder for one tokenizer file of the word-end BPE kind (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        self.byte_id = [self.vocab[c] for c in symbols]
        self.last_id = [self.vocab[c + model["end_of_word_suffix"]] for c in symbols]
        # pair (a, b) as a << 32 | b -> rank << 32 | merged id
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[a] << 32 | self.vocab[b]] = r << 32 | self.vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        """Empty the word tables but for special tokens: word -> ids as text, word -> decoded text."""
        self.ids_of = {t: str(i) for t, i in self.special.items()}
        self.text_of = {t: t for t in self.special}

    def split(self, text: str) -> list[str]:
        """Normalise and cut into words; the strings of special tokens stay whole."""
        if "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return LATIN_WORDS.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # one character at a time, as the library does: no final form of sigma
        text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        return (LATIN_WORDS if LATIN.fullmatch(text) else self.words).findall(text)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all words at once over one pair occurrence index."""
        sym: list[int] = []
        left: list[int] = []
        right: list[int] = []
        first: list[int] = []
        places: dict[int, list[int]] = {}
        rank, byte_id, last_id = self.rank, self.byte_id, self.last_id
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            at = len(sym)
            end = at + len(raw) - 1
            first.append(at)
            ids = [byte_id[b] for b in raw]
            ids[-1] = last_id[raw[-1]]
            sym += ids
            left.append(-1)
            left += range(at, end)
            right += range(at + 1, end + 1)
            right.append(-1)
            a = ids[0]
            for i, b in enumerate(ids[1:], at):
                pair = a << 32 | b
                a = b
                if pair in places:
                    places[pair].append(i)
                elif pair in rank:
                    places[pair] = [i]
        heap = [(rank[p], p) for p in places]
        heapq.heapify(heap)
        while heap:
            ranked, pair = heapq.heappop(heap)
            merged = ranked & 0xFFFFFFFF
            a, b = pair >> 32, pair & 0xFFFFFFFF
            spots = places.pop(pair)
            if a == b:
                spots.sort()  # of overlapping places the left one merges
            for i in spots:
                j = right[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # another merge took one of the two
                sym[i], sym[j] = merged, -1
                k = right[i] = right[j]
                h = left[i]
                for at, new in ((i, merged << 32 | sym[k] if k >= 0 else -1), (h, sym[h] << 32 | merged if h >= 0 else -1)):
                    if new in places:
                        places[new].append(at)
                    elif new in rank:
                        places[new] = [at]
                        heapq.heappush(heap, (rank[new], new))
                if k >= 0:
                    left[k] = i
        out = []
        for at in first:
            ids = []
            while at >= 0:
                ids.append(sym[at])
                at = right[at]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: what the library does for a file that names no decoder."""
        return " ".join(self.token[i] for i in ids)

    def learn(self, words: set[str]) -> None:
        """Put the words that the tables lack into them, all over one index."""
        fresh = [w for w in words if w not in self.ids_of]
        if len(self.ids_of) + len(fresh) > CACHE_WORDS:
            self._forget()
            fresh = [w for w in words if w not in self.ids_of]
        for a, b in chunks(fresh, 1 << 20):
            for w, ids in zip(fresh[a:b], self.encode_words(fresh[a:b]), strict=True):
                self.ids_of[w] = " ".join(map(str, ids))
                self.text_of[w] = self.decode(ids)

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by one space, decoded text) of each text."""
        lists = [self.split(t or "") for t in texts]
        self.learn(set(chain.from_iterable(lists)))
        ids_of, text_of = self.ids_of.__getitem__, self.text_of.__getitem__
        out = []
        for words in lists:
            ids = " ".join(map(ids_of, words))
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(text_of, words))))
        return out


_encoders: dict[str, PairIndexEncoder] = {}


def _everywhere(docs: DataFrame, path: str) -> Callable[[], str]:
    """Send the tokenizer file to the executors; called in a task, gives its path there."""
    name = Path(path).name
    docs.sparkSession.sparkContext.addFile(path)
    return lambda: SparkFiles.get(name)


def encoder(path: str) -> PairIndexEncoder:
    if path not in _encoders:
        _encoders[path] = PairIndexEncoder(path)
    return _encoders[path]


def encode_texts(texts: list[str | None], path: str) -> list[tuple[int, str, str]]:
    """(number of ids, ids joined by one space, decoded text) of each text."""
    return encoder(path).encode(texts)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _batches(frames: Iterator[pd.DataFrame], size: int = 2 << 20) -> Iterator[tuple[list, list]]:
    """Consecutive (ids, texts) of about `size` characters, so that a worker holds few texts at once."""
    for f in frames:
        ids, texts = f["doc_id"].tolist(), f["text"].tolist()
        for a, b in chunks(texts, size):
            yield ids[a:b], texts[a:b]


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are empty: no ids, and the digests of the empty text. Repeated rows are encoded
    each; an empty table gives no rows. Only the two named columns are read. There is no shuffle.
    """
    ship(docs.sparkSession)
    local = _everywhere(docs, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _batches(frames):
            done = encode_texts(texts, local())
            yield pd.DataFrame(
                {"doc_id": pd.array(ids, "Int64"), "n_tokens": [d[0] for d in done], "ids_sha256": [_digest(d[1]) for d in done], "decoded_sha256": [_digest(d[2]) for d in done]}
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, SCHEMA)


def bpe_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves and the decoded text: doc_id, ids array<int>, decoded string."""
    ship(docs.sparkSession)
    local = _everywhere(docs, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _batches(frames):
            done = encode_texts(texts, local())
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "ids": [[int(i) for i in d[1].split()] for d in done], "decoded": [d[2] for d in done]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        run, "doc_id long, ids array<int>, decoded string"
    )
