"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up every neighbouring pair by binary search over the sorted
pair keys, takes the lowest rank of each word, and merges all its places at once; words without a pair that merges are done.
Normalization (NFC, white space, lower case), the cut into words, byte symbols and added tokens follow the vocabulary file.

Null texts count as empty and have no ids. Repeated rows are encoded each. An empty table gives no rows. One text of any length is one row.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how this kind of vocabulary cuts normalized text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space as the vocabulary's pattern means it (str.split() also cuts at U+001C to U+001F).
BLANKS = re.compile(r"[\t-\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")

CACHE_WORDS = 150_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in [*ids.items(), *self.added.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + suffix] for s in symbols], np.int64)
        self.base = len(self.tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.base + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, -1)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.pattern = regex.compile(WORDS)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words are UTF-8 and not empty."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym, end = self.inner[flat], np.cumsum(size) - 1
        sym[end] = self.last[flat[end]]
        which, start = np.arange(len(words)), end + 1 - size
        none = len(self.ranks)
        while len(which):
            key = np.append(sym[:-1] * self.base + sym[1:], -1)
            key[start + size - 1] = -1  # no pair across words
            at = np.searchsorted(self.keys, key)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            least = np.minimum.reduceat(rank, start)
            over = least == none
            for k, a, n in zip(which[over].tolist(), start[over].tolist(), size[over].tolist(), strict=True):
                out[k] = sym[a : a + n].astype("<i4")
            own = np.repeat(np.arange(len(which)), size)
            keep = ~over[own]
            here = np.flatnonzero((rank == least[own]) & keep)
            # of places that overlap (a pair of equal symbols) every second one merges
            fresh = np.append(True, here[1:] != here[:-1] + 1)[: len(here)]
            run = np.arange(len(here)) - np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))
            here = here[run % 2 == 0]
            sym[here] = self.merged[rank[here]]
            keep[here + 1] = False
            gone = np.bincount(own[here], minlength=len(which))
            sym, size, which = sym[keep], (size - gone)[~over], which[~over]
            start = np.cumsum(size) - size
        return out

    def words(self, piece: str) -> list[str]:
        """Normalized words of a text without white space."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
            if "Σ" in piece:  # str.lower() would look at its place in the word
                piece = "".join(c.lower() for c in piece)
        piece = piece.lower()
        return [piece] if piece.isalpha() else self.pattern.findall(piece)


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of texts; what it keeps of words it has seen is bounded."""

    def __init__(self, path: str):
        self.v, self.by_word, self.by_piece = vocabulary(path), {}, {}

    def pieces(self, text: str) -> list[str]:
        """Runs without white space; added tokens stand alone."""
        v = self.v
        parts = v.split_added.split(text) if v.split_added and any(a in text for a in v.added) else [text]
        return [p for x in parts for p in ([x] if x in v.added else (x.split() if not ODD.search(x) else [y for y in BLANKS.split(x) if y]))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.by_piece) > CACHE_WORDS:
            self.by_piece = {}
        if len(self.by_word) > CACHE_WORDS:
            self.by_word = {}
        cut = [self.pieces(t) for t in texts]
        new = {p for ps in cut for p in ps} - self.by_piece.keys()
        split = {p: self.v.words(p) for p in new if p not in self.v.added}
        words = list({w for ws in split.values() for w in ws} - self.by_word.keys())
        if words:
            self.by_word.update((w, x.tobytes()) for w, x in zip(words, self.v.merge([w.encode() for w in words]), strict=True))
        for p in new:
            self.by_piece[p] = np.array([self.v.added[p]], "<i4").tobytes() if p in self.v.added else b"".join([self.by_word[w] for w in split[p]])
        get = self.by_piece.__getitem__
        return [b"".join(map(get, ps)) for ps in cut]


def encode(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", rows: int = 500) -> DataFrame:
    """doc_id, ids (array<int>)."""

    def run(batches):
        encoder = Encoder(vocabulary_path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = encoder(part.column(1).to_pylist())
                ends = np.cumsum([0, *[len(b) // 4 for b in ids]]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str, rows: int = 500) -> DataFrame:
    """The columns of encode() and text: the tokens joined by blanks, as a vocabulary file without a decoder asks for."""

    def run(batches):
        get = vocabulary(vocabulary_path).tokens.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column(1)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                texts = [" ".join(map(get, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
