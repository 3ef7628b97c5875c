"""Cost-balanced packing of token sequences.

Each task tokenizes the documents of its partition and packs them in blocks of bounded size, so nothing is shuffled. A document
is its ids and a closing id 0. Pieces of the full length fill sequences of their own; what is left of each document is assigned
in descending order to the sequence of the lowest estimated cost (linear plus quadratic, as attention has it) among those that
have room. What fits nowhere whole is cut over the room that is left, so a block pads less than one sequence in all.

Null texts count as empty: one token. Repeated rows are packed each. An empty table gives no rows. Texts of any length are tokenized whole
and cut over as many sequences as they need; a block ends with the document that fills it.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .shared import give_back

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Bits of sequence_id for the sequences of one partition.
PART_BITS = 38

#: Distinct words whose ids a task keeps.
CACHE_WORDS = 300_000


@functools.lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: How this kind of vocabulary cuts text into words, with letters and digits spelt out below U+0250, where they are beyond doubt.
_LETTERS, _DIGITS, _SPACE = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\t-\r \x85\xa0"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACE}{_LETTERS}{_DIGITS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class _Known(dict):
    """What `make` gives for each key, made at the first look."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        self[key] = out = self.make(key)
        return out


#: Where a text may be cut: before a blank that a word follows. Of a run of blanks that is the last one.
CUT = re.compile(r" (?=\S)")


class Ids:
    """Token ids of texts, equal to the library's over whole texts. Its pre-tokenizer attaches one blank to the word after it, so a
    text may be cut before each blank that a word follows; each distinct piece is then looked at once, and its words go to the
    library's model. Pieces with characters from U+0250 on go through the library. Special tokens are found first, as the library
    does, and what is between them is cut; texts with special tokens that take blanks or words around them in go through the library
    as they are. So a worker holds the library's records of a piece, not of a long text."""

    def __init__(self, path: str):
        self.lib = _tokenizer(path)
        self.known, self.words = _Known(self.after_blank), _Known(self.word)
        added = self.lib.get_added_tokens_decoder()
        self.model, self.special = self.lib.model, {t.content: array("I", [k]).tobytes() for k, t in added.items()}
        self.plain = all(t.special and not (t.lstrip or t.rstrip or t.single_word or " " in t.content) for t in added.values())
        self.between = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.shown = {k: ord(c) for k, c in enumerate(byte_symbols())}
        self.blank = chr(self.shown[32])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for kept in (self.known, self.words):
            if len(kept) > CACHE_WORDS:
                kept.clear()
        return [self.marked(t) if any(s in t for s in self.special) else self.cut(t) for t in texts]

    def marked(self, text: str) -> bytes:
        """Ids of a text with special tokens."""
        if not self.plain:
            return self.library([text])[0]
        return b"".join([self.special[part] if k % 2 else self.cut(part) for k, part in enumerate(self.between.split(text))])

    def cut(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return b"".join([self.piece(first), *map(self.known.__getitem__, rest)])
        except TypeError:  # some blank has no word after it
            first, *rest = CUT.split(text)
            return b"".join([self.piece(first), *map(self.known.__getitem__, rest)])

    def after_blank(self, piece: str) -> bytes | None:
        """Ids of a blank and what follows it; None where that is the end or white space of any kind, as the library takes such runs whole."""
        if piece.isascii() and piece.isalpha():
            return self.tokens(self.blank + piece)
        return self.piece(" " + piece) if piece and not piece[0].isspace() else None

    def piece(self, piece: str) -> bytes:
        if not piece.isascii() and max(piece) >= "\u0250":
            return self.library([piece])[0]
        if piece[1:].isalpha() and piece[0] == " ":
            return self.word(piece)
        return b"".join(map(self.words.__getitem__, WORDS.findall(piece)))

    def word(self, word: str) -> bytes:
        return self.tokens(word.encode().decode("latin-1").translate(self.shown))

    def tokens(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]


def cost(length, linear: float, quadratic: float):
    return linear * length + quadratic * length * length


def pack(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one block, and how many sequences it takes."""
    pieces, n = [], 0
    rest = []
    for d, size in enumerate(lengths):
        for start in range(0, size - capacity + 1, capacity):
            pieces.append((d, start, capacity, n, 0))
            n += 1
        if size % capacity:
            rest.append((-(size % capacity), d, size - size % capacity))
    if not rest:
        return pieces, n
    bins = -(-sum(-r for r, _, _ in rest) // capacity)
    room, left = [capacity] * bins, []
    # sequences by cost; one whose room is too small for this document is set aside until a smaller one comes
    open_, aside = [(0.0, at) for at in range(bins)], []

    def put(d: int, start: int, length: int, at: int, spent: float) -> None:
        pieces.append((d, start, length, n + at, capacity - room[at]))
        room[at] -= length
        if room[at]:
            heapq.heappush(open_, (spent + cost(length, linear, quadratic), at))

    for size, d, start in sorted(rest):
        while aside and -aside[0][0] >= -size:
            _, spent, at = heapq.heappop(aside)
            heapq.heappush(open_, (spent, at))
        while open_ and room[open_[0][1]] < -size:
            spent, at = heapq.heappop(open_)
            heapq.heappush(aside, (-room[at], spent, at))
        if open_:
            spent, at = heapq.heappop(open_)
            put(d, start, -size, at, spent)
        else:
            left.append((d, start, -size))
    for _, spent, at in aside:
        heapq.heappush(open_, (spent, at))
    for d, start, size in left:
        while size:
            spent, at = heapq.heappop(open_)
            part = min(size, room[at])
            put(d, start, part, at, spent)
            start, size = start + part, size - part
    return pieces, n + bins


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = 1_000_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. block_tokens: tokens that are packed together."""

    def run(batches):
        ids, made = Ids(tokenizer), TaskContext.get().partitionId() << PART_BITS
        block: list[tuple[int | None, bytes]] = []
        size = 0

        def flush():
            nonlocal block, size, made
            pieces, n = pack([len(b) // 4 for _, b in block], capacity, linear, quadratic)
            cols = list(zip(*pieces, strict=True)) or [()] * 5
            d, start, length, seq, offset = cols
            crc = [zlib.crc32(memoryview(block[k][1])[4 * s : 4 * (s + m)]) for k, s, m in zip(d, start, length, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in ([block[k][0] for k in d], start, length, crc, [len(block[k][1]) // 4 for k in d], [made + s for s in seq], offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            made, block, size = made + n, [], 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
                for key, b in zip(keys, ids(texts), strict=True):
                    block.append((key, b + b"\0\0\0\0"))
                    size += len(b) // 4 + 1
                    if size >= block_tokens:
                        yield flush()
        if block:
            yield flush()
        del ids
        give_back()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
