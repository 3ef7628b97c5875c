"""Substring dedup by seed and extend.

A word sequence of `window` words that also starts earlier (smaller identifier, or same document and earlier start) is a repeat.
Seeds are winnowed: of the k-grams inside each window the one with the least hash, the leftmost of equals, is its anchor, so equal
windows have equal anchors at equal places in them. Around its anchor a seed is extended both ways over the run of windows that the
anchor stands for, window - gram + 1 of them at most. Runs with equal words are one kind: all but the first of a kind are repeats as a
whole. Where runs of one anchor differ (a match ends inside one of them), the first run of each kind is settled window by window.
Repeats that overlap or touch merge to maximal ones, whose words go. So a match is never walked word by word along two documents: that
it goes on in the next run shows in that run's own kind.

Words are hashed to 64 bits, and sequences of them to 128 by two polynomials over those; sequences count as equal when these are.

Every pass over the texts stays where they lie; what it needs to know of the corpus are filters of fixed size (FILTER_BITS), which let
through some seeds in vain but hold none back: seeds whose anchor occurs twice, anchors with runs of several kinds, runs that are the
first of their kind. Counts and first places come from pre-aggregated groups; joins deal the hottest keys by broadcast, so an anchor
or passage that a third of all documents have goes to no single task.

Null and empty texts have no words. Null identifiers come first; repeated rows with one identifier keep the order of arrival.
An empty table gives no rows. One document of any length is one row; its words are hashed as numbers, 8 bytes each.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, hot_join, written

WINDOW, GRAM = 20, 8

#: Bits of a filter: 8 MB, at most 1,048,576 rows of 64 bits in the driver.
FILTER_BITS = 1 << 26

#: Distinct words whose hashes a task keeps.
CACHE_WORDS = 500_000

#: Odd bases of the two polynomials: fixed by a rule, the same on every machine.
_BASES = [xxhash.xxh64_intdigest(str(i).encode(), 7) | 1 for i in range(2)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer, so that the least value is no favourite of any word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the bases and of their inverses modulo 2**64, for as many words as the longest document so far."""

    def __init__(self):
        self.up = self.down = [np.zeros(0, np.uint64)] * 2

    def __call__(self, n: int) -> _Powers:
        if len(self.up[0]) < n:
            n = max(1024, 1 << (n - 1).bit_length())
            run = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, b, np.uint64))])
            self.up, self.down = [run(b) for b in _BASES], [run(pow(b, -1, 1 << 64)) for b in _BASES]
        return self


_powers = _Powers()


class Words:
    """The words of some documents in a row, as hashes; hashes of any of their sequences. Places count through all documents."""

    def __init__(self, texts: list[bytes], known: dict):
        parts = [t.split() for t in texts]  # bytes split at ASCII white space alone
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.n, self.base, self.doc = int(sizes.sum()), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(parts)), sizes)
        words = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(parts)), np.uint64, self.n)
        self.powers = _powers(self.n + 1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: self.n])]) for up in self.powers.up]

    def digest(self, half: int, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """One half of the hashes of the sequences from start to end."""
        s = self.sums[half]
        return _mixed((s[end] - s[start]) * self.powers.down[half][: self.n + 1][start])

    def every(self, half: int, length: int) -> np.ndarray:
        """As digest, of all sequences of one length."""
        m = self.n - length + 1
        return self.digest(half, slice(0, m), slice(length, length + m))


def _least(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the least of each n values in a row, where it lies; of equals the leftmost)."""
    at, span = np.arange(len(x)), 1
    while span < n:
        by = min(span, n - span)
        right = x[by:] < x[:-by]
        x, at = np.where(right, x[by:], x[:-by]), np.where(right, at[by:], at[:-by])
        span += by
    return x, at


def runs(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each run of windows with their anchor at one place; no window spans two documents."""
    if words.n < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    least, at = _least(words.every(0, gram), window - gram + 1)
    inside = np.flatnonzero(words.doc[: len(at)] == words.doc[window - 1 :])
    least, at = least[inside], at[inside]
    edge = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    return least[edge], inside[edge], np.diff(np.append(edge, len(at)))


def _place(at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A number for a run's place, for the filter of first runs."""
    return _mixed((at.astype(np.uint64) * np.uint64(_BASES[0])) ^ (start.astype(np.uint64) * np.uint64(_BASES[1])))


def _slices(batches, column: int, size: int = 2 << 20):
    """Parts of the batches whose texts (binary, in this column) have about `size` bytes, or one row of more."""
    for batch in batches:
        many = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(column)]


def _filter(values: DataFrame):
    """A broadcast filter over the column `h` of values (long): the bit of each value's last bits is set."""
    block = 1 << 10
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = values.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, int(h & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(block, np.int64)
        bits[pdf["word"].to_numpy() % block] = pdf["bits"].to_numpy()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [bits.tobytes()]})

    rows = words.withColumn("block", F.expr(f"int(word div {block})")).groupBy("block").applyInPandas(joined, "block int, bits binary").collect()  # FILTER_BITS / 65536 rows of 8 KB
    bits = np.zeros((FILTER_BITS // 64 // block, block), np.uint64)
    for r in rows:
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint64)
    return values.sparkSession.sparkContext.broadcast(bits.ravel())


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(FILTER_BITS - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, repeats (start, length in words: the maximal repeats), text (kept words joined by one space)."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    # `at` names a row for good: identifiers may be null or repeated
    rows, _ = written(plain.withColumn("at", F.monotonically_increasing_id()), "substring-documents")
    texts = rows.select("doc_id", "at", "text")

    def seed(batches):
        known = _Hashes()
        for batch in _slices(batches, 0):
            yield pa.RecordBatch.from_arrays([_long(runs(Words(_texts(batch, 0), known), window, gram)[0])], names=["h"])

    shared, shared_at = written(rows.select("text").mapInArrow(seed, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "substring-shared")
    drop(spark)
    often = _filter(shared)
    drop(spark, shared_at)

    def extend(batches):
        """Each run around an anchor that may occur twice: anchor, digest of all its words, place."""
        known, bits = _Hashes(), often.value
        for batch in _slices(batches, 2):
            words = Words(_texts(batch, 2), known)
            anchor, first, size = runs(words, window, gram)
            keep = _in(bits, anchor)
            anchor, first, size = anchor[keep], first[keep], size[keep]
            who, end = words.doc[first], first + size + window - 1
            at, start = batch.column(1).to_numpy()[who], first - words.base[who]
            yield pa.RecordBatch.from_arrays(
                [*map(_long, (anchor, words.digest(0, first, end), words.digest(1, first, end))), batch.column(0).take(pa.array(who)), pa.array(at), *[pa.array(c.astype(np.int32)) for c in (start, size)], _long(_place(at, start))],
                names=["anchor", "s0", "s1", "doc_id", "at", "start", "size", "h"],
            )

    found, found_at = written(texts.mapInArrow(extend, "anchor long, s0 long, s1 long, doc_id long, at long, start int, size int, h long"), "substring-runs")
    kinds, kinds_at = written(found.groupBy("s0", "s1").agg(F.min(F.struct("doc_id", "at", "start", "h")).alias("first"), F.min("anchor").alias("anchor"), F.count("*").alias("n")), "substring-kinds")
    drop(spark)
    again = kinds.where("n > 1").select("s0", "s1", F.col("first.at").alias("first_at"), F.col("first.start").alias("first_start"), "n")
    whole = hot_join(found.select("s0", "s1", "at", "start", "size"), again, ["s0", "s1"]).where("at <> first_at or start <> first_start").select("at", "start", "size")
    whole, whole_at = written(whole, "substring-whole")
    drop(spark, found_at)

    # anchors with several kinds of runs: the first run of each, window by window
    mixed = _filter(kinds.groupBy(F.col("anchor").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h"))
    firsts = _filter(kinds.select("first.h"))
    drop(spark, kinds_at)

    def windows(batches):
        known, several, leading = _Hashes(), mixed.value, firsts.value
        for batch in _slices(batches, 2):
            words = Words(_texts(batch, 2), known)
            anchor, first, size = runs(words, window, gram)
            ats = batch.column(1).to_numpy()
            who = words.doc[first]
            keep = _in(several, anchor) & _in(leading, _place(ats[who], first - words.base[who]))
            first, size = first[keep], size[keep]
            start = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            who = words.doc[start]
            yield pa.RecordBatch.from_arrays(
                [_long(words.digest(0, start, start + window)), _long(words.digest(1, start, start + window)), batch.column(0).take(pa.array(who)), pa.array(ats[who]), pa.array((start - words.base[who]).astype(np.int32))],
                names=["d0", "d1", "doc_id", "at", "start"],
            )

    single, single_at = written(texts.mapInArrow(windows, "d0 long, d1 long, doc_id long, at long, start int"), "substring-windows")
    drop(spark)
    first = single.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "at", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first, first_at = written(first.select("d0", "d1", F.col("first.at").alias("first_at"), F.col("first.start").alias("first_start"), "n"), "substring-first")
    drop(spark)
    ones = hot_join(single.select("d0", "d1", "at", "start"), first, ["d0", "d1"]).where("at <> first_at or start <> first_start").select("at", "start", F.lit(1).alias("size"))
    later, _ = written(whole.unionByName(ones).groupBy("at").agg(F.collect_list(F.struct("start", "size")).alias("runs")), "substring-repeats")
    drop(spark, single_at, first_at, whole_at)

    def cut(batches):
        for batch in _slices(batches, 1):
            ids, texts, lists = batch.column(0), _texts(batch, 1), batch.column(2)
            total, gone, spans, kept = [], [], [], []
            for k, t in enumerate(texts):
                parts = t.split()
                mask, where = np.zeros(len(parts) + 1, np.int32), lists[k]
                if where.is_valid:
                    start, size = where.values.field(0).to_numpy(), where.values.field(1).to_numpy()
                    np.add.at(mask, start, 1)
                    np.add.at(mask, start + size - 1 + window, -1)
                covered = np.cumsum(mask[:-1]) > 0
                edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                total.append(len(parts))
                gone.append(int(covered.sum()))
                spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(a, b, strict=True)])
                if len(a):
                    parts = [p for p, c in zip(parts, covered.tolist(), strict=True) if not c]
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "repeats", "text"],
            )

    out = rows.join(later, "at", "left").select("doc_id", "text", "runs").mapInArrow(cut, "doc_id long, n_words long, n_removed long, repeats array<struct<start:int,length:int>>, text binary")
    return out.withColumn("text", F.col("text").cast("string"))
