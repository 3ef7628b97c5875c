"""Vector code compression: each vector becomes one codebook index a part.

Components become integers, vectors are cut into equal consecutive parts, and every part position has a codebook of a few entries that
rounds of nearest-entry assignment refine. The nearest entry is found by slicing and intersecting: in each dimension the entries'
coordinates are sorted, and place k of that order carries a bitmask of the first k entries. A radius around a component cuts a range
out of the order, two masks give the entries in it, and the AND over all dimensions leaves exactly the entries in the box. An entry
no farther than the radius lies in the box, so a nearest candidate within the radius is the answer; else the radius grows to the
distance of the nearest candidate, or doubles where the box was empty.

Only counts and sums of 16 entries a part leave a task; the driver holds the codebooks, nothing that grows with the table. All
arithmetic is exact on integers (64 bits, and Python's own where components are beyond 2^27).

Rows whose vector is null or has null or non-finite components go. Vectors shorter than the longest one, or whose length is no multiple
of the number of parts, are filled up with zeros. Entries start from the rows of the least distinct identifiers (null last; of repeated
identifiers the least vector), fewer if there are fewer. Repeated rows count each. Components that no long holds saturate; an error that
no long holds is null and adds nothing to its label's sum. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hot_join, sparing, written

#: Components below this size are computed with in 64 bits: squared distances of parts of 64 components still fit.
SMALL = 1 << 27
#: Entries that one mask holds.
MASK_BITS = 64


class SlicedBook:
    """Exact nearest entries of one part position. entries: (entry, component) integers."""

    def __init__(self, entries: np.ndarray, radius: int | None = None):
        if len(entries) > MASK_BITS:
            raise ValueError(f"at most {MASK_BITS} entries")
        order = np.argsort(entries, axis=0, kind="stable")
        self.entries, self.sorted = entries, np.take_along_axis(entries, order, axis=0)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.prefix = np.vstack([np.zeros((1, entries.shape[1]), np.uint64), np.bitwise_or.accumulate(bits, axis=0)])
        self.every = np.uint64(sum(1 << k for k in range(len(entries))))
        self.radius = radius or first_radius(entries)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries in the box of each row."""
        mask = np.full(len(x), self.every)
        for d in range(self.entries.shape[1]):
            low, high = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left"), np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.prefix[high, d] & ~self.prefix[low, d]
        return mask

    def closest(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest candidate, the lower index in ties; entry -1 without a candidate."""
        at, best = np.full(len(x), -1), np.zeros(len(x), x.dtype)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(mask >> np.uint64(e) & np.uint64(1))
            far = ((x[rows] - entry) ** 2).sum(axis=1)
            nearer = (at[rows] < 0) | (far < best[rows])
            at[rows[nearer]], best[rows[nearer]] = e, far[nearer]
        return at, best

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, best = np.full(len(x), -1), np.zeros(len(x), x.dtype)
        radius, todo = np.full(len(x), self.radius, x.dtype), np.arange(len(x))
        while len(todo):
            entry, far = self.closest(x[todo], self.candidates(x[todo], radius[todo]))
            settled = (entry >= 0) & (far <= radius[todo] ** 2)
            at[todo[settled]], best[todo[settled]] = entry[settled], far[settled]
            wider = np.array([math.isqrt(int(f)) + 1 if e >= 0 else 2 * int(r) + 1 for e, f, r in zip(entry[~settled], far[~settled], radius[todo[~settled]], strict=True)], x.dtype)
            todo = todo[~settled]
            radius[todo] = wider
        return at, best


def first_radius(entries: np.ndarray) -> int:
    """The median distance of an entry from its nearest other entry: what assigned parts can be expected to be within."""
    if len(entries) < 2:
        return 1
    far = sorted(min(sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for j, v in enumerate(entries) if j != i) for i, u in enumerate(entries))
    return max(1, math.isqrt(far[len(far) // 2]))


class Codebooks:
    """The codebooks of all part positions: entries[part][entry] is a list of integers."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.width = len(entries[0][0])
        self.small = all(abs(x) < SMALL for part in entries for e in part for x in e)
        self._books: dict[str, list[SlicedBook]] = {}

    def __reduce__(self):
        return Codebooks, (self.entries,)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, squared distance) by (row, part), and the parts as (row, part, component)."""
        exact = np.int64 if self.small and (not vectors.size or max(int(vectors.max()), -int(vectors.min())) < SMALL) else object
        books = self._books.setdefault(np.dtype(exact).name, [])
        if not books:
            books.extend(SlicedBook(np.array(e, exact).reshape(len(e), self.width)) for e in self.entries)
        x = vectors.astype(exact).reshape(len(vectors), len(books), self.width)
        found = [b.nearest(x[:, p]) for p, b in enumerate(books)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1), x

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def quantised(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, x as an array of longs of one length, that length)."""
    v = F.col(vector)
    known = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(v.isNotNull() & known).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    kept, _ = written(kept, "vector-integers")
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    length = -(-longest // parts) * parts
    full = F.when(F.size("x") == length, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("x"))))
    return kept.withColumn("x", full), length


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def train(kept: DataFrame, length: int, parts: int, entries: int, rounds: int) -> Codebooks | None:
    """kept: vec_id, x. Each round is one pass: a task sends a count and a sum a component for each entry of each part."""
    first = kept.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    if not first:
        return None
    width = length // parts
    books = Codebooks([[list(r["x"][p * width : (p + 1) * width]) for r in first] for p in range(parts)])
    sums = [f"s{d}" for d in range(width)]
    schema = ", ".join(["part int", "entry int", "n long", *[f"{s} string" for s in sums]])
    for _ in range(rounds):
        sent = books

        def run(batches, sent=sent):
            n, total = np.zeros((parts, len(first)), np.int64), np.zeros((parts, len(first), width), object)
            for batch in batches:
                at, _, x = sent.nearest(_matrix(batch.column(0), length))
                for p in range(parts):
                    for e in np.unique(at[:, p]).tolist():
                        own = x[at[:, p] == e, p]
                        n[p, e] += len(own)
                        total[p, e] += own.sum(axis=0).astype(object)
            used = [(p, e) for p in range(parts) for e in range(len(first)) if n[p, e]]
            cols = [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(n[u]) for u in used], pa.int64())]
            cols += [pa.array([str(total[p, e, d]) for p, e in used], pa.string()) for d in range(width)]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", *sums])

        partial = kept.select("x").mapInArrow(sparing(run), schema)
        merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in sums]).collect()  # parts x entries rows
        new = [[list(e) for e in part] for part in books.entries]
        for r in merged:
            new[r["part"]][r["entry"]] = [int(r[s]) // r["n"] for s in sums]
        books = Codebooks(new)
    return books


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error, label_error) and the codebooks (None for a table without usable vectors).

    code: hex, two digits a part; error: the sum of the parts' squared distances; label_error: its sum over rows of one label, nulls
    together. A label that holds a great share of the rows is summed in each task first and joined by broadcast."""
    kept, length = quantised(vectors, vec_id, vector, label, scale, parts)
    books = train(kept, length, parts, entries, rounds)
    types = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}"
    if books is None:
        return kept.limit(0).selectExpr("vec_id", "label", "'' AS code", "0L AS error", "0L AS label_error"), None

    def run(batches):
        for batch in batches:
            at, far, _ = books.nearest(_matrix(batch.column(2), length))
            code = [bytes(r).hex() for r in at.astype(np.uint8)]
            error = [e if e < 1 << 63 else None for e in map(int, far.astype(object).sum(axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded, _ = written(kept.mapInArrow(sparing(run), f"{types}, code string, error long"), "vector-codes")
    # a null label is a key like any other
    keyed = coded.withColumn("_known", F.col("label").isNotNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    by_label = keyed.groupBy("_known", "_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    return hot_join(keyed, by_label, ["_known", "_label"]).select("vec_id", "label", "code", "error", "label_error"), books


def restored(code: Column, books: Codebooks, scale: int = 4096) -> Column:
    """The vector that a code stands for, each component at the middle of its integer's step."""
    parts = [F.array(*[F.array(*[F.lit((x + 0.5) / scale) for x in e]) for e in part]) for part in books.entries]
    return F.flatten(F.array(*[F.element_at(part, F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1) for p, part in enumerate(parts)]))
