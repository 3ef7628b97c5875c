"""SimHash near-dedup with a hierarchical index in Gray order.

Fingerprints: XXH64 (seed 42) of each word shingle, one vote a bit. Equal fingerprints are one entry with its least identifier
before anything is compared, so exact copies and templates cost one row. Entries are dealt by range of their rank in the
reflected Gray code: neighbours there differ in few bits, so a range shares many. The ranges' bounds come from a sample of the
entries (SAMPLE rows at most), chosen by hash, so that an entry has one range for good; each pass works it out anew. A range's node holds the bits that all its
entries agree on (mask, pattern); nodes of 16 form an upper node with fewer shared bits. An entry visits a range only if its
difference from the node, over the node's mask, is within the limit. Inside a range the same tree goes on down to single entries:
differences only grow on the way, so a whole group falls away at the first node that exceeds the limit. This loses no link.

Links found in a task leave it as a spanning forest (at most one row an entry), never as all pairs of a group. Components then
come from rounds of min-label stars over those links, each round written to the shared folder.

`near_duplicates` links fingerprints of 64 bits. `representatives` asks for a likeness instead, a Jaccard of 0.8 of the sets of
five-word shingles, at which a tenth of the bits and more differ; no tree prunes at such a radius. So each of 256 bits (another mix
of the same hashes a lane) is looked at through views: some of the bits, chosen by a fixed rule, with the view's number in front.
The same index over all views' words finds entries that are close in one view and then in all bits; how many bits and views there
are follows from the number of entries and the share of pairs that may be lost. The words are made anew from the fingerprints in
each pass; only routed ones are shuffled, with the CLOSE lanes of their fingerprint that settle whether a meeting counts. Groups found so are compared exactly, set by set:
each member with the group's first one, and who is not alike to that with the whole group, block by block.

Null and empty texts have fingerprint 0, linked like any other. Null identifiers: an entry's least identifier is taken over those
that are not null; rows whose component has none get null. Repeated rows each get a row. An empty table gives no rows. A text of any
length is one row; its shingles take 8 bytes each in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, give_back, hot_join, sparing, spread_join, written

FANOUT = 16
#: Entries of one range, and how many ranges there are at least and at most (their nodes, 24 bytes each, are what every task gets).
#: An entry's visits grow with the square of the logarithm of the number of ranges, so ranges are large and searched as trees.
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 1 << 18, 16, 1 << 17
#: Visiting entries that one task searches in a range; beyond it the range is searched by several tasks.
VISITS = 1 << 18
#: Entries that the bounds of the ranges come from, in all at most (in expectation) and a range.
SAMPLE, RANGE_SAMPLE = 1 << 20, 1 << 10
#: Nodes that a search opens at once, and pairs that it holds before they are folded into labels: what bounds a task's memory in a dense range.
OPEN, HELD = 1 << 14, 1 << 18

#: Shingles and likeness of near-copies, and the share of pairs at exactly that likeness that the views may lose.
WORDS, ALIKE, LOST = 5, 0.8, 0.03
#: Bits of a wide fingerprint that views are made of; its lanes of 64 that are looked at when entries meet in a view, and how many bits of
#: these may differ before texts are compared (those of a pair at ALIKE: 29.1 +- 5.0; of unlike texts: 96 +- 6.9).
WIDE, CLOSE, CLOSE_LIMIT = 256, 3, 46
#: Differing bits within a view, and bits of a view's number, written once more than that.
VIEW_LIMIT, VIEW_BITS = 1, 8
#: Members of a group that one task compares with as many others.
BLOCK = 512


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, repeats included; of the whole sequence where there are fewer words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    body = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    ends = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(body[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)


def _majority(hashes: np.ndarray) -> np.uint64:
    """64 bits, set where more than half of the hashes have them."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text as an unsigned number."""
    return int(_majority(shingle_hashes(text, words, seed)))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(sparing(run), "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Rank of 64 bits in the reflected Gray code, as a long whose signed order is the unsigned order of the ranks."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _gray_ranks(fp: np.ndarray) -> np.ndarray:
    """gray_rank of an array of unsigned fingerprints."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(k))
    return (fp ^ np.uint64(1 << 63)).view(np.int64)


def _range_of(fp: np.ndarray, node: np.ndarray, ranks: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Range of each entry: how many of the bounds (rank, node), in order, do not come after it."""
    rank = _gray_ranks(fp)
    low, high = np.searchsorted(ranks, rank, "left"), np.searchsorted(ranks, rank, "right")
    while len(split := np.flatnonzero(low < high)):  # bounds inside one rank: its entries are parted by node
        middle = (low[split] + high[split]) >> 1
        passed = nodes[middle] <= node[split]
        low[split] = np.where(passed, middle + 1, low[split])
        high[split] = np.where(passed, high[split], middle)
    return low


def _far(entries: np.ndarray, pattern: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.bitwise_count((entries ^ pattern) & mask)


def _levels(entries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the nodes of each level over entries in Gray order, from single entries up to at most FANOUT nodes."""
    ones, zeros = entries, ~entries
    out = [(ones, ones | zeros)]
    while len(ones) > FANOUT:
        at = np.arange(0, len(ones), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        out.append((ones, ones | zeros))
    return out


def _search(levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, limit: int, chunk: int = 1024):
    """Yields (query index, leaf index) arrays of all leaves within the limit; groups that exceed it are left out whole."""
    top = len(levels[-1][0])
    for start in range(0, len(queries), chunk):
        n = len(queries[start : start + chunk])
        rest = [(len(levels) - 1, np.repeat(np.arange(start, start + n), top), np.tile(np.arange(top), n))]
        while rest:
            depth, who, node = rest.pop()
            pattern, mask = levels[depth]
            near = _far(queries[who], pattern[node], mask[node]) <= limit
            who, node = who[near], node[near]
            if not depth:
                yield who, node
                continue
            if len(who) > OPEN:
                rest += [(depth, who[at : at + OPEN], node[at : at + OPEN]) for at in range(0, len(who), OPEN)]
                continue
            who = np.repeat(who, FANOUT)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            inside = node < len(levels[depth - 1][0])
            rest.append((depth - 1, who[inside], node[inside]))


def _fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the least index that each entry is connected to) after linking a with b."""
    while True:
        off = label[a] != label[b]
        if not off.any():
            return label
        a, b = a[off], b[off]
        low = np.minimum(label[a], label[b])
        for x in (label[a], label[b]):
            np.minimum.at(label, x, low)
        while not np.array_equal(nxt := label[label], label):
            label = nxt


def links(entries: DataFrame, limit: int = 2, wide: tuple[str, ...] = (), wide_limit: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """entries: fp and node (what names an entry; fp itself where there is no such column), one row an entry, made of a written table,
    as it is read four times. a, b: nodes whose fp are within the limit of each other, and whose columns `wide` together within
    wide_limit; a forest of each range's finds.
    With `wide`, entries of one fp that are near the first of them in all these bits stand behind it: only it is searched for."""
    spark = entries.sparkSession
    if "node" not in entries.columns:
        entries = entries.select("fp", F.col("fp").alias("node"))
    n = entries.count()
    if not n:
        return entries.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    ranges = int(min(MAX_RANGES, max(MIN_RANGES, -(-n // range_rows))))
    share = min(1.0, min(SAMPLE, RANGE_SAMPLE * ranges) / n)
    chosen = F.pmod(F.xxhash64("fp", "node"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))
    sample = entries.where(chosen).select(gray_rank(F.col("fp")).alias("rank"), "node").toPandas().sort_values(["rank", "node"])  # about SAMPLE rows
    cuts = sample.iloc[np.unique(np.arange(1, ranges) * len(sample) // ranges)] if len(sample) else sample
    bounds = spark.sparkContext.broadcast((cuts["rank"].to_numpy(np.int64), cuts["node"].to_numpy(np.int64)))

    def agree(batches):
        """The bits that all entries of a range have or lack, as far as this task sees them; one row a range."""
        ones = np.full((2, len(bounds.value[0]) + 1), ~np.uint64(0))
        met = np.zeros(ones.shape[1], bool)
        for b in batches:
            if b.num_rows:
                fp = b.column(0).to_numpy().view(np.uint64)
                own = _range_of(fp, b.column(1).to_numpy(), *bounds.value)
                order = np.argsort(own, kind="stable")
                own, at = np.unique(own[order], return_index=True)
                ones[0, own] &= np.bitwise_and.reduceat(fp[order], at)
                ones[1, own] &= np.bitwise_and.reduceat(~fp[order], at)
                met[own] = True
        met = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *[pa.array(x[met].view(np.int64)) for x in ones]], names=["range", "ones", "zeros"])

    seen = entries.select("fp", "node").mapInArrow(sparing(agree), "range int, ones long, zeros long")
    top = seen.groupBy("range").agg(F.bit_and("ones").alias("ones"), F.bit_and("zeros").alias("zeros")).orderBy("range").toPandas()  # at most MAX_RANGES rows
    ids, up = top["range"].to_numpy(), tuple(top[c].to_numpy(np.int64).view(np.uint64) for c in ("ones", "zeros"))
    tree = [(up[0], up[0] | up[1])]
    while len(up[0]) > FANOUT:
        at = np.arange(0, len(up[0]), FANOUT)
        up = np.bitwise_and.reduceat(up[0], at), np.bitwise_and.reduceat(up[1], at)
        tree.append((up[0], up[0] | up[1]))
    sent = spark.sparkContext.broadcast((ids, tree))
    carried = ["fp", "node", *wide]

    def route(batches):
        """An entry goes to its own range, and as a visitor to later ranges that may hold something near it."""
        ids, tree = sent.value
        for b in batches:
            fp = b.column(0).to_numpy()
            own = _range_of(fp.view(np.uint64), b.column(1).to_numpy(), *bounds.value)
            to, who = [], []
            for q, leaf in _search(tree, fp.view(np.uint64), limit):
                later = ids[leaf] > own[q]
                to.append(ids[leaf][later])
                who.append(q[later])
            to, who = np.concatenate([own, *to]), np.concatenate([np.arange(len(fp)), *who]).astype(np.int64)
            visits = np.arange(len(to)) >= len(fp)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(visits), *[pa.array(b.column(k).to_numpy()[who]) for k in range(len(carried))]], names=["range", "visits", *carried])

    routed, routed_at = written(entries.select(*carried).mapInArrow(sparing(route), "range int, visits boolean, " + ", ".join(f"{c} long" for c in carried)), "simhash-routed")
    # ranges with many visitors are searched by several tasks, each with the range's own entries and a share of the visitors
    loads = routed.groupBy("range").agg(F.ceil(F.sum(F.col("visits").cast("long")) / VISITS).cast("int").alias("shares")).where("shares > 1")
    busy = {r["range"]: r["shares"] for r in loads.collect()}  # at most MAX_RANGES rows
    if busy:
        table = spark.createDataFrame(pd.DataFrame({"range": list(busy), "shares": list(busy.values())}), "range int, shares int")
        routed = routed.join(F.broadcast(table), "range", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        routed = routed.withColumn("share", F.explode(F.when(F.col("visits"), F.array(F.pmod(F.xxhash64("fp", "node"), F.col("shares")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("shares") - 1))))
    else:
        routed = routed.withColumn("share", F.lit(0))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, node = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy(np.int64)
        give_back()  # what the group before took
        rank = _gray_ranks(fps)
        visits = pdf["visits"].to_numpy(bool)
        order = np.lexsort((node, rank, visits))  # the range's own entries first, in Gray order
        n = len(order) - int(visits.sum())
        fps, node, full = fps[order], node[order], [pdf[c].to_numpy(np.int64).view(np.uint64)[order] for c in wide]
        searched = pdf["share"].iloc[0] == 0
        del pdf, rank, order, visits

        def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if full:
                near = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int16) for x in full) <= wide_limit
                a, b = a[near], b[near]
            return a, b

        label, leaves = np.arange(len(fps)), np.arange(n)
        if full and n:
            fresh = np.append(True, fps[1:n] != fps[: n - 1])
            behind, first = close(leaves[~fresh], np.maximum.accumulate(np.where(fresh, leaves, 0))[~fresh])
            label[behind] = first
            leaves = np.delete(leaves, behind)
        levels = _levels(fps[leaves])
        held, size = [], 0
        came = np.arange(n, len(fps))
        for asked, own in ((leaves, True), (came, False)):
            if own and not searched:
                continue
            for q, leaf in _search(levels, fps[asked], limit):
                pair = close(asked[q[q < leaf]], leaves[leaf[q < leaf]]) if own else close(asked[q], leaves[leaf])
                held.append(pair)
                size += len(pair[0])
                if size > HELD:
                    label, held, size = _fold(label, *map(np.concatenate, zip(*held, strict=True))), [], 0
        if size:
            label = _fold(label, *map(np.concatenate, zip(*held, strict=True)))
        linked = np.flatnonzero(label != np.arange(len(fps)))
        return pd.DataFrame({"a": node[label[linked]], "b": node[linked]})

    found, _ = written(routed.groupBy("range", "share").applyInPandas(search, "a long, b long"), "simhash-links")
    drop(spark, routed_at)
    return found


def components(found: DataFrame) -> DataFrame:
    """node, component (least node connected to it) for each node of the links (a, b); alternating stars over tables in the shared folder."""
    spark = found.sparkSession
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, at = written(pair(found), "links-0")
    size = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    round_ = 0
    while size[0]:
        round_ += 1
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a star's centre may have most of the links: its rows are not dealt by it
        low, low_at = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"), F.count("*").alias("n")), "links-low")
        # large star: larger neighbours go to the least; small star: smaller neighbours and the node itself do
        large, large_at = written(pair(hot_join(both, low, ["a"], total=2 * size[0]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))), "links-large")
        low2, low2_at = written(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), "links-low")
        small = hot_join(large, low2, ["a"]).select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        new, new_at = written(pair(small), f"links-{round_}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(spark, at, low_at, large_at, low2_at)
        edges, at = new, new_at
        if now == size:
            break
        size = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id: least doc_id that links of at most `limit` differing bits lead to, itself included."""
    fps, _ = written(fingerprints(docs, words, doc_id=doc_id, text=text), "simhash-fingerprints")
    entries, entries_at = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-entries")
    comps = components(links(entries.select("fp", F.col("fp").alias("node")), limit))
    groups = entries.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    final, _ = written(groups.join(least, "component").select("fp", "component_id", "n"), "simhash-components")
    drop(docs.sparkSession, entries_at)
    return hot_join(fps, final, ["fp"]).select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; texts without words share one."""
    hashes = np.unique(shingle_hashes(text, words))
    return hashes if len(hashes) else np.zeros(1, np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> list[np.uint64]:
    """WIDE bits: each lane of 64 takes its votes from another mix of the hashes."""
    out = []
    for k in range(WIDE // 64):
        mixed = hashes
        if k:
            mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(xxhash.xxh64_intdigest(str(k).encode(), 42) | 1)
            mixed = mixed ^ (mixed >> np.uint64(32))
        out.append(_majority(mixed))
    return out


def views(n: int, alike: float = ALIKE, lost: float = LOST) -> list[np.ndarray]:
    """Which bits each view of n entries takes. Each has so many bits that few of n unlike entries meet in it; there are so many views
    that of pairs at `alike` (which differ in a bit with the chance of the angle between their sets) only a share `lost` meets in none."""
    p = math.acos(2 * alike / (1 + alike)) / math.pi
    differ = np.array([math.comb(WIDE, d) * p**d * (1 - p) ** (WIDE - d) for d in range(WIDE + 1)])
    most, bits = (1 << VIEW_BITS) - 1, max(12, math.ceil(math.log2(max(n, 2))) + 2)
    while True:
        meets = np.array([sum(math.comb(d, k) * math.comb(WIDE - d, bits - k) for k in range(VIEW_LIMIT + 1)) / math.comb(WIDE, bits) for d in range(WIDE + 1)])
        count = next((c for c in range(1, most + 1) if differ @ (1 - meets) ** c <= lost), 0)
        if count:
            break
        bits -= 1
    rng = np.random.default_rng(42)
    return [rng.permutation(WIDE)[:bits] for _ in range(count)]


def view_words(lanes: list[np.ndarray], seen: list[np.ndarray]) -> np.ndarray:
    """A word of 64 bits for each view (rows) and entry (columns): the view's number, once more than VIEW_LIMIT, so that words of two
    views are never within it, then the view's bits."""
    bits = np.unpackbits(np.stack(lanes, axis=1).view(np.uint8).reshape(len(lanes[0]), -1), axis=1, bitorder="little")
    out = np.zeros((len(seen), len(lanes[0])), np.uint64)
    for v, at in enumerate(seen):
        for k, place in enumerate(at):
            out[v] |= bits[:, place].astype(np.uint64) << np.uint64(k)
        for k in range(VIEW_LIMIT + 1):
            out[v] |= np.uint64(v) << np.uint64(64 - VIEW_BITS * (k + 1))
    return out


def candidates(rows: DataFrame, words: int = WORDS, alike: float = ALIKE) -> DataFrame:
    """rows: at, text, a written table. at, group: rows that the index connects to others, by wide fingerprints."""
    spark = rows.sparkSession
    lanes = [f"w{k}" for k in range(WIDE // 64)]
    longs = ", ".join(f"{c} long" for c in lanes)

    def sign(batches):
        for batch in batches:
            fps = [wide_fingerprint(np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words))) for t in batch.column(1)]
            if fps:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*fps, strict=True)]], names=["at", *lanes])

    fps, fps_at = written(rows.select("at", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(sparing(sign), f"at long, {longs}"), "simhash-wide")
    entries, entries_at = written(fps.groupBy(*lanes).agg(F.min("at").alias("node"), F.count("*").alias("rows")), "simhash-entries")
    n = entries.count()
    seen = views(n, alike)
    # as many parts as there will be ranges of words, as each entry becomes a word a view
    spread, spread_at = written(entries.select("node", *lanes).repartition(max(MIN_RANGES, -(-n * len(seen) // RANGE_ROWS)), "node"), "simhash-spread")
    close = lanes[:CLOSE]

    def look(batches):
        for batch in batches:
            if batch.num_rows:
                out = view_words([batch.column(1 + k).to_numpy().view(np.uint64) for k in range(len(lanes))], seen)
                many = [pa.array(np.tile(c.to_numpy(), len(seen))) for c in batch.columns[: 1 + CLOSE]]
                yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), *many], names=["fp", "node", *close])

    found = links(spread.mapInArrow(sparing(look), f"fp long, node long, {', '.join(f'{c} long' for c in close)}"), VIEW_LIMIT, tuple(close), CLOSE_LIMIT)
    drop(spark, spread_at)
    grouped, grouped_at = written(entries.join(components(found), "node", "left").select(*lanes, "rows", F.coalesce("component", "node").alias("group")), "simhash-grouped")
    several = grouped.groupBy("group").agg(F.sum("rows").alias("rows")).where("rows > 1")
    kept, kept_at = written(grouped.join(several.select("group"), "group", "left_semi"), "simhash-kept")
    members, _ = written(spread_join(fps, kept, lanes, "at", "rows").select("at", "group"), "simhash-members")
    drop(spark, fps_at, entries_at, grouped_at, kept_at)
    return members


def _alike(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of left with right whose Jaccard is at least `least`."""
    sizes = np.array([len(s) for s in right])
    ids = np.unique(np.concatenate(right))
    flat, starts = np.searchsorted(ids, np.concatenate(right)), np.cumsum(sizes) - sizes
    mark, a, b = np.zeros(len(ids) + 1, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, s in enumerate(left):
        own = np.searchsorted(ids, s)
        own = own[ids[np.minimum(own, len(ids) - 1)] == s]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        hit = np.flatnonzero(both >= least * (len(s) + sizes - both) - 1e-9)
        a.append(np.full(len(hit), i))
        b.append(hit)
        mark[own] = 0
    return np.concatenate(a), np.concatenate(b)


def alike_links(rows: DataFrame, words: int = WORDS, alike: float = ALIKE, block: int = BLOCK) -> DataFrame:
    """rows: at, text, a written table. a, b: rows (by `at`) of one group of candidates whose Jaccard is at least `alike`; links
    enough to connect what is connected, not all pairs: two rows that are alike to the group's first one are not compared."""
    spark = rows.sparkSession
    members = candidates(rows, words, alike)

    def cut(batches):
        for batch in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", words).view(np.int64) for t in batch.column(2)]
            if sets:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets)))], names=["at", "group", "shingles"])

    texts = rows.join(members, "at").select("at", "group", F.col("text").cast("string").cast("binary").alias("text"))
    sets, sets_at = written(texts.mapInArrow(sparing(cut), "at long, group long, shingles array<long>"), "simhash-shingles")
    firsts = members.groupBy("group").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    centre, centre_at = written(sets.join(firsts, ["group", "at"]).select("group", F.col("at").alias("first"), F.col("shingles").alias("first_shingles"), "n"), "simhash-centres")
    both = F.size(F.array_intersect("shingles", "first_shingles"))
    near = both >= F.lit(alike) * (F.size("shingles") + F.size("first_shingles") - both) - F.lit(1e-9)
    judged, judged_at = written(spread_join(sets, centre, ["group"], "at").select("at", "group", "first", "shingles", near.alias("near")), "simhash-judged")
    drop(spark, sets_at, centre_at)

    loads = judged.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("near")) / block).cast("int").alias("chunks"), F.count("*").alias("n")).where("chunks > 0")
    loads, loads_at = written(loads, "simhash-loads")
    left = spread_join(judged, loads, ["group"], "at").select("at", "group", "shingles", "near", "blocks", "chunks", F.xxhash64("at").alias("h"))
    asked = left.where(~F.col("near")).select("at", "group", "shingles", F.lit(True).alias("asks"), F.pmod("h", "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    there = left.select("at", "group", "shingles", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod("h", "blocks").cast("int").alias("block"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        at, sets, asks = pdf["at"].to_numpy(np.int64), [np.asarray(s, np.int64).view(np.uint64) for s in pdf["shingles"]], pdf["asks"].to_numpy(bool)
        one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(one) or not len(two):
            return pd.DataFrame({"a": at[:0], "b": at[:0]})
        a, b = _alike([sets[k] for k in one], [sets[k] for k in two], alike)
        names, place = np.unique(at, return_inverse=True)
        label = _fold(np.arange(len(names)), place[one[a]], place[two[b]])
        linked = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"a": names[label[linked]], "b": names[linked]})

    # dealt by all three: left to itself, Spark would keep the blocks of a group together, as the join above did
    rest = asked.unionByName(there).repartition("group", "chunk", "block").groupBy("group", "chunk", "block").applyInPandas(compare, "a long, b long")
    found, _ = written(judged.where("near and at <> first").select(F.col("first").alias("a"), F.col("at").alias("b")).unionByName(rest), "simhash-alike")
    drop(spark, judged_at, loads_at)
    return found


def representatives(docs: DataFrame, words: int = WORDS, alike: float = ALIKE, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without near-copies: of each group that links of at least `alike` lead through, the row with the least identifier stays
    (null identifiers last; of repeated rows with one identifier, one); same columns. Rows are named by arrival."""
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))
    arrived, _ = written(docs.select(F.struct("*").alias("row"), key.alias("key"), F.monotonically_increasing_id().alias("at")), "simhash-arrivals")
    groups = components(alike_links(arrived.select("at", F.col("row")[text].alias("text")), words, alike, block)).withColumnRenamed("node", "at")
    named, _ = written(arrived.select("at", "key").join(groups, "at"), "simhash-groups")
    first = named.groupBy("component").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("n"))
    gone = hot_join(named, first, ["component"]).where("at <> first.at").select("at")
    return arrived.join(gone, "at", "left_anti").select("row.*")
