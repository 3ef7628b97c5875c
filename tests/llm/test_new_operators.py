"""Prefix trie, attention quality and vector codes: brute force, gradients, edges, held-out rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidepanel.llm import attention_quality, prefix_trie, queries, toxicity, vector_codes
from tidepanel.llm.shared import labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, digest string, depth string, n string, at string"
VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, x string"


def brute_trie(convs):
    """convs: {conv_id: [(role, text), ...]} -> {sequence: columns}."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    out = {}
    for s, cs in members.items():
        below = [t for t in members if t[: len(s)] == s]
        words = lambda t: len(WORD.findall(t[-1][1])) if t else 0
        out[s] = (
            cs[0], len(s), members[s[:-1]][0] if s else None, len(cs), sum(len(t) == len(s) + 1 for t in below), sum(not any(u[: len(t)] == t and len(u) > len(t) for u in members) for t in below),
            sum((len(members[t]) - 1) * words(t) for t in below), hashlib.sha256(",".join(str(c) for c in cs if len(convs[c]) == len(s)).encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(spark, convs):
    rows = [(c, k, r, t, *["x"] * 4) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TURNS).repartition(5)


@pytest.mark.parametrize(("shard", "piece"), [(1 << 17, 1 << 14), (20, 8)])
def test_trie_by_brute_force(spark, monkeypatch, shard, piece):
    """Shared beginnings, a beginning and an end that most have, one long conversation, shards and pieces of a few rows."""
    rng = random.Random(2)
    say = lambda: (rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "", "d  e\nf"]))
    convs = {c: [say() for _ in range(rng.randint(1, 5))] for c in range(-3, 120)}
    convs |= {c: [("user", "hi there"), ("assistant", "ok")] for c in range(200, 320)}
    convs[500] = [("user", str(k)) for k in range(150)]
    parts = prefix_trie._chains, prefix_trie._pieces
    if shard == 20:
        # set inside the workers: they import the module anew
        def chains(batches):
            prefix_trie.SHARD_RECORDS = shard
            yield from parts[0](batches)

        def pieces(batches):
            prefix_trie.PIECE = piece
            yield from parts[1](batches)

        monkeypatch.setattr(prefix_trie, "_chains", chains)
        monkeypatch.setattr(prefix_trie, "_pieces", pieces)
    assert plain(prefix_trie.prefix_trie(conversations(spark, convs))) == brute_trie(convs)


def test_trie_query_rebuilds_by_brute_force(spark, data):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    head = {c: zlib.crc32(str(c).encode()) % 4 for c in rows}
    convs = {c: rows.get(c - c % 20, [])[: head[c]] + rows[c][head[c] :] for c in rows}
    assert plain(queries.op11_prefix_trie(spark, data)) == brute_trie(convs)


def test_trie_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "user", "lost"), (2, None, "", ""), (3, 5, "user", "word " * 200_000)]
    d = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], TURNS)
    want = brute_trie({1: [("", ""), ("user", "x"), ("user", "x")], 2: [("", "")], 3: [("user", "word " * 200_000)]})
    assert plain(prefix_trie.prefix_trie(d)) == want
    assert prefix_trie.prefix_trie(d.limit(0)).count() == 0
    # every turn of 21 is replaced, and its base has none: a conversation without turns is still one
    turns = prefix_trie.records(spark.createDataFrame([(21, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    out = prefix_trie.trie(prefix_trie.with_borrowed_heads(turns, F.lit(3), F.col("conv_id") - 1, 3)).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_leaves"], r["ends_sha256"]) for r in out] == [(21, 0, 1, 1, hashlib.sha256(b"21").hexdigest())]


def test_slots_are_minimal_perfect_and_checked():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, (5000, 2), np.uint64).view(prefix_trie.PAIR).ravel())
    slots = prefix_trie.Slots(keys)
    assert sorted(slots(keys).tolist()) == list(range(len(keys)))
    assert (slots.digests[slots(keys)] == keys).all()
    strange = keys.copy()
    strange["b"] ^= np.uint64(1 << 40)
    assert (slots(strange) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.concatenate([keys[:3], keys[:1]]))


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, integer vector)."""
    width = len(rows[0][1]) // parts
    first = sorted(dict(sorted(rows, key=lambda r: (r[0], r[1]), reverse=True)).items())[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v in first] for p in range(parts)]
    far = lambda u, v: sum((a - b) ** 2 for a, b in zip(u, v, strict=True))
    near = lambda v: [min((far(v[p * width : (p + 1) * width], e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        took = defaultdict(list)
        for _, v in rows:
            for p, (_, k) in enumerate(near(v)):
                took[p, k].append(v[p * width : (p + 1) * width])
        for (p, k), vs in took.items():
            books[p][k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return [("".join(f"{k:02x}" for _, k in near(v)), sum(f for f, _ in near(v))) for _, v in rows], books


def test_vector_codes_by_brute_force(spark):
    """Null, unknown and infinite components go; ties, repeated ids, null ids and labels, huge components, clashing names."""
    rng = random.Random(4)
    vectors = [(k % 50, [rng.choice([-1.5, -0.25, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(120)]
    vectors += [(60, [3e6] * 8 + [-3e6] * 8, 7), (61, [1e-9] * 16, None)]
    vectors = [(i, np.float32(v).tolist(), label) for i, v, label in vectors]
    bad = [(0, None, 1), (1, [None] + [0.0] * 15, 1), (2, [float("nan")] + [0.0] * 15, 1), (3, [float("-inf")] + [0.0] * 15, 2)]
    out, books = vector_codes.compress(spark.createDataFrame([(*r, "x", "y", "z") for r in vectors + bad], VECTORS).repartition(4))
    want, entries = brute_codes([(i, [int(np.floor(4096 * x)) for x in v]) for i, v, _ in vectors])
    sums = defaultdict(int)
    for (_, _, label), (_, error) in zip(vectors, want, strict=True):
        sums[label] += error
    expected = sorted(((i, label, code, error, sums[label]) for (i, _, label), (code, error) in zip(vectors, want, strict=True)), key=repr)
    assert plain(out) == expected and books.entries == entries
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in entries for e in p for x in e).encode()).hexdigest()


def test_vector_codes_edges(spark):
    make = lambda *rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    empty, books = vector_codes.compress(make((1, None, 2)))
    assert books is None and empty.count() == 0 and empty.columns == ["vec_id", "label", "code", "error", "label_error"]
    # fewer rows than entries; lengths that differ or are no multiple of eight are filled up; an empty vector
    out, books = vector_codes.compress(make((2, [1.0, 2.0, 3.0], 1), (None, [1.0], None), (5, [], None)))
    assert [len(p) for p in books.entries] == [3] * 8 and {(r["vec_id"], r["error"], r["label_error"]) for r in out.collect()} == {(2, 0, 0), (None, 0, 0), (5, 0, 0)}
    out, _ = vector_codes.compress(make((1, [], None), (1, [], 3)))
    assert [(r["code"], r["error"]) for r in out.collect()] == [("00" * 8, 0)] * 2
    # what no long holds: saturated components, an unknown error
    out, _ = vector_codes.compress(make((1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)), entries=1)
    assert {r["vec_id"]: r["error"] for r in out.collect()} == {1: None, 2: None}


def test_codes_restore_what_they_stand_for(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    out, books = vector_codes.compress(vectors)
    rows = out.join(vectors, "vec_id").select("embedding", "error", vector_codes.restored(F.col("code"), books).alias("back")).collect()
    for r in rows:
        far = sum((a - b) ** 2 for a, b in zip(r["embedding"], r["back"], strict=True))
        assert far == pytest.approx(r["error"] / 4096**2, abs=64 * 2 * 3 / 4096)


def test_sliced_search_is_exact_from_any_radius():
    rng = np.random.default_rng(5)
    book, x = rng.integers(-50, 50, (64, 5)), rng.integers(-70, 70, (500, 5))
    far = ((x[:, None] - book) ** 2).sum(axis=2)
    for radius in (1, 20, 500):
        at, best = vector_codes.SlicedBook(book, radius).nearest(x)
        assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    box = vector_codes.SlicedBook(book).candidates(x, np.full(len(x), 30))
    inside = (np.abs(x[:, None] - book) <= 30).all(axis=2)
    assert all(int(m) == sum(1 << int(k) for k in np.flatnonzero(row)) for m, row in zip(box, inside, strict=True))


def test_attention_gradients():
    rng = np.random.default_rng(1)
    a = attention_quality
    w = {"encode": rng.normal(0, 0.3, (7, a.CODE)), "shift": rng.normal(0, 0.3, a.CODE), "look": rng.normal(0, 0.3, (a.CODE, a.GATE)), "gate": rng.normal(0, 0.3, (a.CODE, a.GATE)), "weigh": rng.normal(0, 1, a.GATE), "judge": rng.normal(0, 1, a.CODE), "bias": np.array(0.2)}
    x, start, y = rng.normal(0, 1, (11, 7)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 0, 1])
    _, g = a.gradients(w, x, start, y)
    for k, v in w.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(4)]:
            def loss(step, k=k, at=at, v=v):
                moved = v.copy()
                moved[at] += step
                return a.gradients(w | {k: moved}, x, start, y)[0]

            assert g[k][at] == pytest.approx((loss(1e-5) - loss(-1e-5)) / 2e-5, abs=1e-7)


def test_attention_finds_the_passage_that_spoils(monkeypatch):
    rng = random.Random(6)
    sentence = lambda: " ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(80)) + "."
    make = lambda bad: "".join(p.ljust(512)[:512] for p in [sentence() if k != bad else "BUY!! NOW!! " * 50 for k in range(6)])
    texts = [make(k % 6 if k % 3 == 0 else None) for k in range(300)]
    labels = [int(k % 3 != 0) for k in range(300)]
    model = attention_quality.fit(texts, labels)
    fresh = [make(2) for _ in range(20)] + [make(None) for _ in range(20)]
    scores = model(fresh)
    assert scores[:20].max() < 0.5 < scores[20:].min()
    assert model.attention(fresh[0]).argmax() == 2 and model.attention(fresh[0]).sum() == pytest.approx(1)
    # pieces of passages change nothing
    monkeypatch.setattr(attention_quality, "PIECE", 4)
    assert model(fresh) == pytest.approx(scores)


def test_attention_quality_on_held_out_rows(spark):
    at = DATA.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect() if r["quality"] is not None}
    rows = [r for r in queries.op12_attention_quality(spark, at).collect()]
    assert len(rows) == spark.read.parquet(f"{at}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, poor = [r for r in held if labels[r["doc_id"]]], [r for r in held if not labels[r["doc_id"]]]
    assert np.mean([r["predicted"] for r in good]) >= 0.98 and np.mean([1 - r["predicted"] for r in poor]) >= 0.95


def test_attention_edges(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "word " * 100_000), (4, "word " * 100_000), (None, "no id"), (5, "x" * 300_000)]
    d = spark.createDataFrame([(i, t, "s", "s") for i, t in texts], "doc_id long, text string, score string, own string")
    model = attention_quality.fit(["Good words here." * 5, "BAD!! " * 9] * 20, [1, 0] * 20)
    got = attention_quality.score(d, model).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert attention_quality.score(d.limit(0), model).count() == 0
    assert attention_quality.fit([], [])(["x"]) == [0.5] and attention_quality.fit(["x"], [1])(["y"]) == [1.0]


def test_a_sample_passes_over_what_does_not_fit(spark):
    """One giant text, wherever its hash puts it, leaves the others in; an empty sample is said aloud."""
    docs = spark.createDataFrame([(k, "giant " * 1000 if k == 7 else f"text {k}") for k in range(20)] + [(3, "copy")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(3, 0), (None, 1), (30, 1)], "doc_id long, toxic int")
    for most in (1000, 7 * 19):
        texts, known = labelled_sample(docs, labels, "toxic", 100, most)
        assert texts == [t for k in range(20) if k != 7 for t in ["copy" if k == 3 else f"text {k}"]] and known == [k % 2 for k in range(20) if k != 7]
    texts, _ = labelled_sample(docs, labels, "toxic", 5, 1 << 20)
    assert 4 <= len(texts) <= 5
    with pytest.warns(UserWarning, match="no labelled text"):
        assert labelled_sample(docs, labels.limit(0), "toxic", 100, 1000) == ([], [])


def test_toxicity_query_scores_as_the_scorer(spark, data):
    """The registered query's scores are those of the model fitted from the same rows, text by text."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r["doc_id"]: int(r["toxic"] != 0) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r["toxic"] is not None and r["doc_id"] in texts}
    learn = [i for i in sorted(labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    scorer = toxicity.Scorer(toxicity.fit([texts[i] for i in learn], [labels[i] for i in learn]))
    got = {r["doc_id"]: r["score"] for r in queries.op5_toxicity(spark, data).collect()}
    assert got == {i: pytest.approx(scorer([t])[0], abs=1e-9) for i, t in texts.items()}
