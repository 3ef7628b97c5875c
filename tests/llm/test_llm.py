"""The text operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.oracle import connect, same
from tidepanel.llm import bpe, chat, exact_dedup, packing, pii, quality, queries, sharding, simhash, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six seven eight nine ten"), (4, "one two three four five six seven eight nine ten"), (None, "no id"), (5, "é " * 4000), (6, "word " * 30), (7, "ab" * 500_000), (8, "0" * 5000 + ".1.1.1 " + "x y " * 20_000), (9, "no\xa0 \xa0break \u3000\u3000 wide \xa0")]
DDL = "doc_id long, text string, kept string, shard string, keep_id string, fp string, row string, score string, `start` string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those the operators make."""
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in EDGE], DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, data, name):
    same(queries.QUERIES[name](spark, data), connect(data), queries.ORACLES[name])


def trained(seed=2):
    """A model of three made-up insults, and a maker of texts with and without them."""
    made, rng = ["zorglub", "krapfen", "muffluk"], random.Random(seed)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(3, 8)))
    make = lambda bad: ". ".join(" ".join([*[word() for _ in range(6)], *([rng.choice(made)] if bad and k == 1 else [])]) for k in range(3))
    return toxicity.fit(*map(list, zip(*[(make(k % 4 == 0), int(k % 4 == 0)) for k in range(400)], strict=True))), make


def test_every_operator_on_edges_and_empty_tables(edge, empty):
    path, model = queries.tokenizer_path, trained()[0]
    chats = lambda d: chat.format_chats(d.select(F.col("doc_id").alias("conv_id"), F.col("fp").alias("role"), F.lit(0).alias("turn"), chat.text_part(F.col("text")).alias("parts"), "row", "score"))
    assert chats(empty).count() == 0
    out = chats(edge).select("conv_id", F.size(chat.read_back(F.col("formatted"))).alias("n")).collect()
    assert sum(r["n"] for r in out) == len(EDGE) and len(out) == len({i for i, _ in EDGE})
    runs = {
        "exact": lambda d: exact_dedup.deduplicate(d).select("row.doc_id", "keep_id", "group_size", "kept"),
        "simhash": simhash.near_duplicates,
        "pack": lambda d: packing.pack_documents(d, path("byte_bpe_50k.json")),
        "pii": pii.search,
        "quality": lambda d: quality.judged(d).select("row.doc_id", "kept"),
        "bpe": lambda d: bpe.decode(bpe.encode(d, path("word_bpe_49k.json")), path("word_bpe_49k.json")),
        "substring": substring.remove_repeats,
        "shard": sharding.shard_by_bytes,
        "toxicity": lambda d: toxicity.score(d, toxicity.fit([], [])),
        "toxicity, fitted": lambda d: toxicity.score(d, model),
    }
    for name, run in runs.items():
        assert run(empty).count() == 0, name
        n = run(edge).count()
        assert n >= len(EDGE) if name == "pack" else n == len(EDGE), name
    for keep in (quality.kept_documents, exact_dedup.kept_documents, simhash.representatives, pii.redact):
        assert keep(edge).columns == edge.columns and keep(empty).count() == 0


def test_exact_dedup_keeps_texts_apart_when_digests_collide(spark):
    d = spark.createDataFrame([(3, "a  b"), (1, "a b"), (2, "c d"), (4, None), (5, "")], "doc_id long, text string")
    out = exact_dedup.deduplicate(d, digest=lambda t: F.lit("same")).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out} == {(1, 1, 2, True), (3, 1, 2, False), (2, 2, 1, True), (4, 4, 2, True), (5, 4, 2, False)}


def test_later_arrivals_meet_earlier_ones(spark, tmp_path):
    """Calls with one store: each sees what came before, its bytes too; without new rows nothing changes."""
    store = f"file://{tmp_path}/store"
    table = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda d, digest=exact_dedup.sha256: {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(d, digest=digest, store=store).select("row.doc_id", "keep_id", "group_size", "kept").collect()}
    assert run(table((7, "x y"), (9, "z"))) == {(7, 7, 1, True), (9, 9, 1, True)}
    assert run(table((8, "x  y"), (3, "z"))) == {(8, 7, 2, False), (3, 3, 2, True)}
    assert run(table()) == set()
    assert run(table((1, "new"), (10, "z"))) == {(1, 1, 1, True), (10, 3, 3, False)}
    assert exact_dedup.kept_documents(table((11, "new"), (12, "newer")), store=store).collect() == [(12, "newer")]
    other = f"file://{tmp_path}/other"
    same = lambda d: {(r["doc_id"], r["keep_id"]) for r in exact_dedup.deduplicate(d, digest=lambda t: F.lit("same"), store=other).select("row.doc_id", "keep_id").collect()}
    assert same(table((5, "a"))) == {(5, 5)} and same(table((6, "b"), (4, "a"))) == {(6, 6), (4, 4)}


def test_a_table_delivered_twice_keeps_nothing_twice(spark, tmp_path):
    """Under another name all of it is a copy; under its own name, as a retry, it is judged as before and counts once."""
    store = f"file://{tmp_path}/store"
    table = spark.createDataFrame([(k, f"text {k % 7}") for k in range(40)], "doc_id long, text string").repartition(3)
    run = lambda d, batch=None: {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(d, store=store, batch=batch).select("row.doc_id", "keep_id", "group_size", "kept").collect()}
    size = lambda k, n: (5 + (k % 7 < 5)) * n
    first = {(k, k % 7, size(k, 1), k < 7) for k in range(40)}
    assert run(table, "monday") == first
    assert run(table, "monday") == first
    assert run(table.repartition(5), "tuesday") == {(k, k % 7, size(k, 2), False) for k in range(40)}
    assert exact_dedup.kept_documents(table, store=store).count() == 0
    import os

    assert len(os.listdir(f"{tmp_path}/store/arrivals")) == 3
    assert len([n for n in os.listdir(f"{tmp_path}/store/snapshots") if n.startswith("upto")]) == 1 and not [n for n in os.listdir(f"{tmp_path}/store/log") if n.startswith("batch")]
    # a call whose write broke off: its folder has no mark of an end
    new = spark.createDataFrame([(100, "text 1"), (101, "other")], "doc_id long, text string")
    os.makedirs(f"{tmp_path}/store/arrivals/call=00000009-{exact_dedup.call_name('friday')}")
    assert run(new, "friday") == {(100, 1, 19, False), (101, 101, 1, True)}


def test_many_hits_are_matched_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_MOST", 3)
    d = spark.createDataFrame([(k, f"text {k % 9}") for k in range(30)], "doc_id long, text string")
    out = exact_dedup.deduplicate(d, digest=lambda t: F.substring(t, 1, 6)).select("row.doc_id", "keep_id", "kept").collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in out} == {(k, k % 9, k < 9) for k in range(30)}


def brute_fp(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum((sum((h >> b) & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def brute_components(fps, limit=2):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, data, texts):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op2_simhash_dedup(spark, data).collect()}
    fps = {i: brute_fp(t) for i, t in texts.items()}
    assert {i: g[0] for i, g in got.items()} == fps
    assert {i: g[1] for i, g in got.items()} == brute_components(fps)


def test_simhash_links_chains_across_ranges(spark):
    rng = random.Random(5)
    fps, x = {}, rng.getrandbits(64)
    for i in range(600):
        x = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) if i % 7 else rng.getrandbits(64)
        fps[i] = x
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    entries = spark.createDataFrame([(signed(v),) for v in set(fps.values())], "fp long")
    comp = {r["node"]: r["component"] for r in simhash.components(simhash.links(entries, 2, range_rows=16)).collect()}
    brute = brute_components(fps)
    groups = defaultdict(set)
    for i, c in brute.items():
        groups[c].add(comp.get(signed(fps[i]), signed(fps[i])))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_ranges_part_hot_fingerprints_by_node():
    """Bounds inside one rank: each entry's range is the number of bounds (rank, node) that do not come after it."""
    rng = np.random.default_rng(2)
    fp, node = rng.choice(rng.integers(0, 1 << 64, 6, np.uint64), 500), rng.integers(-50, 50, 500)
    rank = simhash._gray_ranks(fp)
    cuts = sorted(zip(rank[:40].tolist(), node[:40].tolist(), strict=True))
    got = simhash._range_of(fp, node, *(np.array(x, np.int64) for x in zip(*cuts, strict=True)))
    assert got.tolist() == [sum(c <= e for c in cuts) for e in zip(rank.tolist(), node.tolist(), strict=True)]
    assert simhash._range_of(fp, node, np.zeros(0, np.int64), np.zeros(0, np.int64)).max() == 0


def test_one_fingerprint_of_many_nodes_spans_ranges(spark):
    """Entries of one view word are parted over ranges and still linked, if their other bits are near."""
    same = [(5, k, 0, 0) for k in range(300)] + [(5, 1000 + k, -1, -1) for k in range(300)]
    entries = spark.createDataFrame(same, "fp long, node long, w0 long, w1 long")
    comp = {r["node"]: r["component"] for r in simhash.components(simhash.links(entries, 1, ("w0", "w1"), 32, range_rows=20)).collect()}
    assert comp == {k: 0 for k in range(300)} | {1000 + k: 1000 for k in range(300)}


def test_chat_parts_and_reversible_escapes(spark):
    part = lambda **k: {n: k.get(n) for n in ("kind", "text", "ref", "width", "height", "millis", "pages")}
    nasty = "&lt;| <|im_end|>\n &amp; <|image:0|>"
    rows = [
        (1, 0, "user", [part(kind="text", text="look "), part(kind="image", ref="a.png", width=57, height=28), part(kind="audio", ref="b.wav", millis=161)]),
        (1, 1, "assistant", [part(kind="text", text=nasty)]),
        (1, 2, "user", [part(kind="document", ref="c.pdf", pages=2), part(kind=None, text="t"), part(kind="text", text=None)]),
        (2, 0, None, None),
    ]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).select("*", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(a["n"], a["kind"], a["ref"], a["tokens"]) for a in out[1]["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 3), (2, "document", "c.pdf", 512)]
    assert out[1]["expanded_tokens"] == 518 and out[1]["loss"] == nasty
    assert "look <|image:0|><|audio:1|><|im_end|>" in out[1]["formatted"] and "<|document:2|>t<|im_end|>" in out[1]["formatted"]
    assert out[2]["formatted"] == "<|im_start|>\n<|im_end|>\n"


def test_a_long_conversation_is_formatted_in_order(spark):
    """Thousands of turns, attachments among them: numbers and spans go on through all."""
    part = lambda **k: {n: k.get(n) for n in ("kind", "text", "ref", "width", "height", "millis", "pages")}
    n = 5000
    rows = [(1, k, "assistant" if k % 2 else "user", [part(kind="text", text=f"say {k}"), *([part(kind="audio", ref=f"a{k}", millis=80)] if k % 10 == 0 else [])]) for k in range(n)]
    random.Random(3).shuffle(rows)
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").repartition(3)).first()
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == [f"say {k}" for k in range(1, n, 2)]
    assert [(a["n"], a["ref"]) for a in r["attachments"]] == [(k // 10, f"a{k}") for k in range(0, n, 10)]
    assert r["formatted"].count("<|audio:") == n // 10 and f"say 4990<|audio:{n // 10 - 1}|>" in r["formatted"]


def test_packing_is_whole_and_tight(spark, data, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in queries.op4_pack_sequences(spark, data).collect():
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for cells in seqs.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for c in seqs.values() for _, n in c)
    assert len(seqs) <= -(-total // 1024) + 4


def test_packing_balances_cost():
    rng = random.Random(1)
    pieces, n = packing.pack([rng.randint(1, 1023) for _ in range(2000)], 1024, 1.0, 1 / 2048)
    cost = Counter()
    for _, _, length, s, _ in pieces:
        cost[s] += packing.cost(length, 1.0, 1 / 2048)
    spread = sorted(cost.values())
    assert len(cost) == n and spread[-1] < 1.5 * spread[len(spread) // 2]


ODD = ["", " ", "  ", "a  b", "a \n b", "foo\n  bar ", "x<|endoftext|> y", "İstanbul ΑΣ Σ", "a\x1cb c\x1f", "don't I'LL we've", "½ 12345 ²", "日本語 テスト　全角", "😀 hi", "aaaaaaaa aaa", "\xa0 x", "<|startoftext|>Hi<|endoftext|>", "é é", "ǅ ﬁ ẞ", "\x00 z", "a \xa0 \xa0 b", "Price:\xa0 \xa0 \xa0 5", "x \xa0 \xa0", "全\u3000\u3000 角 \u3000"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(texts, name):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    some = [*list(texts.values())[:60], *ODD, *["".join(rng.choices(list("ab cd\n's.,ÉéßΣσ́ 12½🎉<|"), k=rng.randint(1, 60))) for _ in range(800)]]
    lib = Tokenizer.from_file(queries.tokenizer_path(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(some, add_special_tokens=False)]
    ours = packing.Ids(queries.tokenizer_path(name)) if name.startswith("byte") else bpe.Encoder(queries.tokenizer_path(name))
    assert ours(some) == want


def test_packing_ids_among_white_space_of_all_kinds():
    """Blanks between other white space, at ends and around special tokens: the library takes a run as one word."""
    from tokenizers import Tokenizer

    rng = random.Random(11)
    space = [" ", " ", " ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000", "\ufeff"]
    pool = [*space, *space, "a", "b c", "É", "ß", "7", "½", "'s", ".", "é", "日", "😀", "<|endoftext|>", "Word"]
    some = ["".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(100_000)]
    lib = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    ours = packing.Ids(queries.tokenizer_path("byte_bpe_50k.json"))
    for at in range(0, len(some), 20_000):
        part = some[at : at + 20_000]
        assert ours(part) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(part, add_special_tokens=False)]


def test_packing_takes_the_cheapest_sequence_with_room():
    """Against a search of all sequences for each document."""
    rng = random.Random(12)
    for sizes in ([rng.randint(1, 100) for _ in range(300)], [60] * 50 + [7] * 90, [1] * 500):
        pieces, n = packing.pack(sizes, 100, 1.0, 0.01)
        room, spent, want = [100] * n, [0.0] * n, {}
        full = sum(s // 100 for s in sizes)
        for size, d in sorted((-(s % 100), d) for d, s in enumerate(sizes) if s % 100):
            fits = [(spent[k], k) for k in range(full, n) if room[k] >= -size]
            if fits:
                k = min(fits)[1]
                want[d, sizes[d] // 100 * 100] = k
                room[k] += size
                spent[k] += packing.cost(-size, 1.0, 0.01)
        got = {(d, start): s for d, start, length, s, _ in pieces}
        assert all(got[k] == s for k, s in want.items()) and sum(p[2] for p in pieces) == sum(sizes)


def test_bpe_query_decodes_as_the_library(spark, data, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op8_bpe_roundtrip(spark, data).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_toxicity_on_held_out_rows(spark, data):
    model, make = trained()
    score = toxicity.Scorer(model)
    clean, toxic = score([make(False) for _ in range(100)]), score([make(True) for _ in range(100)])
    assert min(toxic) > 0.3 > np.quantile(clean, 0.97)
    assert min(score(["nice zorgxlub day", "such a z o r g l u b here", "a krap*fen now"])) > 0.3
    got = queries.op5_toxicity(spark, data).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_kernel_by_brute_force():
    """Similarities of all words at once equal the kernel summed over all triples of places; long words, summed piece by piece, too."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdeüß", k=n))

    def vector(w):
        code, out = toxicity._codes([w])[0].tolist(), Counter()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[code[i], code[j], code[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def kernel(a, b):
        dot = lambda u, v: sum(x * v[k] for k, x in u.items())
        u, v = vector(a), vector(b)
        return dot(u, v) / (dot(u, u) * dot(v, v)) ** 0.5 if u and v else 0.0

    marks = ["^zorglub$", "^abcde$", *["^" + word(6) + "$" for _ in range(4)]]
    words = [*marks, "^zorxglub$", "^abxcde$", "", "ab", "^abcdeabcde$", *["^" + word(rng.randint(3, 12)) + "$" for _ in range(300)]]
    index, sim = toxicity.Landmarks(marks, 4)(words)
    want = {k: [kernel(w, m) for m in marks] for k, w in enumerate(words)}
    assert set(index.tolist()) == {k for k, x in want.items() if max(x[:4]) >= toxicity.NEAR}
    for k, row in zip(index.tolist(), sim, strict=True):
        assert row == pytest.approx(want[k])
    long = "abcde" * 2000
    assert toxicity.Landmarks(marks, 4)._long(long) == pytest.approx([kernel(long, m) for m in marks])


def test_toxicity_quality_on_held_out_rows():
    """At sf0.1, fitted as the query does; and the same model from the same rows."""
    import pyarrow.parquet as pq

    at = DATA.replace("sf0.001", "sf0.1")
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{at}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = {r["doc_id"]: int(r["toxic"]) for r in pq.read_table(f"{at}/labels.parquet").to_pylist() if r["toxic"] is not None and r["doc_id"] in texts}
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    learn = [i for i in sorted(labels) if i not in held]
    score = toxicity.Scorer(toxicity.fit([texts[i] for i in learn], [labels[i] for i in learn]))
    got = {i: s for i, s in zip(sorted(held), score([texts[i] for i in sorted(held)]), strict=True)}
    toxic, clean = [got[i] for i in held if labels[i]], [got[i] for i in held if not labels[i]]
    found = sum(s >= 0.3 for s in toxic)
    assert found / len(toxic) >= 0.88 and found / (found + sum(s >= 0.3 for s in clean)) >= 0.85
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean) >= 0.94


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def valid(kind, v):
        n = sum(c.isdigit() for c in v)
        return {"email": lambda: True, "ip": lambda: all(int(x.lstrip("0")[:4] or 0) <= 255 for x in v.split(".")), "card": lambda: 16 <= n <= 19 and pii.luhn(re.sub("[^0-9]", "", v)), "phone": lambda: 8 <= n <= 15}[kind]()

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0])]


def test_pii_base_equals_the_patterns(texts):
    rng = random.Random(4)
    pool = [*list("aZ0123456789..@@++--  ()_%é"), "4111111111111111", "1.2.3.4", "a@b.co"]
    long = ["0" * 5000 + ".1.1.1", "1.2.3." + "9" * 5000, "4" * 9000, "+" + "1" * 9000, "a." * 5000 + "@" + "b." * 5000]
    for t in [*texts.values(), *long, *["".join(rng.choices(pool, k=rng.randint(1, 50))) for _ in range(8000)]]:
        assert [s for s in pii.find(t) if s[0] in BASE] == brute_pii(t)


def test_pii_query_reports_what_is_found(spark, data, texts):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op6_pii(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = brute_pii(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in base) for k in BASE]
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert [s for s in spans if s[0] in BASE] == [(k, str(a), str(b)) for k, a, b in base]


def test_pii_added_kinds_and_redaction():
    t = "IBAN: DE89 3704 0044 0532 0130 00 see https://x.org/a?b. Account no: 12345678, mail a.b@c.d.e."
    assert pii.redacted(t, pii.find(t)) == "IBAN: [IBAN] see [URL]. Account no: [ACCOUNT], mail [EMAIL]."


def test_substring_ties_and_self_repeats(spark):
    w = [f"w{i}" for i in range(60)]
    d = spark.createDataFrame([(2, " ".join(w)), (1, " ".join(w[20:60])), (3, "x " * 50), (4, " ".join(w[:19])), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.remove_repeats(d).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 40 and [(s["start"], s["length"]) for s in got[2]["repeats"]] == [(20, 40)]
    assert got[3]["n_removed"] == 49 and got[4]["n_removed"] == 0 and got[5]["n_words"] == 0


def test_shards_are_cut_where_a_plain_loop_cuts(spark, data, texts):
    sizes = {i: len(t.encode()) + 8 for i, t in texts.items()}
    total, before, slots, want = sum(sizes.values()), 0, Counter(), {}
    for i in sorted(sizes):
        shard = min(23, (2 * before + sizes[i]) * 24 // (2 * total))  # where its middle byte lies among 24 equal parts
        want[i] = (shard, slots[shard])
        slots[shard] += 1
        before += sizes[i]
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op10_shard_bytes(spark, data).collect()} == want


def test_sharding_is_contiguous_and_balanced(spark, data, texts):
    rows = sorted(queries.op10_shard_bytes(spark, data).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == sorted(texts)
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    sums, slots = Counter(), defaultdict(list)
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body)
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(s == list(range(len(s))) for s in slots.values())
    target, largest = sum(sums.values()) / 24, max(r["size"] for r in rows)
    assert all(abs(sums[k] - target) <= largest for k in range(24))


def test_pipeline_stages_by_brute_force(spark, data, docs, texts):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, data)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in queries.op7_quality_rules(spark, data).where("kept").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(kept) == want
    firsts = {}
    for i in sorted(want):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    once = stage["exact_dedup"](spark, kept, data)
    assert ids(once) == set(firsts.values())
    near = stage["simhash_dedup"](spark, once, data)
    assert ids(near) == set(brute_near({i: texts[i] for i in firsts.values()}).values())
    clean = {r["doc_id"]: r for r in stage["pii_redaction"](spark, near, data).collect()}
    for i, r in clean.items():
        assert r["text"] == pii.redacted(texts[i], pii.find(texts[i])) and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, data).collect()} == set(clean)


def brute_near(texts):
    """Least identifier of each text's group by five-word shingles with a Jaccard of 0.8 or more."""
    def cut(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, group = {i: cut(t) for i, t in texts.items()}, {i: i for i in texts}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def test_pipeline_drops_near_copies_by_five_word_shingles(spark, data):
    """Near copies whose fingerprints differ in many bits; repeated and null identifiers; a bucket of several blocks."""
    import corpus_pipeline

    rng = random.Random(8)
    texts = {}
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        texts[g * 10] = " ".join(base)
        for k in range(1, 6):
            copy = list(base)
            for at in rng.sample([0, 59, 20, 40], 1 + k % 2):
                copy[at] = f"x{g}-{k}"
            texts[g * 10 + k] = " ".join(copy)
    assert min(bin(brute_fp(texts[g * 10]) ^ brute_fp(texts[g * 10 + 1])).count("1") for g in range(12)) > 2
    want = brute_near(texts)
    docs = spark.createDataFrame([*texts.items(), (None, texts[0] + " end")], "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, data).collect())
    assert kept == sorted(set(want.values())) and len(kept) < len(want)
    assert sorted(r["doc_id"] for r in simhash.representatives(docs, block=2).collect()) == kept
    twice = spark.createDataFrame([(7, "one two three four five six"), (7, "another text of quite other words")], "doc_id long, text string")
    assert simhash.representatives(twice).count() == 2


def test_hot_keys_are_spread_and_lose_nothing(spark, monkeypatch):
    from tidepanel.llm import shared

    monkeypatch.setattr(shared, "SPREAD_ROWS", 5)
    left = spark.createDataFrame([(k, 1 if k < 60 else k % 20) for k in range(100)], "at long, key int")
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    want = {(r["at"], r["key"], r["last"]) for r in left.join(right, "key").collect()}
    for join in (lambda: shared.spread_join(left, right, ["key"], "at"), lambda: shared.hot_join(left, right, ["key"])):
        got = [(r["at"], r["key"], r["last"]) for r in join().select("at", "key", "last").collect()]
        assert len(got) == 100 and set(got) == want


def test_pipeline_on_empty_null_and_repeated_rows(spark, tmp_path):
    """The whole pipeline on an empty corpus, and on null texts and ids, repeated rows, odd white space and extra columns."""
    import corpus_pipeline

    good = " ".join(f"the word{k} of it and what{k} is" for k in range(30)) + "."
    rows = [(1, None), (2, ""), (None, good), (3, good), (3, good), (4, good.replace("word7", "\xa0 \xa0x")), (5, "x " * 4000)]
    for name, some in (("empty", []), ("odd", rows)):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in some], "doc_id long, text string, lang string, source string, n_chars long, row string")
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} == ({3} if some else set())


def test_toxicity_fit_outlasts_the_word_cache(monkeypatch):
    """More distinct words than a scorer remembers: the fit keeps what it found, and the model is the same."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(3, 8)))
    texts = [" ".join([*[word() for _ in range(8)], *(["zorglub", f"muffluk{word()}"] if k % 4 == 0 else [])]) for k in range(200)]
    labels = [int(k % 4 == 0) for k in range(200)]
    want = toxicity.fit(texts, labels)
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 3)
    got = toxicity.fit(texts, labels)
    assert want.landmarks is not None and got.landmarks.words == want.landmarks.words
    assert np.allclose(got.weights, want.weights) and np.allclose([got.bias, got.slope, got.shift], [want.bias, want.slope, want.shift])
    assert toxicity.Scorer(got)(texts) == pytest.approx(toxicity.Scorer(want)(texts))


def test_search_opens_few_nodes_at_once_and_loses_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 1200)).astype(np.uint64)
    fps = np.repeat(centre, 30) ^ flips[0] ^ flips[1] ^ flips[2]
    rank = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    fps = fps[np.argsort(rank)]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 4), strict=True)}
    monkeypatch.setattr(simhash, "OPEN", 7)
    got = [p for q, leaf in simhash._search(simhash._levels(fps), fps, 4, chunk=100) for p in zip(q.tolist(), leaf.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_views_meet_pairs_at_the_limit():
    """Of planted pairs with a Jaccard of 0.8 or more at least 0.95 meet in a view, whatever the number of entries."""
    rng, pairs = random.Random(1), []
    while len(pairs) < 300:
        n = int(2 ** rng.uniform(4, 11))
        base = [f"w{rng.randrange(20000)}" for _ in range(n)]
        copy = list(base)
        for _ in range(max(1, int(n * rng.uniform(0.002, 0.05)))):
            copy[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        a, b = (simhash.shingle_set(" ".join(x).encode()) for x in (base, copy))
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            pairs.append((simhash.wide_fingerprint(a), simhash.wide_fingerprint(b)))
    left, right = ([np.array([p[side][k] for p in pairs]) for k in range(simhash.WIDE // 64)] for side in (0, 1))
    for n in (1000, 100_000, 10_000_000):
        seen = simhash.views(n)
        words = [simhash.view_words(lanes, seen) for lanes in (left, right)]
        near = (np.bitwise_count(words[0] ^ words[1]) <= simhash.VIEW_LIMIT).any(axis=0)
        near &= sum(np.bitwise_count(a ^ b).astype(int) for a, b in list(zip(left, right, strict=True))[: simhash.CLOSE]) <= simhash.CLOSE_LIMIT
        assert near.mean() >= 0.95
        assert np.bitwise_count(words[0][0] ^ words[0][1]).min() > simhash.VIEW_LIMIT
