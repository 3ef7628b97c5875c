"""Document quality by attention-based multiple-instance learning: a document is a bag of passages, and only bags have labels.

A passage is PASSAGE characters of the text in order; the whole text is cut, so no part goes unseen. It is described by the shares of
its pairs of neighbouring characters, as classes (small and capital letters, digits, kinds of marks), and by how its words repeat and how
long they are. A learned layer encodes that description; gated attention (a tanh half times a sigmoid half) weighs the document's
passages; the weighted mean of their codes is the document's representation, and a logistic unit scores it. All weights are learned
together from the documents' labels, so a document is found out by the few passages that spoil it.

The model is fitted in the driver on at most MAX_ROWS labelled documents of MAX_BYTES of text in all, those of the least hashes of their
ids (`shared.labelled_sample`); scoring runs in tasks, in pieces of bounded size: what a document needs of its passages are running sums.
Labels are only looked at in the fit. Null and empty texts are one empty passage. Without labelled rows of both kinds every score is the
share of label 1, or a half without any. Repeated rows are scored each; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sparing

#: Labelled documents that the model is fitted on, and bytes of their texts, at most.
MAX_ROWS, MAX_BYTES = 6000, 64 << 20
#: Characters of a passage; passages that are encoded at once; sizes of the code and of the attention's halves.
PASSAGE, PIECE, CODE, GATE = 512, 4096, 24, 12
#: Rounds over the sample, documents a step, step size, weight of the squared weights.
EPOCHS, BATCH, RATE, DECAY = 30, 64, 4e-3, 1e-4

#: Kinds of characters: small, capital, digit, blank, line end, end of clause, mark of emphasis, symbol, separator, other mark, beyond ASCII.
KINDS = 11
_KIND = np.full(129, 9, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:", "!?", "#*$%&@^~=+", "|<>\\/_{}[]")):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128] = 10
WORD_MARKS = 6
WIDTH = KINDS * KINDS + WORD_MARKS


def passages(text: str) -> list[str]:
    return [text[k : k + PASSAGE] for k in range(0, max(1, len(text)), PASSAGE)]


def _words(passage: str) -> tuple[float, ...]:
    words = passage.split()
    n = len(words)
    if not n:
        return (0.0,) * WORD_MARKS
    return (len(set(words)) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), min(1.0, sum(map(len, words)) / n / 20), max(map(len, words)) / PASSAGE, sum(len(w) < 4 for w in words) / n, n / PASSAGE)


def described(parts: list[str]) -> np.ndarray:
    """What is known of each passage, WIDTH numbers."""
    n, size = len(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, own = _KIND[np.minimum(flat, 128)], np.repeat(np.arange(n), size)
    near = np.flatnonzero(own[1:] == own[:-1])
    pair = own[near] * (KINDS * KINDS) + kind[near] * KINDS + kind[near + 1]
    share = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1) / np.maximum(1, size - 1)[:, None]
    return np.hstack([np.sqrt(share), np.array([_words(p) for p in parts])])


def pieces(texts: list[str]):
    """(number of the text of each passage, description) for some thousand passages at a time."""
    own, parts = [], []
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PASSAGE):
            own.append(k)
            parts.append(text[at : at + PASSAGE])
            if len(parts) == PIECE:
                yield np.array(own), described(parts)
                own, parts = [], []
    if parts:
        yield np.array(own), described(parts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    """code = tanh(x @ encode + shift); attention of a passage = exp((tanh(code @ look) * sigmoid(code @ gate)) @ weigh), as a share of the
    document's; score = sigmoid(mean code under attention @ judge + bias)."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, attention before it is made a share) of passages."""
        w = self.weights
        code = np.tanh(x @ w["encode"] + w["shift"])
        return code, np.exp((np.tanh(code @ w["look"]) * _sigmoid(code @ w["gate"])) @ w["weigh"])

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        total, share = np.zeros((len(texts), CODE)), np.zeros(len(texts))
        for own, x in pieces(texts):
            code, attention = self.encoded((x - self.mean) / self.scale)
            np.add.at(share, own, attention)
            np.add.at(total, own, attention[:, None] * code)
        # rounded, as sums in another order may end a hair apart: equal texts have equal scores
        return np.round(_sigmoid(total / share[:, None] @ self.weights["judge"] + self.weights["bias"]), 9)

    def attention(self, text: str) -> np.ndarray:
        """The share that each passage of a text has in its score."""
        a = np.concatenate([self.encoded((x - self.mean) / self.scale)[1] for _, x in pieces([text])])
        return a / a.sum()


def gradients(w: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of documents and its gradient. x: passages of all documents in order; start: where each document's begin."""
    own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
    code = np.tanh(x @ w["encode"] + w["shift"])
    look, gate = np.tanh(code @ w["look"]), _sigmoid(code @ w["gate"])
    raw = np.exp((look * gate) @ w["weigh"])
    share = raw / np.add.reduceat(raw, start)[own]
    bag = np.add.reduceat(share[:, None] * code, start, axis=0)
    p = _sigmoid(bag @ w["judge"] + w["bias"])
    loss = -float(np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))
    d_out = (p - y) / len(y)
    d_bag = (d_out[:, None] * w["judge"])[own]
    d_share = (code * d_bag).sum(axis=1)
    d_raw = share * (d_share - np.add.reduceat(share * d_share, start)[own])
    d_both = d_raw[:, None] * w["weigh"]
    d_look, d_gate = d_both * gate * (1 - look**2), d_both * look * gate * (1 - gate)
    d_code = (share[:, None] * d_bag + d_look @ w["look"].T + d_gate @ w["gate"].T) * (1 - code**2)
    return loss, {
        "encode": x.T @ d_code, "shift": d_code.sum(axis=0), "look": code.T @ d_look, "gate": code.T @ d_gate,
        "weigh": (look * gate).T @ d_raw, "judge": bag.T @ d_out, "bias": np.array(d_out.sum()),
    }


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    found = list(pieces(texts))
    own, x = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.float32)
    del found
    mean, scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float) + 1e-2
    x = ((x - mean) / scale).astype(np.float32)
    start = np.append(np.searchsorted(own, np.arange(len(y))), len(own))
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[0]), shape)
    w = {"encode": draw(WIDTH, CODE), "shift": np.zeros(CODE), "look": draw(CODE, GATE), "gate": draw(CODE, GATE), "weigh": draw(GATE), "judge": draw(CODE), "bias": np.array(0.0)}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0  # of Adam's moments
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            rows = np.concatenate([np.arange(start[d], start[d + 1]) for d in docs])
            begin = np.append(0, np.cumsum(start[docs + 1] - start[docs]))[:-1]
            _, g = gradients(w, x[rows].astype(float), begin, y[docs])
            step += 1
            for k in w:
                d = g[k] + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(sparing(run), "doc_id long, score double")
