"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystrom landmarks.

Words are compared by the subsequences of three letters that they share (the word's start and end count as letters); a subsequence
of span s counts DECAY**s, so inserted letters and gaps lower the similarity instead of losing it. Case, punctuation inside words,
common digit-for-letter swaps and letters spelt one by one are undone first. Nystrom features of a word are its similarities to all
landmarks, and a sentence has of each landmark the largest that its words reach, times the inverse square root of the landmarks' own
kernel matrix. On sentences a linear SVM is trained. A document is as toxic as its worst sentence; a logistic curve turns that
sentence's margin into the score. A word whose similarity to every telling landmark is below NEAR adds nothing.

Labels are of documents, and their sentences inherit them: of a toxic document the most telling sentence is the positive row, found
again after each fit; every sentence of clean documents is a negative one (alike ones of a document count once).

Landmarks are words and beginnings of words that toxic documents have more often than chance explains, and the clean words most like
them. The model is fitted in the driver on at most MAX_ROWS labelled documents of MAX_BYTES in all (those of the least hashes of their
ids); all else runs in tasks. Of repeated ids the least text is learned from. Null and empty texts have no sentence and get the score of one without a
landmark's like. Without labelled rows of both kinds every score is the share of toxic ones, or 0. Repeated rows are scored each; an
empty table gives no rows. Texts and words are read whole, of any length: a word's subsequences are summed up piece by piece.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on, and bytes of their texts, at most.
MAX_ROWS, MAX_BYTES = 6000, 64 << 20
#: Landmarks of either kind, no two of the telling ones more alike than APART; similarity from which a word counts; decay a letter of span; longest span.
LANDMARKS, APART, NEAR, DECAY, SPAN = 64, 0.6, 0.5, 0.7, 6
#: Words that a task remembers; words and letters that are compared at once; letters from which a word is summed up by itself.
CACHE_WORDS, BATCH, LETTERS, LONG = 400_000, 20_000, 400_000, 4096

SENTENCE = re.compile(r"[.!?\n|]+\s*")
SPELT = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
SWAPS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
INNER = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])")


#: Marks of a word's start and end.
START, END = "^", "$"


def marked(token: str) -> str:
    """What the kernel compares; empty if the token has no letters."""
    word = letters(token)
    return START + word + END if word else ""


def letters(token: str) -> str:
    """Lower-case letters of a token, with swaps between letters undone."""
    token = token.lower()
    if token.isalpha():
        return token
    token = INNER.sub(lambda m: m[0].translate(SWAPS), token)
    return "".join([c for c in token if c.isalpha()])


def joined(text: str) -> str:
    """Letters spelt one by one become a word."""
    return SPELT.sub(lambda m: m[0].replace(" ", ""), text)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words as numbers below 32, and the words' lengths."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    code = np.where((flat >= 97) & (flat <= 122), flat - 96, 27 + flat % 3).astype(np.int64)
    code[flat == ord(START)], code[flat == ord(END)] = 0, 31
    return code, np.fromiter(map(len, words), np.int64, len(words))


def _features(words: list[str]):
    """Yields (word index, subsequence number, weight) arrays, one triple for each pair of offsets."""
    code, size = _codes(words)
    if not len(code):
        return
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # letters from here to the word's end
    for b in range(2, SPAN):
        at = np.flatnonzero(left > b)
        for a in range(1, b):
            yield word[at], code[at] * 1024 + code[at + a] * 32 + code[at + b], DECAY ** (b + 1)


def _vectors(words: list[str]) -> list[dict[int, float]]:
    out: list[dict[int, float]] = [{} for _ in words]
    for word, key, weight in _features(words):
        for w, k in zip(word.tolist(), key.tolist(), strict=True):
            out[w][k] = out[w].get(k, 0.0) + weight
    return out


def _norm(v: dict[int, float]) -> float:
    return math.sqrt(sum(x * x for x in v.values()))


def _cosine(u: dict[int, float], v: dict[int, float]) -> float:
    n = _norm(u) * _norm(v)
    return sum(x * v[k] for k, x in u.items() if k in v) / n if n else 0.0


def similarity(a: str, b: str) -> float:
    """Normalized kernel of two marked words; 0 if either has fewer than three characters."""
    return _cosine(*_vectors([a, b]))


class Landmarks:
    """Similarities of many words to all landmarks at once. The first `toxic` landmarks decide which words count."""

    def __init__(self, words: list[str], toxic: int):
        self.words, self.toxic = words, toxic
        vectors = _vectors(words)
        keys = sorted({k for v in vectors for k in v})
        self.row = np.full(32768, -1, np.int32)
        self.row[keys] = np.arange(len(keys))
        self.table = np.zeros((len(keys), len(words)))
        for j, v in enumerate(vectors):
            n = _norm(v) or 1.0
            for k, x in v.items():
                self.table[self.row[k], j] = x / n
        length = np.arange(64)
        squares = sum(np.maximum(0, length - b) * (b - 1) * DECAY ** (2 * b + 2) for b in range(2, SPAN))
        self.least_norm = np.sqrt(np.maximum(squares, 1e-12))  # of a word without a repeated subsequence: no word has less

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(indices of words that count, their similarities)."""
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        index, sim = self._short([words[k] for k in short])
        index = np.array(short, np.int64)[index]
        for k, w in enumerate(words):
            if len(w) > LONG:
                one = self._long(w)
                if one[: self.toxic].max() >= NEAR:
                    index, sim = np.append(index, k), np.vstack([sim, one])
        return index, sim

    def _long(self, word: str) -> np.ndarray:
        """Similarities of one word; its subsequences are counted over pieces, each of those that start in it."""
        full = np.zeros(32768)
        for at in range(0, len(word), LONG):
            code, _ = _codes([word[at : at + LONG + SPAN - 1]])
            for b in range(2, SPAN):
                n = min(LONG, len(code) - b)
                for a in range(1, b):
                    if n > 0:
                        full += np.bincount(code[:n] * 1024 + code[a : a + n] * 32 + code[b : b + n], minlength=32768) * DECAY ** (b + 1)
        keys = np.flatnonzero(self.row >= 0)
        return full[keys] @ self.table[self.row[keys]] / max(np.sqrt(full @ full), 1e-12)

    def _short(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros((0, len(self.words)))
        found = []
        for word, key, weight in _features(words):
            row = self.row[key]
            hit = row >= 0
            found.append((word[hit], row[hit], np.full(int(hit.sum()), weight)))
        if not found:
            return none
        word, row, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(word):
            return none
        # what a word could reach if all its shared weight lay on one landmark: most words end here
        best, least = self.table[:, : self.toxic].max(axis=1), self.least_norm[np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 63)]
        may = np.bincount(word, weights=best[row] * weight, minlength=len(words)) >= NEAR * least
        keep = may[word]
        # a word's weights of one subsequence add up first, so a word has at most as many rows as the landmarks have subsequences
        pair, place = np.unique(word[keep] * len(self.table) + row[keep], return_inverse=True)
        if not len(pair):
            return none
        weight, word, row = np.bincount(place, weights=weight[keep]), pair // len(self.table), pair % len(self.table)
        at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        own, ends = word[at], np.append(at, len(word))
        raw = np.concatenate([np.add.reduceat(self.table[row[a:b]] * weight[a:b, None], at[k : k + 32] - a, axis=0) for k in range(0, len(own), 32) for a, b in [(ends[k], ends[min(k + 32, len(own))])]])
        may = raw[:, : self.toxic].max(axis=1) >= NEAR * least[own]
        own, raw = own[may], raw[may]
        norm = np.array([_norm(v) for v in _vectors([words[w] for w in own])]).reshape(-1, 1)
        sim = raw / np.maximum(norm, 1e-12)
        near = sim[:, : self.toxic].max(axis=1) >= NEAR
        return own[near], sim[near]


@dataclass
class Model:
    """margin of a sentence = pooled similarities @ weights + bias; score of a document = logistic(slope * worst margin + shift)."""

    landmarks: Landmarks | None
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.slope * margin + self.shift))))


class Scorer:
    """Margins of documents; what it remembers of words is bounded."""

    def __init__(self, model: Model):
        self.model, self.seen, self.hits = model, set(), {}

    def learn(self, tokens: set[str]) -> None:
        """hits: similarities of the tokens that count."""
        if len(self.seen) > CACHE_WORDS:
            self.seen, self.hits = set(), {}
        new = list(tokens - self.seen)
        self.seen.update(new)
        part, size = [], 0
        for k, t in enumerate(new):
            part.append(t)
            size += len(t)
            if len(part) == BATCH or size > LETTERS or k + 1 == len(new):
                index, sim = self.model.landmarks([marked(t) for t in part])
                self.hits.update((part[k], s) for k, s in zip(index.tolist(), sim, strict=True))
                part, size = [], 0

    def sentences(self, texts: list[str]) -> list[set[tuple[str, ...]]]:
        """Of each text, the words that count in each of its sentences; () stands for sentences without any."""
        whole = [joined(t) for t in texts]
        cut = [set(SENTENCE.sub(" ", t).split()) for t in whole]
        self.learn(set().union(*cut) if cut else set())
        known = self.hits.keys()
        return [{tuple(sorted(known & set(s.split()))) for s in SENTENCE.split(t)} if ws & known else {()} for t, ws in zip(whole, cut, strict=True)]

    def __call__(self, texts: list[str]) -> list[float]:
        m = self.model
        if m.landmarks is None:
            return [m.score(0.0)] * len(texts)
        return [m.score(max([m.bias, *[float(pooled([self.hits[w] for w in s]) @ m.weights) + m.bias for s in found if s]])) for found in self.sentences(texts)]


def pooled(similarities: list[np.ndarray]) -> np.ndarray:
    """Of each landmark the largest similarity that words of a sentence have."""
    return np.max(similarities, axis=0)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) / cost
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        out = 1 - y * (x @ w)
        on = out > 0
        c = weight[on]
        grad = ridge @ w - 2 * (x[on] * (c * y[on] * out[on])[:, None]).sum(axis=0)
        step = np.linalg.solve(ridge + 2 * (x[on] * c[:, None]).T @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve of y over margin."""
    x, w = np.stack([margin, np.ones(len(margin))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2
        step = np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def candidates(word: str) -> list[str]:
    """What may become a landmark: a marked word of three letters or more, and its beginnings of four to seven letters."""
    if not 3 <= len(word) <= 40:
        return []
    return [START + word + END, *[START + word[:k] for k in range(4, min(8, len(word)))]]


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, cost: float = 10.0, rounds: int = 4) -> Model:
    y = np.array(labels, float)
    rate = float(y.mean()) if len(y) else 0.0
    constant = Model(None, np.zeros(0), 0.0, 1.0, math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    if not 0 < rate < 1:
        return constant
    # a toxic document counts for a word only where the word follows one that it has not followed before: copies count once
    toxic, clean, clean_words, places = Counter(), Counter(), set(), set()
    for t in (t for t, label in zip(texts, labels, strict=True) if label):
        tokens = [letters(w) for w in SENTENCE.sub(" ", joined(t)).split()]
        new = {(xxhash.xxh64_intdigest(p), w) for p, w in zip(["", *tokens], tokens, strict=False)} - places
        places |= new
        toxic.update({c for _, w in new for c in candidates(w)})
    tried = len(toxic)
    toxic = Counter({c: n for c, n in toxic.items() if n > 2})  # so few documents prove nothing among so many candidates
    del places
    for t in (t for t, label in zip(texts, labels, strict=True) if not label):
        words = {letters(w) for w in set(SENTENCE.sub(" ", joined(t)).split())}
        clean_words |= words
        clean.update({c for w in words for c in candidates(w) if c in toxic})
    share, surprise = float(y.mean()), {}
    for c, n in toxic.items():
        all_in = n + clean[c]
        if n > share * all_in:  # likelihood ratio of the documents that have it against their labels
            surprise[c] = 2 * (n * math.log(n / (share * all_in)) + (clean[c] and clean[c] * math.log(clean[c] / ((1 - share) * all_in))))
    enough = 2 * math.log(max(2, tried))  # one candidate among so many gets so far by chance
    ranked = sorted((c for c, g in surprise.items() if g > enough), key=lambda c: (-surprise[c], c))
    telling: list[str] = []
    vectors: list[dict[int, float]] = []
    for c, v in zip(ranked, _vectors(ranked), strict=True):
        if len(telling) < landmarks and all(_cosine(v, u) < APART for u in vectors):
            telling.append(c)
            vectors.append(v)
    if not telling:
        return constant
    first = Landmarks(telling, len(telling))
    words, likest = sorted(START + w + END for w in clean_words if w and START + w + END not in toxic), []
    del clean_words
    for at in range(0, len(words), 10_000):
        index, sim = first(words[at : at + 10_000])
        likest = sorted([*likest, *((-float(x.max()), words[at + k]) for k, x in zip(index.tolist(), sim, strict=True))])[:landmarks]
    marks = Landmarks(telling + [w for _, w in likest], len(telling))
    vectors = _vectors(marks.words)
    values, axes = np.linalg.eigh(np.array([[_cosine(u, v) for v in vectors] for u in vectors]))
    root = axes @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ axes.T
    model = Model(marks, np.zeros(len(marks.words)), 0.0, 1.0, 0.0)
    scorer = Scorer(model)
    found, similar = [], {}  # the scorer forgets, so what counts is kept here
    for t in texts:
        found.append(scorer.sentences([t])[0])
        similar.update((w, scorer.hits[w]) for s in found[-1] for w in s if w not in similar)
    # one row a distinct sentence, as far as its words count; row 0 for one without any
    place = {s: k + 1 for k, s in enumerate(sorted({s for ss in found for s in ss if s}))} | {(): 0}
    rows = np.stack([np.zeros(len(marks.words)), *[pooled([similar[w] for w in s]) @ root for s in place if s]])
    bags = [np.array(sorted(place[s] for s in ss)) for ss in found]
    times = Counter(int(k) for bag, label in zip(bags, labels, strict=True) if not label for k in bag)
    negative = np.array(sorted(times))
    many = np.array([times[k] for k in negative.tolist()], float)
    w = np.append(root @ np.where(np.arange(len(marks.words)) < len(telling), 1.0, 0.0), 0.0)
    for _ in range(rounds):
        margins = rows @ w[:-1]
        positive = np.array([bag[np.argmax(margins[bag])] for bag, label in zip(bags, labels, strict=True) if label])
        t = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([np.full(len(positive), 0.5 / len(positive)), many * 0.5 / many.sum()]) * (len(positive) + many.sum())
        w = _svm(rows[np.concatenate([positive, negative])], t, weight, cost)
    margins = np.maximum(rows @ w[:-1], 0.0) + w[-1]  # as a scorer has it: no sentence lies below one without any
    margin = np.array([margins[bag].max() for bag in bags])
    return Model(marks, root @ w[:-1], float(w[-1]), *_logistic(margin, y))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", rows: int = 500) -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double")
