"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words, all of them. A learned layer encodes each passage from its words (the
mean of learned vectors of the word and of its first and last three bytes, each hashed to one of BUCKETS)
and from how it is written (lengths, repetition, letter case, symbols, separators); gated attention, learned from
document labels alone, weighs the passages, and a logistic unit scores the weighted sum. So one bad stretch in a long
text can decide.

The sample is bounded by PER_CLASS rows of each label of at most CHARS characters (held-out rows never enter); the
networks are fitted at the driver, whatever the size of the corpus. Whole texts are scored in one Arrow pass; a worker
sums the vectors of a word's parts once and remembers the sum, within REMEMBERED bytes. Null, empty and blank texts are a bag of one blank passage. Without labels of both classes every score is that
of the only class, or 0 without labels. Each input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import held_out, labelled_texts, resident, table

PER_CLASS, CHARS = 2000, 12_000
WORDS = 48
HIDDEN, GATES = 16, 8
#: Learned vectors, and how many of them a word has.
BUCKETS, PARTS_OF = 4096, 3
#: Bytes that a worker's remembered words take, and the words that are looked up at once (whole passages).
REMEMBERED, STRETCH = 64 << 20, 256 * WORDS
CUT = 0.5
#: Passages that are scored at once.
AT_ONCE = 8192

OUT = "doc_id long, held_out boolean, score double, predicted int, n_passages long"

SYMBOL = re.compile(r"[^\w\s]")
DOUBLED = re.compile(r"([^\w\s])\1")


def passage_features(words: list[str]) -> list[float]:
    """How a passage is written; shares are of its words or characters."""
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    line = " ".join(words)
    chars = len(line)
    distinct = len(set(words))
    bare = len(SYMBOL.sub("", line))
    lengths = list(map(len, words))
    longest_run = max(sum(1 for _ in g) for _, g in groupby(words)) if distinct < n else 1
    mean = sum(lengths) / n
    return [
        mean / 8,
        (sum(x * x for x in lengths) / n - mean * mean) ** 0.5 / 4,
        distinct / n,
        sum(map(eq, words, words[1:])) / n,
        longest_run / n,
        max(map(words.count, words[:3])) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isdigit, words)) / n,
        (chars - bare) / chars,
        len(DOUBLED.findall(line)) / n,
        line.count("|") / n,
        line.count("!") / n,
        line.count(".") / n,
        line.count(",") / n,
        sum(map(line.count, "#$%&*@^~<>{}[]\\=+_")) / n,
        sum(x <= 3 for x in lengths) / n,
        0.0 if line.isascii() else 1.0,
        min(1.0, n / WORDS),
        1.0,
    ]


N_FEATURES = 21


class Words:
    """Numbers of words, and the buckets of each word's parts; a word is looked at once."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.raw, self.size = array("H"), 0

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in dict.fromkeys(words):
                if w not in known:
                    known[w] = len(known)
                    self.raw.extend(self.parts_of(w))
                    self.size += 4 * len(w) + 240
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def parts(self, begin: int = 0) -> np.ndarray:
        """Buckets of the words from number `begin` on."""
        return np.array(self.raw[begin * PARTS_OF :], np.uint16).reshape(-1, PARTS_OF)

    @staticmethod
    def parts_of(word: str) -> tuple[int, int, int]:
        low = word.lower().encode("utf-8", "surrogatepass")
        return zlib.crc32(low) % BUCKETS, zlib.crc32(low[:3], 1) % BUCKETS, zlib.crc32(low[-3:], 2) % BUCKETS


class Encoder:
    """Means of the words' learned vectors for the passages of a text; the vectors of known words are kept."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.words = vectors.astype(np.float32), Words()
        self.sums, self.n = np.zeros((1024, vectors.shape[1]), np.float32), 0

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self.stretch(words[a : a + STRETCH]) for a in range(0, len(words), STRETCH)]) if words else np.zeros((1, self.sums.shape[1]), np.float32)

    def stretch(self, words: list[str]) -> np.ndarray:
        if self.words.size > REMEMBERED:
            self.words.clear()
            self.n = 0
        ids = self.words(words)
        if len(self.words.known) > self.n:
            new = self.vectors[self.words.parts(self.n)].mean(axis=1)
            if self.n + len(new) > len(self.sums):
                self.sums = np.concatenate([self.sums[: self.n], np.empty((self.n + 2 * len(new), self.sums.shape[1]), np.float32)])
            self.sums[self.n : self.n + len(new)] = new
            self.n += len(new)
        starts = np.arange(0, len(ids), WORDS)
        return np.add.reduceat(self.sums[ids], starts, axis=0) / np.diff(np.append(starts, len(ids)))[:, None]


def passages(text: str | None) -> tuple[list[str], list[list[float]]]:
    """All words of a text, and how each of its passages is written; one blank passage if it has no words."""
    words = (text or "").split()
    return words, [passage_features(words[a : a + WORDS]) for a in range(0, len(words), WORDS)] or [[0.0] * N_FEATURES]


class AttentionModel:
    """Gated attention over passages: word vectors E, encoder W, gates V and U, attention w, output c and d."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray):
        self.p, self.mean, self.spread = weights, mean, spread

    @classmethod
    def drawn(cls, rng: np.random.Generator, mean: np.ndarray, spread: np.ndarray) -> AttentionModel:
        draw = lambda *shape: rng.normal(size=shape) / np.sqrt(shape[0])
        weights = {"W": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES), "c": draw(HIDDEN), "d": np.zeros(())}
        return cls(weights | {"E": rng.normal(size=(BUCKETS, HIDDEN)) * 0.02}, mean, spread)

    def forward(self, x: np.ndarray, near: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages by features; near: means of their words' vectors; starts: where each bag begins."""
        p, sizes = self.p, np.diff(np.append(starts, len(x)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        h = np.tanh(x @ p["W"] + p["b"] + near)
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "owner": owner}

    def loss(self, bags: list[tuple[np.ndarray, np.ndarray]], parts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean cross entropy and its gradient; a bag is its passages' features and its words' numbers."""
        p, counts = self.p, np.array([len(f) for f, _ in bags])
        starts = np.cumsum(counts) - counts
        x = (np.concatenate([f for f, _ in bags]) - self.mean) / self.spread
        met, ids = np.unique(np.concatenate([w for _, w in bags]), return_inverse=True)
        sizes = np.concatenate([np.minimum(WORDS, np.maximum(0, len(w) - WORDS * np.arange(len(f)))) for f, w in bags])
        some, of_word = np.flatnonzero(sizes), np.repeat(np.arange(len(sizes)), sizes)
        near = np.zeros((len(sizes), HIDDEN))
        if len(some):
            near[some] = np.add.reduceat(p["E"][parts[met]].mean(axis=1)[ids], (np.cumsum(sizes) - sizes)[some], axis=0) / sizes[some, None]
        o = self.forward(x, near, starts)
        h, t, s, a, owner = o["h"], o["t"], o["s"], o["a"], o["owner"]
        dl = (o["y"] - y) * weight / len(y)
        dz = np.outer(dl, p["c"])[owner]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[owner])
        dg = np.outer(de, p["w"])
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        dv = np.zeros_like(p["E"])
        if len(met):
            by_word = np.argsort(ids, kind="stable")
            firsts = np.searchsorted(ids[by_word], np.arange(len(met)))
            each = np.add.reduceat((dh / np.maximum(1, sizes)[:, None])[of_word[by_word]], firsts, axis=0) / PARTS_OF
            flat = parts[met].ravel()
            for j in range(HIDDEN):
                dv[:, j] = np.bincount(flat, np.repeat(each[:, j], PARTS_OF), BUCKETS)
        grad = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": o["z"].T @ dl, "d": dl.sum(), "E": dv}
        right = np.where(y == 1, o["y"], 1 - o["y"])
        return float(-(weight * np.log(np.maximum(right, 1e-12))).mean()), grad

    def score(self, features: list[list[list[float]]], near: list[np.ndarray]) -> np.ndarray:
        """Scores of bags from their passages' features and the means of their words' vectors."""
        if not features:
            return np.zeros(0)
        sizes = np.array([len(f) for f in features])
        x = (np.array([f for bag in features for f in bag]) - self.mean) / self.spread
        return self.forward(x, np.concatenate(near), np.cumsum(sizes) - sizes)["y"]

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        encoder, made = Encoder(self.p["E"]), [passages(t) for t in texts]
        return self.score([f for _, f in made], [encoder(w) for w, _ in made])


def fit(sample: list[tuple[str, int]], epochs: int = 16, batch: int = 128, seed: int = 0) -> AttentionModel | float:
    """A model, or the only label there is."""
    y = np.array([label for _, label in sample], float)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.0
    rng, words_of = np.random.default_rng(seed), Words()
    bags = [(np.array(f), words_of(w)) for w, f in (passages(t) for t, _ in sample)]
    parts, every = words_of.parts(), np.concatenate([f for f, _ in bags])
    model = AttentionModel.drawn(rng, every.mean(axis=0), every.std(axis=0) + 1e-3)
    p = model.p
    m, v, n = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        order, rate = rng.permutation(len(bags)), 0.01 * (0.5 if epoch > epochs * 0.6 else 1)
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            _, grad = model.loss([bags[i] for i in chosen], parts, y[chosen], weight[chosen])
            n += 1
            for k, g in grad.items():
                g = g + (1e-3 if k == "E" else 1e-4) * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
    return model


def score_quality(docs: DataFrame, model: AttentionModel | float, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages per document. The model has BUCKETS * HIDDEN numbers and a few hundred."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = not isinstance(own, float)
        # the encoder of one model; another model in the same worker has vectors of its own
        encoder = resident(("attention", hash(own.p["E"].tobytes())), lambda: Encoder(own.p["E"])) if known else None
        score = own.score if known else lambda features, _: np.full(len(features), own)
        for batch in batches:
            features, near, scores, counts, waiting = [], [], [], [], 0
            for value in batch.column(2):
                words, made = passages(value.as_py())
                features.append(made)
                if known:
                    near.append(encoder(words))
                counts.append(len(made))
                waiting += len(made)
                if waiting >= AT_ONCE:
                    scores += score(features, near).tolist()
                    features, near, waiting = [], [], 0
            scores += score(features, near).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32()), pa.array(counts, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "n_passages"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(each, OUT)


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", PER_CLASS, CHARS)))


QUERIES = {"op9_attention_quality": op9_attention_quality}
ORACLES: dict[str, str] = {}
