"""Toxicity by weak supervision.

Voters are lexicon entries (words, word beginnings, and beginnings that a text uses densely, all tied to toxic texts by
the labelled sample) and patterns (several entries at once, none at all, many for the text's length, one again and
again, a dense beginning, shouting, address); the given label is a voter too, and may be outvoted. A generative label model, two classes with a firing rate
of each voter in each, is fitted by expectation maximisation over the sample's votes. From the rates follow each
voter's class and its accuracy, how often that class holds where it fires; a voter that is hardly better than the class's
share counts for nothing, an entry that does not fire abstains, and of voters that fire together beyond what the class explains a group counts as one.
A linear classifier over the entries is then trained on the posterior labels, and it alone scores the texts.

An entry fires from a share of RARE of the text's words on, so that long texts do not gather chance hits; a beginning is
dense from DENSE of the words, and two of them, on.

The sample is bounded by PER_CLASS rows of each label of at most CHARS characters (held-out rows never enter), the
lexicon by VOTERS entries and the classifier by FEATURES. Whole texts are scored, in one Arrow pass. Null and empty
texts get the score of a text without any entry. Without labels of both classes every score is 0. Each input row gives
one output row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import held_out, labelled_texts, table
from chronolith.llm.simhash_bk import fingerprint

PER_CLASS, CHARS = 2000, 12_000
#: Lengths of the word beginnings.
STARTS = (3, 4, 5, 6, 7)
#: Shares of a text's words from which an entry fires, and from which a beginning is dense.
RARE, DENSE = 0.0005, 0.01
#: Lexicon voters, and features of the classifier, at most.
VOTERS, FEATURES = 400, 4096
#: The share of an entry's texts that must be toxic, shrunk.
PURITY = 0.85
#: Voters whose firing correlates so strongly within a class count as one.
TIED = 0.4
#: Share of a text's entries that a training step sees.
KEPT = 0.35
#: Fingerprints of the sample's texts that differ in so few bits count as one text.
ALIKE = 10
CUT = 0.7
#: Words of toxic texts that a beginning stands for, at least.
WIDE = 3
#: How much better than its class's share a voter must be.
BETTER = 0.02
#: Bytes that a worker's remembered tokens take (the memory starts anew beyond it), and characters of the longest one.
REMEMBERED, LONG = 96 << 20, 64

OUT = "doc_id long, held_out boolean, score double, predicted int"
WORD = re.compile(r"[^\W\d_]+")


def entries(token: str) -> list[str]:
    """The words of a token and their beginnings."""
    out = []
    for w in WORD.findall(token):
        out += [w, *(w[:k] + "*" for k in STARTS if len(w) >= k)]
    return out


def firing(counts: dict[str, int], n: int) -> Iterator[str]:
    """What fires in a text of n words by the counts of its entries; a dense beginning fires as p@ too."""
    for e, c in counts.items():
        if c >= RARE * n:
            yield e
            if e[-1] == "*" and c >= 2 and c >= DENSE * n:
                yield e[:-1] + "@"


def entries_of(text: str) -> set[str]:
    counts: Counter[str] = Counter()
    tokens = Counter(text.lower().split())
    for token, c in tokens.items():
        for e in entries(token):
            counts[e] += c
    return set(firing(counts, n_words(tokens)))


def n_words(tokens: Counter[str]) -> int:
    return sum(c for t, c in tokens.items() if not t.isdigit())


def shared_entries(texts: list[str]) -> list[set[str]]:
    """The entries of each text that more than two texts have; rarer ones can be tied to nothing, and they are most."""
    often: Counter[str] = Counter()
    for text in texts:
        often.update(entries_of(text))
    same = {e: e for e, n in often.items() if n > 2}
    del often
    return [{same[e] for e in entries_of(text) if e in same} for text in texts]


def tied(held: list[set[str]], mass: np.ndarray) -> list[str]:
    """Entries tied to the toxic class, the most frequent first; mass: each text's share in the class.

    An entry's likelihood ratio against the class's share must exceed what the best of as many unrelated entries
    would reach by chance, so that few texts give a short lexicon and not a wrong one. A beginning must stand for WIDE
    words: of fewer, the words themselves say all, and it would only meet others by chance.
    """
    everywhere, toxic = Counter(), Counter()
    for own, m in zip(held, mass.tolist(), strict=True):
        everywhere.update(own)
        if m > 0.01:
            for e in own:
                toxic[e] += m
    base = min(max(float(mass.mean()), 1e-6), 1 - 1e-6)
    least = 2 * np.log(1 + sum(n > 2 for n in everywhere.values()))
    spoken = Counter(w[:k] for w in toxic if w[-1] not in "*@" for k in STARTS if len(w) > k)
    good = []
    for e, m in toxic.items():
        n = everywhere[e]
        if e[-1] in "*@" and spoken[e[:-1]] < WIDE:
            continue
        share = m / n
        if n > 2 and m / (n + 1) >= PURITY and share > base:
            ratio = 2 * n * (share * np.log(share / base) + (1 - share) * np.log(max(1 - share, 1e-12) / (1 - base)))
            if ratio >= least:
                good.append((m, e))
    return [e for _, e in sorted(good, key=lambda x: (-x[0], x[1]))]


#: Patterns by name, of (lexicon entries that fire, words, tokens in capitals, all tokens, how often lexicon words occur).
PATTERNS = ("two words", "nothing", "many for its length", "one again and again", "dense beginning", "shouting", "address", "three dense beginnings")


def votes(texts: list[str], held: list[set[str]], lexicon: list[str]) -> np.ndarray:
    """Firing of every voter (text by voter): the lexicon's, then the patterns'."""
    at = {e: j for j, e in enumerate(lexicon)}
    out = np.zeros((len(texts), len(lexicon) + len(PATTERNS)), bool)
    for i, (text, own) in enumerate(zip(texts, held, strict=True)):
        hits = [e for e in own if e in at]
        out[i, [at[e] for e in hits]] = True
        words = WORD.findall(text)
        often = Counter(w.lower() for w in words)
        whole = [e for e in hits if e[-1] not in "*@"]
        dense = sum(e[-1] == "@" for e in hits)
        uses = [often[e] for e in whole]
        shouted = sum(w.isupper() and len(w) > 1 for w in words) > len(words) / 2 > 0
        out[i, len(lexicon) :] = len(whole) >= 2, not hits, sum(uses) >= max(2, DENSE * len(words)), max(uses, default=0) >= 3, dense >= 1, shouted, "you" in own and bool(hits), dense >= 3
    return out


class LabelModel:
    """Firing rates of correlated voters under a hidden class of a given share, by expectation maximisation."""

    def __init__(self, fired: np.ndarray, start: np.ndarray, prior: float, abstains: np.ndarray, given: np.ndarray | None = None, rounds: int = 25):
        f, self.abstains = fired.astype(np.float64), abstains
        post, self.tied, self.prior = start.astype(np.float64), np.eye(f.shape[1]), min(max(prior, 0.01), 0.99)
        for n in range(rounds):
            mixed = post if given is None else (post + given) / 2  # so that voters cannot drift away from the labels
            self.rates = np.stack([(w @ f + 0.1) / (w.sum() + 1.0) for w in (1 - mixed, mixed)])
            self._accuracies()
            if n in (0, rounds // 2):
                self._groups(f, post)
            post = self.posterior(fired)

    def _accuracies(self) -> None:
        """The class that each voter speaks for, and how often that class holds where the voter fires."""
        toxic = self.rates[1] * self.prior / (self.rates[1] * self.prior + self.rates[0] * (1 - self.prior))
        self.speaks = self.rates[1] > self.rates[0]
        self.accuracy = np.where(self.speaks, toxic, 1 - toxic)
        self.useful = self.accuracy > np.where(self.speaks, self.prior, 1 - self.prior) + BETTER * np.where(self.speaks, 1 - self.prior, self.prior)

    def _groups(self, f: np.ndarray, post: np.ndarray) -> None:
        """Which voters the class leaves correlated."""
        rest = f - post[:, None] * self.rates[1] - (1 - post[:, None]) * self.rates[0]
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        self.correlation = rest.T @ rest / len(f) / np.outer(spread, spread)
        self.tied = np.maximum(self.correlation > TIED, np.eye(f.shape[1])).astype(np.float64)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Of each row of votes. A lexicon entry that does not fire abstains, any other voter then votes against; those
        of a group that vote share one vote."""
        f = fired.astype(np.float64)
        acts = np.maximum(f, ~self.abstains) * self.useful
        share = acts / np.maximum(1, acts @ self.tied)
        odds, against = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + (share * f) @ odds + (share * (1 - f)) @ against, -30, 30)))


def linear_loss(w: np.ndarray, b: float, rows: np.ndarray, cols: np.ndarray, post: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross entropy against posterior labels with a small penalty, and its gradient; entry cols[k] is in text rows[k]."""
    z = np.bincount(rows, w[cols], len(post)) + b
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    off = (p - post) / len(post)
    loss = float(np.mean(np.logaddexp(0, z) - post * z) + 1e-5 * w @ w)
    return loss, np.append(np.bincount(cols, off[rows], len(w)) + 2e-5 * w, off.sum())


def fit_linear(held: list[set[str]], post: np.ndarray, steps: int = 300) -> tuple[dict[str, float], float]:
    """Logistic regression on posterior labels over the entries tied to them."""
    chosen = tied(held, post)[:FEATURES]
    at = {e: j for j, e in enumerate(chosen)}
    rows, cols = [], []
    for i, own in enumerate(held):
        hits = sorted(at[e] for e in own if e in at)
        rows += [i] * len(hits)
        cols += hits
    rows_, cols_ = np.array(rows, np.int64), np.array(cols, np.int64)
    w, b = np.zeros(len(chosen)), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    rng = np.random.default_rng(0)
    for t in range(1, steps + 1):
        on = rng.random(len(rows_)) < KEPT  # so that one entry must do where most texts have several
        _, grad = linear_loss(w, b, rows_[on], cols_[on], post)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return {e: float(x) for e, x in zip(chosen, w, strict=True) if abs(x) > 1e-3}, float(b)


def distinct(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without near copies of an earlier text of the same label, whose every word would seem tied to it."""
    prints = np.array([fingerprint(t) for t, _ in sample], np.uint64)
    labels = np.array([y for _, y in sample])
    kept: list[int] = []
    for i in range(len(sample)):
        own = np.array(kept, np.int64)
        if not (np.bitwise_count(prints[own] ^ prints[i])[labels[own] == labels[i]] <= ALIKE).any():
            kept.append(i)
    return [sample[i] for i in kept]


def fit(sample: list[tuple[str, int]]) -> tuple[dict[str, float], float] | None:
    """Weights of entries and the intercept; None without both classes."""
    sample = distinct(sample)
    texts, y = [t for t, _ in sample], np.array([label for _, label in sample])
    if len(set(y.tolist())) < 2:
        return None
    held = shared_entries(texts)
    lexicon = tied(held, y)[:VOTERS]
    fired = votes(texts, held, lexicon)
    start = np.where(fired[:, : len(lexicon)].any(axis=1), 0.9, 0.05)
    fired = np.column_stack([fired, y == 1])  # the given label is one more voter, and may be wrong as well
    abstains = np.arange(fired.shape[1]) < len(lexicon)
    return fit_linear(held, LabelModel(fired, start, float(y.mean()), abstains, y).posterior(fired))


class Scorer:
    """Scores of texts; entries of a token are looked up once."""

    def __init__(self, model: tuple[dict[str, float], float] | None):
        self.model, self.known, self.size = model, {}, 0
        self.asked = {e[:-1] + "*" if e[-1] == "@" else e for e in model[0]} if model else set()

    def score(self, text: str | None) -> float:
        if self.model is None:
            return 0.0
        (weights, total), known = self.model, self.known
        if self.size > REMEMBERED:
            known.clear()
            self.size = 0
        counts: dict[str, int] = {}
        tokens = Counter((text or "").lower().split())
        for token, c in tokens.items():
            if (own := known.get(token)) is None:
                own = [e for e in entries(token) if e in self.asked]
                if len(token) <= LONG:
                    known[token] = own
                    self.size += 2 * len(token) + 160
            for e in own:
                counts[e] = counts.get(e, 0) + c
        if counts:
            found = sorted(e for e in firing(counts, n_words(tokens)) if e in weights)
            total += sum(weights[e] for e in found)
        return 1 / (1 + float(np.exp(-np.clip(total, -30, 30))))


def score_toxicity(docs: DataFrame, model: tuple[dict[str, float], float] | None, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted per document. The model has FEATURES weights at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(each, OUT)


def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(labelled_texts(docs, table(spark, sf_dir, "labels"), "toxic", PER_CLASS, CHARS)))


QUERIES = {"op10_weak_toxicity": op10_weak_toxicity}
ORACLES: dict[str, str] = {}
