"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A document is cut greedily into the longest phrases
that occur in that text; the language whose automaton needs the fewest phrases, per character and relative to what
other labelled text of that language needs, wins. Automata are dense
tables (state by letter), and a batch's texts advance through all languages in step, one array operation a position.

Texts are read as lower-case letters with anything else as one space; whole texts are parsed, in segments of SEGMENT
characters whose phrase counts add up. The labelled text is a bounded sample, stated by its parameters: per language
the rows of the DOCS lowest hashes of (doc_id, text), from each a passage of CHARS characters at a place given by the
hash; every label that is not null is learned. The sample goes to the workers as text (at most DOCS * CHARS characters
a language). Each worker builds the automata once; of more than TOGETHER languages it holds the automata of TOGETHER at
a time, and goes over each stretch of texts (MANY_AT_ONCE characters) once for every such part.

Null texts and texts without any letter get `und` and score 0. With no labelled rows every text gets `und`. Ties go
to the first language by name. Each input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from chronolith.llm.common import carried, first_of_each, held_out, resident, table

DOCS, CHARS = 240, 160
#: Languages whose automata a worker holds at once.
TOGETHER = 64
SEGMENT = 1024
#: Characters that advance at once, over all languages: bounds a worker's memory.
AT_ONCE = 4_000_000
#: The same where automata must be built again for each stretch of texts.
MANY_AT_ONCE = 4 * AT_ONCE
#: How sharply the score follows the lead in phrases.
SHARPNESS = 6.0

OUT = "doc_id long, held_out boolean, lang_pred string, score double, n_phrases long"

NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a letter; the pattern also finds numerals such as fractions."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def plain(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower())


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """The automaton's transitions as a table: state by code, -1 where there is none. State 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(go), width), -1, np.int32)
    for state, edges in enumerate(go):
        if edges:
            out[state, list(edges.keys())] = list(edges.values())
    return out


class Parser:
    """The languages' automata and the phrase counts of texts under each."""

    def __init__(self, sample: list[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        for lang, text in sample:
            by.setdefault(lang, []).append(plain(text))
        self.langs = sorted(by)
        # every fourth passage stays out of the automata: it shows how many phrases its own language usually needs
        apart = {lang: texts[::4] if len(texts) >= 12 else [] for lang, texts in by.items()}
        by = {lang: [t for i, t in enumerate(texts) if i % 4 or not apart[lang]] for lang, texts in by.items()}
        letters = sorted({c for texts in by.values() for t in texts for c in t} | {" "})
        self.width = len(letters) + 1
        self.code = np.zeros(0x110000, np.uint16)  # 0: letters of no language
        for i, c in enumerate(letters, 1):
            self.code[ord(c)] = i
        tables, base = [], 0
        for lang in self.langs:
            # passages are told apart by a code that texts never have, so no phrase runs over two of them
            codes = [c for t in by[lang] for c in [*self.code[[ord(x) for x in t]].tolist(), self.width]]
            t = suffix_automaton(codes, self.width + 1)[:, : self.width]
            tables.append(np.where(t >= 0, t + base, -1))
            base += len(t)
        self.roots = np.array([0, *np.cumsum([len(t) for t in tables])[:-1]], np.int32) if tables else np.zeros(0, np.int32)
        self.step = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)
        self.usual = np.ones(len(self.langs))
        for j, lang in enumerate(self.langs):
            if apart[lang]:
                counts, sizes = self.phrases(apart[lang])
                self.usual[j] = counts[:, j].sum() / sizes.sum()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrase counts (text by language) and the characters of each text."""
        n, k = len(texts), len(self.langs)
        counts, sizes = np.zeros((n, k), np.int64), np.array([len(t) for t in texts], np.int64)
        pieces = [(i, t[a : a + SEGMENT]) for i, t in enumerate(texts) for a in range(0, len(t), SEGMENT)]
        pieces.sort(key=lambda p: -len(p[1]))
        most = max(1, AT_ONCE // (SEGMENT * max(1, k)))
        for a in range(0, len(pieces), most):
            self._lockstep(pieces[a : a + most], counts)
        return counts, sizes

    def _lockstep(self, pieces: list[tuple[int, str]], counts: np.ndarray) -> None:
        lengths = np.array([len(p[1]) for p in pieces])
        codes = np.zeros((lengths[0], len(pieces)), np.int32)
        for j, (_, text) in enumerate(pieces):
            codes[: len(text), j] = self.code[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        k = len(self.langs)
        roots = np.repeat(self.roots[:, None], len(pieces), axis=1)
        state, ended = roots.copy(), np.zeros((k, len(pieces)), np.int64)
        width, alive = self.width, len(pieces)
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # pieces longer than t
        for t, alive in enumerate(active.tolist()):
            c = codes[t, :alive]
            now = state[:, :alive]
            to = self.step[now * width + c]
            if (stop := to < 0).any():
                again = self.step[roots[:, :alive] * width + c]
                # a letter that the language lacks ends the phrase before it and is one of its own
                ended[:, :alive] += stop
                ended[:, :alive] += stop & (again < 0) & (now != roots[:, :alive])
                to = np.where(stop, np.where(again >= 0, again, roots[:, :alive]), to)
            state[:, :alive] = to
        ended += state != roots  # the phrase that the end of the text cuts off
        np.add.at(counts, [p[0] for p in pieces], ended.T)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        return predicted([self], texts)


class Parts:
    """The parsers of all languages, TOGETHER languages each, by name. One part is kept, of several one at a time is built."""

    def __init__(self, sample: list[tuple[str, str]]):
        by: dict[str, list[tuple[str, str]]] = {}
        for row in sample:
            by.setdefault(row[0], []).append(row)
        langs = sorted(by)
        self.samples = [[row for lang in langs[a : a + TOGETHER] for row in by[lang]] for a in range(0, len(langs), TOGETHER)]
        self.only = Parser(sample) if len(self.samples) < 2 else None
        self.at_once = AT_ONCE if self.only else MANY_AT_ONCE

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        return self.only.predict(texts) if self.only else predicted((Parser(s) for s in self.samples), texts)


def predicted(parsers: Iterable[Parser], texts: list[str | None]) -> list[tuple[str, float, int]]:
    """(language, score, phrases) of each text, over the languages of all parsers, which come in the order of their names."""
    out: list[tuple[str, float, int]] = [("und", 0.0, 0)] * len(texts)
    asked = [i for i, t in enumerate(texts) if t and has_letter(t)]
    if not asked:
        return out
    read, langs, counts, rates = [plain(texts[i]) for i in asked], [], [], []
    for parser in parsers:
        if parser.langs:
            c, sizes = parser.phrases(read)
            langs += parser.langs
            counts.append(c)
            rates.append(c / sizes[:, None] / parser.usual)
    if langs:
        for i, c, rate in zip(asked, np.hstack(counts), np.hstack(rates), strict=True):
            best = int(rate.argmin())
            weight = np.exp(-SHARPNESS * (rate - rate[best]))
            out[i] = langs[best], float(1 / weight.sum()), int(c[best])
    return out


def labelled_sample(docs: DataFrame, docs_per_lang: int = DOCS, chars: int = CHARS) -> list[tuple[str, str]]:
    """(lang, passage) of rows that are not held out; at most docs_per_lang rows of each language reach the driver."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("text") != ""))
    place = F.expr(f"1 + pmod(xxhash64(doc_id), greatest(1, length(text) - {chars} + 1))")
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), "doc_id", F.substring(F.col("text"), place, F.lit(chars)).alias("passage"))
    first = first_of_each(rows, "lang", ["h", "doc_id"], docs_per_lang)
    got = first.select("lang", "passage", "r").collect()
    return [(r.lang, r.passage) for r in sorted(got, key=lambda r: (r.lang, r.r))]


def identify(docs: DataFrame, sample: list[tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """One row per document with the language, its score and the phrases it needed. No shuffle.

    keep: columns of docs that go along beside text, in place of doc_id and held_out.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(sample), str(hash(tuple(sample)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = resident(("languages", key), lambda: Parts(shared.value))
        for batch in batches:
            texts, found, taken = batch.column(0), [], []
            size = 0
            for i in range(len(texts)):
                taken.append(t := texts[i].as_py())
                size += len(t or "")
                if size > parser.at_once:
                    found += parser.predict(taken)
                    taken, size = [], 0
            found += parser.predict(taken)
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64()))]
            first = 0 if keep is not None else 1
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], *made], names=[*batch.schema.names[first:], "lang_pred", "score", "n_phrases"])

    if keep is None:
        frame = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
        return frame.mapInArrow(each, OUT)
    frame = docs.select("text", *keep)
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_phrases", LongType())]
    return frame.mapInArrow(each, carried(frame, frame.columns, *made))


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, labelled_sample(docs))


QUERIES = {"op5_cross_parsing": op5_cross_parsing}
ORACLES: dict[str, str] = {}
