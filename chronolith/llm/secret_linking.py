"""Secret scan with multipart credential linking.

Base spans come from three patterns: assignments with a value of 12 or more characters, access identifiers of 18 or
more, hexadecimal runs of 16 or more. To these the linker adds weak candidates (login names, high-entropy tokens,
endpoints; of any length from their least on), which alone mean nothing: within a scope (the candidate's interval widened by WINDOW characters and
clipped at blank lines) the intervals of the three roles identifier, secret and endpoint are joined, and a weak
candidate is reported only when a strong part of another role, or parts of both other roles, overlap its scope.

Spans are code points, end exclusive. Null and empty texts have no spans. Each input row gives one output row,
repeats included; extra columns are ignored. Documents are scanned on their own and whole, in O(n log n).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from chronolith.llm.common import carried, table

#: Characters on either side of a weak candidate in which complementary parts count.
WINDOW = 400

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs, so that the shorter ones may be skipped while matching
KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")

LOGIN = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account|client_?id|access_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])", re.ASCII)
ENDPOINT = re.compile(r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{3,}|\b(?:host(?:name)?|endpoint|server|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?""", re.IGNORECASE | re.ASCII)
BLANK = re.compile(r"\n[\x20\t\r]*\n")

#: role of each kind, and whether one such part is evidence by itself
ROLE = {"assign": ("secret", True), "access": ("identifier", True), "hex": ("secret", False), "login": ("identifier", False), "opaque": ("secret", False), "endpoint": ("endpoint", False)}

OUT = [*(StructField(n, LongType()) for n in ("n_assign", "n_access", "n_hex")), StructField("base_sha256", StringType()), StructField("spans", StringType())]

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The spans of the three base kinds, by start and then kind."""
    low = text.lower()
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if any(k in low for k in KEYWORDS) else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def opaque(token: str) -> bool:
    """Digits, capitals and small letters mixed with little repetition."""
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token) and entropy(token) >= 3.5


class Intervals:
    """Overlap queries over intervals: sorted by start, with the furthest end so far."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts, self.reach, most = [s[0] for s in spans], [], 0
        for s in spans:
            self.reach.append(most := max(most, s[1]))

    def overlap(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start


def linked_spans(text: str, base: list[Span], window: int = WINDOW) -> list[Span]:
    """Weak candidates whose complementary parts co-occur in their scope."""
    ends = [m.end() for m in ENDPOINT.finditer(text)] if "://" in text or re.search("host|endpoint|server|region", text, re.IGNORECASE) else []
    if not ends and not any(ROLE[s[2]][1] for s in base):
        return []  # neither strong evidence nor all three roles can occur
    taken = Intervals(base)
    weak = [(m.start(), m.end(), kind) for kind, pattern in (("login", LOGIN), ("opaque", OPAQUE), ("endpoint", ENDPOINT)) for m in pattern.finditer(text) if (kind != "opaque" or opaque(m[0])) and not taken.overlap(m.start(), m.end())]
    urls = Intervals([s for s in weak if s[2] == "endpoint"])
    weak = [s for s in weak if s[2] == "endpoint" or not urls.overlap(s[0], s[1])]
    if not weak:
        return []
    parts = [*base, *weak]
    strong = {role: Intervals([s for s in base if ROLE[s[2]] == (role, True)]) for role in ("identifier", "secret", "endpoint")}
    every = {role: Intervals([s for s in parts if ROLE[s[2]][0] == role]) for role in ("identifier", "secret", "endpoint")}
    gaps = [(m.start(), m.end()) for m in BLANK.finditer(text)]
    gap_ends, gap_starts = [g[1] for g in gaps], [g[0] for g in gaps]
    out = []
    for start, end, kind in weak:
        before, after = bisect_left(gap_ends, start + 1), bisect_left(gap_starts, end)
        low = max(start - window, gap_ends[before - 1] if before else 0)
        high = min(end + window, gap_starts[after] if after < len(gap_starts) else len(text))
        others = [role for role in every if role != ROLE[kind][0]]
        if any(strong[role].overlap(low, high) for role in others) or all(every[role].overlap(low, high) for role in others):
            out.append((start, end, kind))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by its first kind in brackets."""
    out, last = [], 0
    for start, end, kind in in_order(spans):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def scan_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per document with counts, digest and spans. One Arrow pass, no shuffle.

    keep: columns of docs that go along beside `text`, which then has every span masked, in place of doc_id.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for value in batch.column(0):
                raw = value.as_py()
                text = raw or ""
                base = base_spans(text)
                spans = in_order([*base, *linked_spans(text, base)])
                count = Counter(s[2] for s in base)
                rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
                if keep is not None:
                    texts.append(redacted(text, spans) if spans else raw)
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int64()] * 3 + [pa.string()] * 2)]
            first = [] if keep is None else [pa.array(texts, pa.string())]
            names = batch.schema.names[0 if first else 1 :]
            yield pa.RecordBatch.from_arrays([*first, *batch.columns[1:], *made], names=[*names, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    frame = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")) if keep is None else docs.select("text", *keep)
    return frame.mapInArrow(each, carried(frame, frame.columns[0 if keep is not None else 1 :], *OUT))


def op4_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op4_secret_linking": op4_secret_linking}
ORACLES: dict[str, str] = {}
