"""Byte-level BPE encoding and decoding through a sentencepiece model.

The rank file is turned into a sentencepiece BPE model: every byte of a token becomes one printable character,
a piece's score is its negative rank and the normaliser is the identity, so the library's merges pick the same
pair as the rank order does. Each match of the split pattern is encoded on its own; ids are the ranks. A few
tokens of a vocabulary may not be reachable by merges; since a whole match that is itself a token is one id,
those are looked up first. Decoding maps ids back to their bytes.

Null and empty texts have no ids (digest of nothing). Rows, ties and repeats are handled one by one: every input
row gives one output row. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronolith.llm.common import resident, table

#: Pieces of the model that stand before the vocabulary: <unk>.
SHIFT = 1
#: Bytes that a worker's remembered matches take (the memory starts anew beyond it), and characters of the longest one.
REMEMBERED, LONG = 64 << 20, 256

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model file. Field numbers are those of the public sentencepiece_model.proto."""
    chars = byte_chars()
    out = bytearray(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(ranks) + SHIFT) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Splitter:
    """Matches of the split pattern under the Unicode version of the rank files' own library.

    The regex library follows a later Unicode version, by which some characters change between letter, number and
    neither. Where regex and Python's tables disagree, that library's pattern engine is asked: with a vocabulary that
    merges a letter or a digit with any first byte of a character, the merge shows whether both are in one match.
    Texts that hold a character with another class there are split over a copy in which a plain character of the
    right class stands in; the spans are then those of the text.
    """

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.find, self.spans = (p := regex.compile(pattern)).findall, p.finditer
        every = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
        newer = dict.fromkeys(every, "!") | dict.fromkeys(regex.findall(r"\p{L}", every), "x") | dict.fromkeys(regex.findall(r"\p{N}", every), "1")
        older = {"L": "x", "N": "1"}
        pairs = [bytes([first, b]) for first in b"x1" for b in range(128, 256)]
        asked = tiktoken.Encoding("classes", pat_str=pattern, special_tokens={}, mergeable_ranks={t: i for i, t in enumerate([bytes([b]) for b in range(256)] + pairs)})
        joins = lambda first, c: asked.encode_ordinary(first + c)[0] >= 256
        self.other = {}
        for c in every:
            if older.get(unicodedata.category(c)[0], "!") != newer[c]:
                want = next((first for first in "x1" if joins(first, c)), "!")
                if want != newer[c]:
                    self.other[ord(c)] = want
        ranges, last = [], -2
        for c in sorted(self.other):
            if c != last + 1:
                ranges.append([c, c])
            ranges[-1][1] = last = c
        self.odd = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]").search if ranges else lambda _: None

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.odd(text):
            return self.find(text)
        return [text[m.start() : m.end()] for m in self.spans(text.translate(self.other))]


class Codec:
    """Encoder and decoder of one vocabulary; made once for each Python worker."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        order = sorted(self.ranks.items(), key=lambda x: x[1])
        self.id_of_piece = np.array([0] + [rank for _, rank in order], dtype="<u4")
        self.bytes_of = {rank: token for token, rank in order}
        self.chars = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = Splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _learn(self, matches: set[str]) -> None:
        """Remembers the ids of new matches, four bytes each."""
        asked = []
        for match in matches:
            raw = match.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[match] = struct.pack("<I", rank)
            else:
                asked.append((match, raw.decode("latin-1").translate(self.chars)))
        for (match, _), pieces in zip(asked, self.model.encode([x for _, x in asked], num_threads=1) if asked else [], strict=True):
            self.known[match] = self.id_of_piece[pieces].tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        matches = self.split(text or "")
        try:
            return b"".join(map(self.known.__getitem__, matches))
        except KeyError:
            if self.size > REMEMBERED:
                self.known.clear()
                self.size = 0
            self._learn(new := {x for x in matches if x not in self.known})
            out = b"".join(map(self.known.__getitem__, matches))
            for x in new:
                if len(x) > LONG:
                    del self.known[x]
            self.size += sum(2 * len(x) + 128 for x in new if len(x) <= LONG)
            return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return resident(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes they decode to; with keep_ids also the ids themselves.

    No shuffle: one Arrow pass over (doc_id, text). path is the rank file, which every executor's tokenizers hold.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids_digest, bytes_digest, kept = [], [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py())
                counts.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                bytes_digest.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(bytes_digest, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(each, OUT + (", ids binary" if keep_ids else ""))


def op7_byte_bpe_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op7_byte_bpe_piece": op7_byte_bpe_piece}
ORACLES: dict[str, str] = {}
