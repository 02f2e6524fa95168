"""Token-id files by bit-plane shuffling.

A shard holds the ids of a range of documents in ascending doc_id order. Ids are cut into blocks of BLOCK; a block,
as little-endian unsigned 32-bit integers, is transposed into its 4 byte planes (or 32 bit planes), and every plane is
compressed with zstandard on its own, so that planes that hardly change cost next to nothing. The chunk index and the
document index stand at the end:

    magic | chunks: plane after plane | footer (zstandard) | footer offset u64, length u64, magic
    footer: header (block u32, planes u32, end id u32, n_chunks u64, n_docs u64, n_ids u64) |
            chunk offset u64[], ids u32[], plane lengths u32[] | doc_id i64[], present u8[], n_tokens u64[]

Documents are range-partitioned by (doc_id, hash of the text), sorted, tokenised and written in one pass; a task's file
has a name of its own, and only the names that finished tasks return enter the manifest, so that lost or repeated
attempts leave nothing but unlisted files. The manifest (one line a shard) holds the number of ids before each shard.

Null texts are empty and have the end id alone. A null doc_id sorts first. Repeated rows stay, in the order of their
texts' hashes. An empty table gives an empty manifest and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import Workspace, resident, table

MAGIC = b"BPLN0001"
BLOCK = 1 << 16
HEADER = "<IIIQQQ"
#: Bytes that a worker's remembered pieces take (the memory starts anew beyond it), and the length of the longest one.
REMEMBERED, LONG = 192 << 20, 256
#: Documents that are tokenised in one call of the library.
TOGETHER = 1024

#: The combining marks that compose with a letter of A-Z or a-z are U+0300 to U+036F.
MARKS = re.compile(rb"\xcc[\x80-\xbf]|\xcd[\x80-\xaf]").search
#: The beginning of a piece that may be letters, and what follows.
APART = re.compile(rb"([A-Za-z\x80-\xff]*)([^\n]*)\n").findall

SHARD = "shard int, path string, n_docs long, n_ids long, n_bytes long"
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte planes (or bit planes) of a block, lowest first."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(octets[:, i]).tobytes() for i in range(4)]
    each = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(each[:, i])).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard to an open stream; memory holds one block and the document index."""

    def __init__(self, stream, end_id: int, block: int = BLOCK, bits: bool = False):
        self.out, self.end_id, self.block, self.bits = stream, end_id, block, bits
        self.press = zstandard.ZstdCompressor(level=1)
        self.at, self.n_ids, self.waiting, self.held = len(MAGIC), 0, [], 0
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.doc_ids: list[int] = []
        self.present = bytearray()
        self.lengths: list[int] = []
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        ids += struct.pack("<I", self.end_id)
        self.doc_ids.append(doc_id or 0)
        self.present.append(doc_id is not None)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block:
            every = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(every) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(every[i : i + self.block])
            self.waiting, self.held = [every[whole:].tobytes()], len(every) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        pressed = [self.press.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.at, len(ids), [len(p) for p in pressed]))
        self.n_ids += len(ids)
        for p in pressed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes written."""
        if self.held:
            self._chunk(np.frombuffer(b"".join(self.waiting), "<u4"))
        planes = 32 if self.bits else 4
        body = struct.pack(HEADER, self.block, planes, self.end_id, len(self.chunks), len(self.doc_ids), self.n_ids)
        body += np.array([c[0] for c in self.chunks], "<u8").tobytes() + np.array([c[1] for c in self.chunks], "<u4").tobytes()
        body += np.array([c[2] for c in self.chunks], "<u4").reshape(-1).tobytes()
        body += np.array(self.doc_ids, "<i8").tobytes() + bytes(self.present) + np.array(self.lengths, "<u8").tobytes()
        footer = self.press.compress(body)
        self.out.write(footer + struct.pack("<QQ", self.at, len(footer)) + MAGIC)
        return len(self.doc_ids), self.n_ids, self.at + len(footer) + 16 + len(MAGIC)


class ShardReader:
    """Reads a shard through its indexes; chunks are read one at a time."""

    def __init__(self, source):
        self.source, tail = source, 16 + len(MAGIC)
        size = source.size()
        source.seek(size - tail)
        at, length, magic = struct.unpack(f"<QQ{len(MAGIC)}s", source.read(tail))
        if magic != MAGIC:
            raise ValueError("not a bit-plane shard, or cut short")
        source.seek(at)
        body, pos = zstandard.ZstdDecompressor().decompress(source.read(length)), struct.calcsize(HEADER)
        self.block, self.planes, self.end_id, n_chunks, n_docs, self.n_ids = struct.unpack_from(HEADER, body)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal pos
            got = np.frombuffer(body, kind, n, pos)
            pos += got.nbytes
            return got

        self.offsets, self.sizes, self.plane_sizes = take("<u8", n_chunks), take("<u4", n_chunks), take("<u4", n_chunks * self.planes).reshape(-1, self.planes)
        self.doc_ids, self.present, self.lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)

    def chunk(self, i: int) -> np.ndarray:
        self.source.seek(int(self.offsets[i]))
        raw, sizes = self.source.read(int(self.plane_sizes[i].sum())), self.plane_sizes[i].tolist()
        press, planes, at = zstandard.ZstdDecompressor(), [], 0
        for n in sizes:
            planes.append(press.decompress(raw[at : at + n]))
            at += n
        return from_planes(planes, int(self.sizes[i]))

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids [start, stop) of the shard: only the chunks that hold them are read."""
        first, last = start // self.block, max(start, stop - 1) // self.block
        every = np.concatenate([self.chunk(i) for i in range(first, min(last + 1, len(self.sizes)))] or [np.zeros(0, "<u4")])
        return every[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids in order, a chunk in memory at a time."""
        chunks, held = (self.chunk(i) for i in range(len(self.sizes))), np.zeros(0, "<u4")
        for doc_id, present, n in zip(self.doc_ids.tolist(), self.present.tolist(), self.lengths.tolist(), strict=True):
            parts, need = [], n
            while need:
                if not len(held):
                    held = next(chunks)
                parts.append(held[:need])
                need -= len(parts[-1])
                held = held[len(parts[-1]) :]
            yield (doc_id if present else None), parts[0] if len(parts) == 1 else np.concatenate(parts)


class Pieces:
    """Ids of texts by the tokenizers library, with the pieces between ASCII white space remembered.

    The vocabulary's splits drop white space and part letters from punctuation, and its normaliser (NFC, then lower
    case) joins no characters across either, so a text's ids are those of its pieces one after the other. A-Z are
    lowered beforehand, unless a combining mark might then compose or a special token come about.
    """

    #: Stands between new pieces in one call of the library; a control character that is a token of its own.
    MARK = b"\x01"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.size, self.long = 0, []
        mark = self._ids([self.MARK])
        self.mark = int(mark[0]) if len(mark) == 1 else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a run of letters
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, pieces: list[bytes], between: bytes = b" ") -> np.ndarray:
        """Ids of all pieces, one after the other. Short strings are cheaper for the library than a long one."""
        texts = [between.join(pieces[a : a + 64]).decode() for a in range(0, len(pieces), 64)]
        ids: list[int] = []
        for n, got in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            if n and between != b" ":
                ids.append(self.mark)
            ids += got.ids
        return np.array(ids, "<u4")

    def _learn(self, pieces: set[bytes]) -> None:
        known, new, rest = self.known, [], []
        cores = {}
        # a run of what are letters after normalisation is split from what follows, so both parts are learnt apart
        for piece, (core, tail) in zip(pieces, APART(b"\n".join(pieces) + b"\n"), strict=True):
            if core and (core.isascii() or unicodedata.normalize("NFC", core.decode()).lower().isalpha()):
                if core not in known:
                    cores[core] = None
                if tail:
                    new.append((piece, core, tail))
                    if tail not in known:
                        rest.append(tail)
            else:
                rest.append(piece)
        letters = list(cores)
        ids = self._ids(letters)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(letters):  # a run of letters ends with one such token
            raw, at = ids.tobytes(), 0
            for piece, stop in zip(letters, (4 * stops).tolist(), strict=True):
                known[piece] = raw[at:stop]
                at = stop
        else:
            self._marked(letters)
        self._marked(list(dict.fromkeys(rest)))
        for piece, core, tail in new:
            known[piece] = known[core] + known[tail]
        for group in (pieces, letters, rest):
            self.long += [p for p in group if len(p) > LONG]
            self.size += sum(2 * len(p) + 128 for p in group if len(p) <= LONG)

    def _marked(self, pieces: list[bytes]) -> None:
        """Learns any pieces: one call for those without the mark, one each for the others."""
        plain = [p for p in pieces if self.mark is not None and self.MARK not in p]
        ids = self._ids(plain, b" %s " % self.MARK)
        raw, at = ids.tobytes(), 0
        stops = [*(4 * np.flatnonzero(ids == self.mark)).tolist(), len(raw)] if plain else []
        for piece, stop in zip(plain, stops, strict=True):
            self.known[piece] = raw[at:stop]
            at = stop + 4
        for piece in pieces:
            if piece not in self.known:
                self.known[piece] = self._ids([piece]).tobytes()

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, four bytes each."""
        known, cut, new = self.known, [], set()
        if self.size > REMEMBERED:
            known.clear()
            self.size = 0
        for raw in texts:
            cut.append((raw if b"<|" in raw or not raw.isascii() and MARKS(raw) else raw.lower()).split())
            new.update(cut[-1])
        if new := {p for p in new if p not in known}:
            self._learn(new)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for piece in self.long:
            known.pop(piece, None)
        self.long.clear()
        return out


def pieces_of(path: str) -> Pieces:
    return resident(("pieces", path), lambda: Pieces(path))


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block: int = BLOCK, bits: bool = False) -> list[tuple[str, int, int]]:
    """Writes the shards and the manifest; returns (path, documents, ids before it) of every shard that has documents.

    What comes to the driver is one row per task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, own, writer, stream, path = TaskContext.get().partitionId(), pieces_of(tokenizer), None, None, ""
        for batch in batches:
            if writer is None and batch.num_rows:
                files, root = pafs.FileSystem.from_uri(folder)
                files.create_dir(root, recursive=True)
                path = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex[:8]}.bpl"
                stream = files.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}")
                writer = ShardWriter(stream, end_id, block, bits)
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                for doc_id, ids in zip(some.column(0).to_pylist(), own.encode_all([t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]), strict=True):
                    writer.add(doc_id, ids)
        if writer is not None:
            n_docs, n_ids, n_bytes = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes]})

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) h").repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    shards, before, listed = sorted(ordered.select("doc_id", "text").mapInArrow(each, SHARD).collect(), key=lambda r: r.shard), 0, []
    for r in shards:
        listed.append((r.path, r.n_docs, before))
        before += r.n_ids
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.tsv") as out:
        out.write("".join(f"{path}\t{n}\t{start}\n" for path, n, start in listed).encode())
    return listed


def read_token_shards(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document that the folder's manifest lists."""
    files, root = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/manifest.tsv") as f:
        listed = [line.split("\t") for line in f.read().decode().splitlines()]
    schema = OUT + (", ids binary" if keep_ids else "")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.binary()] * keep_ids
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, at = pafs.FileSystem.from_uri(path)
                with own.open_input_file(at) as source:
                    rows = []
                    for doc_id, ids in ShardReader(source).documents():
                        raw = ids.astype("<u4", copy=False).tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(raw), *([raw] if keep_ids else [])))
                        start += len(ids)
                        if len(rows) >= 4096:
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)

    if not listed:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(path, int(start)) for path, _, start in listed], "path string, start long")
    return shards.repartition(len(listed)).mapInArrow(each, schema)


def op1_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Workspace(spark, "bitplane").at("ids")
    write_token_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_shards(spark, folder)


QUERIES = {"op1_bitplane_ids": op1_bitplane_ids}
ORACLES: dict[str, str] = {}
