"""Byte-level kernels: object headers, packs, deltas, trees, commits, line alignment, Bloom filters.

Plain Python without Spark; the readers and Arrow functions call them inside tasks.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

from chronolith.errors import CorruptedObject, LimitExceeded, MalformedObject
from chronolith.schemas import LIMITS, OBJECT_TYPES, TREE_MODES

PACK_TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "ofs_delta", 7: "ref_delta"}


def inflate(data: bytes, limit: int = LIMITS["loose_object_max"]) -> bytes:
    """One zlib stream of less than `limit` bytes, checksum included."""
    return inflate_prefix(data, limit)[0]


def inflate_prefix(data: bytes | memoryview, limit: int) -> tuple[bytes, int]:
    """The stream at the start of data, and how many bytes of data it took."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, limit)
        if len(out) >= limit:
            raise LimitExceeded(f"{limit} bytes or more")
        while not stream.eof:  # the checksum is read only when the stream is drained
            more = stream.decompress(stream.unconsumed_tail, limit)
            if not more and not stream.eof:
                raise CorruptedObject("stream cut short")
            out += more
            if len(out) >= limit:
                raise LimitExceeded(f"{limit} bytes or more")
    except zlib.error as e:
        raise CorruptedObject(str(e)) from e
    return out, len(data) - len(stream.unused_data)


def inflate_at(data, at: int, end: int, limit: int) -> bytes:
    """The stream that begins at a place of data, read in pieces no longer than it may need."""
    stream, out = zlib.decompressobj(), bytearray()
    try:
        while not stream.eof:
            piece = stream.unconsumed_tail
            if not piece:
                piece = data[at : min(end, at + max(512, limit - len(out)))]
                at += len(piece)
                if not piece:
                    raise CorruptedObject("stream cut short")
            out += stream.decompress(piece, limit - len(out) + 1)
            if len(out) >= limit:
                raise LimitExceeded(f"{limit} bytes or more")
    except zlib.error as e:
        raise CorruptedObject(str(e)) from e
    return bytes(out)


def object_id(kind: str, content: bytes) -> str:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(content)) + content).hexdigest()


def loose_bytes(kind: str, content: bytes) -> bytes:
    """A loose object's file."""
    return zlib.compress(b"%s %d\0" % (kind.encode(), len(content)) + content)


def parse_loose(raw: bytes) -> tuple[str, bytes]:
    """Type and content of an inflated loose object; the declared size must be the real one."""
    head, nul, content = raw.partition(b"\0")
    kind, space, size = head.partition(b" ")
    if not nul or not space or kind.decode("latin-1") not in OBJECT_TYPES or not size.isdigit():
        raise MalformedObject("object header")
    if int(size) != len(content):
        raise CorruptedObject("object size")
    return kind.decode(), content


def read_loose(data: bytes, oid: str, limit: int = LIMITS["loose_object_max"]) -> tuple[str, bytes]:
    if len(data) >= limit:
        raise LimitExceeded("loose object")
    raw = inflate(data, limit)
    found = parse_loose(raw)
    if hashlib.sha1(raw).hexdigest() != oid:
        raise CorruptedObject("object id")
    return found


# --- packs -----------------------------------------------------------------------------------------------------------


class PackIndex:
    """The index of one pack, version 2. Ids and offsets stay arrays; only what is asked for becomes Python objects."""

    def __init__(self, data: bytes):
        n = index_count(data)
        if len(data) < 8 + 1024 + 28 * n + 40:
            raise CorruptedObject("index fanout")
        at = 8 + 1024
        self.n, self.ids = n, np.frombuffer(data, np.uint8, 20 * n, at).reshape(n, 20)
        at += 24 * n
        small = np.frombuffer(data, ">u4", n, at).astype(np.int64)
        at += 4 * n
        more, rest = divmod(len(data) - 40 - at, 8)
        if rest:
            raise CorruptedObject("index length")
        far = small >> 31 == 1
        if (small[far] & 0x7FFFFFFF >= more).any():
            raise CorruptedObject("index offset")
        if far.any():
            small[far] = np.frombuffer(data, ">u8", more, at).astype(np.int64)[small[far] & 0x7FFFFFFF]
        self.places, self.pack_sha = small, data[-40:-20]
        self.heads = np.ascontiguousarray(self.ids[:, :8]).view(">u8").reshape(-1).astype(np.uint64)

    @property
    def oids(self) -> list[str]:
        return [row.tobytes().hex() for row in self.ids]

    @property
    def offsets(self) -> list[int]:
        return self.places.tolist()

    def find(self, oid: str) -> int | None:
        """The offset of an object, by halving."""
        raw = bytes.fromhex(oid)
        first = int(np.searchsorted(self.heads, np.uint64(int.from_bytes(raw[:8], "big"))))
        while first < self.n and self.ids[first, :8].tobytes() == raw[:8]:
            if self.ids[first].tobytes() == raw:
                return int(self.places[first])
            first += 1
        return None

    def in_pack_order(self, start: int, stop: int) -> list[tuple[int, str]]:
        """(offset, id) of the objects from the start-th to the stop-th place of the pack."""
        chosen = np.argsort(self.places, kind="stable")[start:stop]
        return [(int(self.places[i]), self.ids[i].tobytes().hex()) for i in chosen]


def index_count(head: bytes) -> int:
    """Objects that an index lists, from its first 1,032 bytes."""
    if len(head) < 8 + 1024:
        raise MalformedObject("index too short")
    magic, version = struct.unpack_from(">4sI", head)
    if magic != b"\xfftOc" or version != 2:
        raise MalformedObject("index magic or version")
    fanout = np.frombuffer(head, ">u4", 256, 8)
    if (fanout[:-1] > fanout[1:]).any():
        raise CorruptedObject("index fanout")
    return int(fanout[255])


def check_pack(data: bytes, index: PackIndex | None = None) -> int:
    """Header, trailer and, if given, that the index is this pack's; the number of objects."""
    if len(data) < 32:
        raise MalformedObject("pack too short")
    magic, version, n = struct.unpack_from(">4sII", data)
    if magic != b"PACK" or version != 2:
        raise MalformedObject("pack magic or version")
    if hashlib.sha1(memoryview(data)[:-20]).digest() != data[-20:]:
        raise CorruptedObject("pack trailer")
    if index is not None and index.pack_sha != data[-20:]:
        raise CorruptedObject("index of another pack")
    return n


def read_entry(data: bytes, offset: int, limit: int = LIMITS["pack_object_max"]) -> tuple[str, int, int | None, str | None, bytes]:
    """(type, declared size, base offset, base id, inflated data) of the entry at an offset."""
    end = len(data) - 20

    def byte(i: int) -> int:
        if not 12 <= i < end:
            raise MalformedObject("pack entry out of bounds")
        return data[i]

    at, c = offset + 1, byte(offset)
    code, size, shift = c >> 4 & 7, c & 15, 4
    while c & 128:
        c = byte(at)
        at += 1
        size |= (c & 127) << shift
        shift += 7
        if shift > 64:
            raise MalformedObject("entry size")
    if code not in PACK_TYPES:
        raise MalformedObject("entry type")
    if size > limit:
        raise LimitExceeded("pack object")
    base_offset = base_oid = None
    if code == 6:
        c = byte(at)
        at += 1
        back = c & 127
        while c & 128:
            c = byte(at)
            at += 1
            back = (back + 1 << 7) | c & 127
        base_offset = offset - back
        if base_offset < 12 or not back:
            raise MalformedObject("delta base offset")
    elif code == 7:
        byte(at + 19)
        base_oid = data[at : at + 20].hex()
        at += 20
    body = inflate_at(data, at, end, size + 2)
    if len(body) != size:
        raise CorruptedObject("entry size")
    return PACK_TYPES[code], size, base_offset, base_oid, body


def apply_delta(base: bytes, delta: bytes, limit: int = LIMITS["pack_object_max"]) -> bytes:
    """The target that a delta makes of its base."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= len(delta) or shift > 63:
                raise MalformedObject("delta size")
            c = delta[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if not c & 128:
                return out

    source, target = number(), number()
    if source != len(base):
        raise CorruptedObject("delta source size")
    if target > limit:
        raise LimitExceeded("delta target")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            place = size = 0
            for bit in range(7):
                if op >> bit & 1:
                    if at >= len(delta):
                        raise MalformedObject("delta copy cut short")
                    if bit < 4:
                        place |= delta[at] << 8 * bit
                    else:
                        size |= delta[at] << 8 * (bit - 4)
                    at += 1
            size = size or 0x10000
            if place + size > len(base):
                raise MalformedObject("delta copy out of bounds")
            out += base[place : place + size]
        elif op:
            if at + op > len(delta):
                raise MalformedObject("delta insert cut short")
            out += delta[at : at + op]
            at += op
        else:
            raise MalformedObject("delta opcode 0")
        if len(out) > target:
            raise CorruptedObject("delta target size")
    if len(out) != target:
        raise CorruptedObject("delta target size")
    return bytes(out)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def make_delta(base: bytes, target: bytes) -> bytes:
    """A delta that copies the common beginning and end of base and inserts what lies between."""
    head = _common(base, target)
    tail = _common(base[head:][::-1], target[head:][::-1])
    out = bytearray(_number(len(base)) + _number(len(target)))

    def copy(place: int, size: int) -> None:
        while size:
            now = min(size, 0xFFFF)
            op, args = 128, bytearray()
            for bit in range(4):
                if place >> 8 * bit & 255:
                    op |= 1 << bit
                    args.append(place >> 8 * bit & 255)
            for bit in range(2):
                if now >> 8 * bit & 255:
                    op |= 16 << bit
                    args.append(now >> 8 * bit & 255)
            out.append(op)
            out.extend(args)
            place, size = place + now, size - now

    copy(0, head)
    middle = target[head : len(target) - tail]
    for a in range(0, len(middle), 127):
        part = middle[a : a + 127]
        out.append(len(part))
        out.extend(part)
    copy(len(base) - tail, tail)
    return bytes(out)


def resolve_chain(
    start: int,
    entry: Callable[[int], tuple],
    outside: Callable[[str, int], tuple[str, bytes, int] | None],
    depth_max: int = LIMITS["delta_depth_max"],
    known: dict[int, tuple[str, bytes, int]] | None = None,
    place: Callable[[str], int | None] = lambda oid: None,
    used: int = 0,
) -> tuple[str, bytes, int] | None:
    """(type, content, hops) of the entry at an offset, its delta chain applied; None if a base is not at hand.

    entry(offset) reads a pack entry; place(oid) is the offset of a base by id in the same pack; outside(oid, hops) gives
    a base from elsewhere, told how many hops lead to it. Chains of more than depth_max hops, by offset or by id, are
    refused, so a circle of bases is too. used: hops that led here.
    """
    deltas, at, found = [], start, None
    while found is None:
        if known is not None and at in known:
            found = known[at]
            break
        kind, _, base_offset, base_oid, data = entry(at)
        if kind not in ("ofs_delta", "ref_delta"):
            found = kind, data, 0
            break
        deltas.append(data)
        if used + len(deltas) > depth_max:
            raise LimitExceeded("delta depth")
        if base_offset is not None:
            at = base_offset
        elif (inside := place(base_oid)) is not None:
            at = inside
        elif (found := outside(base_oid, used + len(deltas))) is None:
            return None
    kind, content, hops = found
    if used + len(deltas) + hops > depth_max:
        raise LimitExceeded("delta depth")
    for delta in reversed(deltas):
        content = apply_delta(content, delta)
    return kind, content, hops + len(deltas)


def write_pack(objects: Iterable[tuple[str, bytes]], delta_against_previous: bool = False, by_id: bool = False, longest: int | None = None) -> tuple[bytes, bytes]:
    """A pack and its index; with deltas, each object of the previous one's type is stored against it, in chains of at most `longest`."""
    body, rows, previous, hops = bytearray(b"PACK" + struct.pack(">II", 2, 0)), [], None, 0
    for kind, content in objects:
        oid, start = object_id(kind, content), len(body)
        code, data, base = {v: k for k, v in PACK_TYPES.items()}[kind], content, b""
        hops = hops + 1 if delta_against_previous and previous and previous[0] == kind and hops != longest else 0
        if hops:
            data = make_delta(previous[1], content)
            if by_id:
                code, base = 7, bytes.fromhex(previous[2])
            else:
                code, back = 6, start - previous[3]
                groups = [back & 127]
                while back := back >> 7:
                    back -= 1
                    groups.append(back & 127 | 128)
                base = bytes(reversed(groups))
        size, first = len(data) >> 4, code << 4 | len(data) & 15
        head = bytearray([first | (128 if size else 0)])
        if size:
            head += _number(size)
        raw = bytes(head) + base + zlib.compress(data)
        body += raw
        rows.append((oid, start, zlib.crc32(raw)))
        previous = (kind, content, oid, start)
    struct.pack_into(">I", body, 8, len(rows))
    sha = hashlib.sha1(body).digest()
    rows.sort()
    counts = [0] * 256
    for oid, _, _ in rows:
        counts[int(oid[:2], 16)] += 1
    total, fanout = 0, []
    for c in counts:
        total += c
        fanout.append(total)
    large = [start for _, start, _ in rows if start >> 31]
    index = b"\xfftOc" + struct.pack(">I", 2) + struct.pack(">256I", *fanout) + b"".join(bytes.fromhex(r[0]) for r in rows) + b"".join(struct.pack(">I", r[2]) for r in rows)
    index += b"".join(struct.pack(">I", 1 << 31 | large.index(r[1]) if r[1] >> 31 else r[1]) for r in rows) + b"".join(struct.pack(">Q", x) for x in large) + sha
    return bytes(body + sha), index + hashlib.sha1(index).digest()


# --- trees, commits, tags --------------------------------------------------------------------------------------------


def parse_tree(content: bytes, strict: bool = False, encoding: str = "utf-8") -> list[tuple[str, str, str]]:
    """(mode, name, oid) of every entry. A bad entry ends the list; with strict it is an error."""
    out, at = [], 0
    while at < len(content):
        space = content.find(b" ", at)
        nul = content.find(b"\0", space + 1) if space > 0 else -1
        mode = TREE_MODES.get(content[at:space].decode("latin-1").lstrip("0")) if nul > 0 else None
        if mode is None or nul + 21 > len(content):
            if strict:
                raise MalformedObject("tree entry")
            break
        out.append((mode, content[space + 1 : nul].decode(encoding), content[nul + 1 : nul + 21].hex()))
        at = nul + 21
    return out


def write_tree(entries: Iterable[tuple[str, str, str]]) -> bytes:
    """Content of a tree of (mode, name, oid), in the order of the object format."""
    digits = {v: k for k, v in TREE_MODES.items()}
    ordered = sorted(entries, key=lambda e: e[1].encode() + (b"/" if e[0] == "directory" else b""))
    return b"".join(f"{digits[m]} {name}".encode() + b"\0" + bytes.fromhex(oid) for m, name, oid in ordered)


def _is_oid(x: str) -> bool:
    return len(x) == 40 and all(c in "0123456789abcdefABCDEF" for c in x)


def _seconds(line: str) -> int:
    parts = line.split(" ")
    try:
        return int(parts[-2])
    except (IndexError, ValueError):
        raise MalformedObject("time stamp") from None


def parse_commit(content: bytes, encoding: str = "utf-8") -> tuple[str, list[str], int, int, str]:
    """(tree, parents, author_time, committer_time, message)."""
    head, blank, message = content.partition(b"\n\n")
    if not blank:
        raise MalformedObject("commit without a message part")
    tree, parents, author, committer = None, [], 0, None
    for line in head.decode("latin-1").split("\n"):
        name, _, value = line.partition(" ")
        if name in ("tree", "parent") and not _is_oid(value):
            raise MalformedObject(f"commit {name}")
        if name == "tree":
            tree = value.lower()
        elif name == "parent":
            parents.append(value.lower())
        elif name == "author":
            author = _seconds(line)
        elif name == "committer":
            committer = _seconds(line)
    if tree is None or committer is None:
        raise MalformedObject("commit header")
    return tree, parents, author, committer, message.decode(encoding)


def parse_tag(content: bytes) -> str:
    """The id that a tag names."""
    for line in content.partition(b"\n\n")[0].decode("latin-1").split("\n"):
        name, _, value = line.partition(" ")
        if name == "object" and _is_oid(value):
            return value.lower()
    raise MalformedObject("tag object")


# --- lines -----------------------------------------------------------------------------------------------------------


def split_lines(text: str) -> list[str]:
    """Lines parted by \\n alone; a final \\n begins no further line."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return lines


def align(a: list, b: list, max_edits: int | None = None) -> list[tuple[str, int | None, int | None]]:
    """The shortest edit script by Myers' greedy algorithm, as (op, index in a, index in b).

    Ties: at equal reach a deletion is taken; so in a replacement deletions come first. Only the common beginning is cut
    off in advance: cutting the end could choose another of the shortest scripts. Frontiers are kept as slices of the
    diagonals in use, so memory goes with the square of the edits, which max_edits bounds. Where the lines of both sides
    are in one order and come once, there is one longest common sequence, and no search is needed.
    """
    head = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        head += 1
    ops: list[tuple[str, int | None, int | None]] = [("equal", i, i) for i in range(head)]
    ids: dict = {}
    s = [ids.setdefault(x, len(ids)) for x in a[head:]]
    t = [ids.setdefault(x, len(ids)) for x in b[head:]]
    n, m = len(s), len(t)
    if not n or not m:
        return ops + [("delete", head + i, None) for i in range(n)] + [("insert", None, head + j) for j in range(m)]
    if (kept := _kept_in_order(s, t)) is not None:
        if max_edits is not None and n + m - 2 * len(kept) > max_edits:
            raise LimitExceeded("line edits")
        x = y = 0
        for i, j in [*kept, (n, m)]:
            ops += [("delete", head + q, None) for q in range(x, i)] + [("insert", None, head + q) for q in range(y, j)]
            if i < n:
                ops.append(("equal", head + i, head + j))
            x, y = i + 1, j + 1
        return ops
    return ops + _greedy(s, t, head, max_edits)


def _kept_in_order(s: list[int], t: list[int]) -> list[tuple[int, int]] | None:
    """The places of the lines that both sides hold, if each holds them once and in the same order."""
    at: dict[int, int] = {}
    for j, x in enumerate(t):
        at[x] = -1 if x in at else j
    kept, last = [], -1
    for i, x in enumerate(s):
        if (j := at.get(x)) is None:
            continue
        if j <= last:
            return None
        kept.append((i, j))
        last = j
    return kept


def _greedy(s: list[int], t: list[int], head: int, max_edits: int | None) -> list[tuple[str, int | None, int | None]]:
    n, m = len(s), len(t)
    history: list[array] = []
    reach = {1: 0}
    for d in range(n + m + 1):
        if max_edits is not None and d > max_edits:
            raise LimitExceeded("line edits")
        history.append(array("l", [reach.get(k, -1) for k in range(-d - 1, d + 2)]))
        for k in range(-d, d + 1, 2):
            down = k == -d or k != d and reach[k - 1] < reach[k + 1]
            x = reach[k + 1] if down else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and s[x] == t[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                break
        else:
            continue
        break
    tail: list[tuple[str, int | None, int | None]] = []
    x, y = n, m
    for d in range(len(history) - 1, -1, -1):
        row, k = history[d], x - y
        at = lambda q, row=row, d=d: row[q + d + 1]
        down = k == -d or k != d and at(k - 1) < at(k + 1)
        before = k + 1 if down else k - 1
        px = at(before) if d else 0
        py = px - before if d else 0
        while x > px and y > py and (x, y) != (px + (not down and d > 0), py + (down and d > 0)):
            x, y = x - 1, y - 1
            tail.append(("equal", head + x, head + y))
        if d:
            if down:
                y -= 1
                tail.append(("insert", None, head + y))
            else:
                x -= 1
                tail.append(("delete", head + x, None))
    return tail[::-1]


def run_starts(seqs: np.ndarray) -> np.ndarray:
    """For each entry that equals the greatest of ascending numbers, the first number of its run.

    A run is what lies equally far from its place in the list. Without repeats these are runs of neighbours; of a number
    that is there several times each entry belongs to a run of its own.
    """
    runs = seqs - np.arange(len(seqs))
    found, first = np.unique(runs, return_index=True)
    return seqs[first[np.searchsorted(found, runs[seqs == seqs[-1]])]] if len(seqs) else seqs


def line_classes(a: list, b: list) -> list[tuple[list[int], list[int]]]:
    """(places in a, places in b) of every distinct line."""
    out: dict = {}
    for side, lines in enumerate((a, b)):
        for i, x in enumerate(lines):
            out.setdefault(x, ([], []))[side].append(i)
    return list(out.values())


# --- Bloom filters ---------------------------------------------------------------------------------------------------

BLOOM_HASHES, BLOOM_RATE = 4, 0.01


def bloom_bits(n: int) -> int:
    """Bits for n members, whole bytes; none for none."""
    return -(-math.ceil(n * -math.log(BLOOM_RATE) / math.log(2) ** 2) // 8) * 8 if n else 0


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, 32 bits."""
    h, whole = seed & 0xFFFFFFFF, len(data) & ~3

    def mix(k: int) -> int:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        return (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF

    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h ^= mix(k)
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    if rest := data[whole:]:
        h ^= mix(int.from_bytes(rest, "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    return h


@lru_cache(1 << 16)
def _bloom_hashes(member: str) -> tuple[int, int]:
    h1 = murmur3(member.encode())
    return h1, murmur3(member.encode(), h1)


def _bloom_places(member: str, bits: int) -> Iterator[int]:
    h1, h2 = _bloom_hashes(member)
    return ((h1 + i * h2 & 0xFFFFFFFF) % bits for i in range(BLOOM_HASHES))


def bloom_build(members: Iterable[str]) -> bytes:
    """A filter of the distinct members; empty for none."""
    distinct = set(members)
    out = bytearray(bloom_bits(len(distinct)) // 8)
    for member in distinct:
        for at in _bloom_places(member, 8 * len(out)):
            out[at >> 3] |= 1 << (at & 7)
    return bytes(out)


def bloom_might_contain(bloom: bytes | None, member: str) -> bool:
    """False only for what is no member; an empty or missing filter excludes nothing."""
    return not bloom or all(bloom[at >> 3] >> (at & 7) & 1 for at in _bloom_places(member, 8 * len(bloom)))




# --- index files -----------------------------------------------------------------------------------------------------

#: Fixed values of the index file: magic and version.
INDEX_MAGIC, INDEX_VERSION = b"ZIDX", 1

IndexRecord = tuple[str, str, int, list[str], bytes]


def write_index(records: Iterable[IndexRecord], digest: str) -> bytes:
    """An index file of (oid, tree, committer_time, parents, bloom): a header, then the records by id, little-endian."""
    rows = sorted(records)
    out = bytearray(INDEX_MAGIC + struct.pack("<HI", INDEX_VERSION, len(rows)) + bytes.fromhex(digest).rjust(20, b"\0"))
    for oid, tree, time, parents, bloom in rows:
        if len(parents) > 255:
            raise LimitExceeded("parents")
        out += bytes.fromhex(oid) + bytes.fromhex(tree) + struct.pack("<qB", time, len(parents))
        out += b"".join(map(bytes.fromhex, parents)) + struct.pack("<I", len(bloom or b"")) + (bloom or b"")
    return bytes(out)


def read_index(data: bytes) -> tuple[str, list[IndexRecord]]:
    """(digest, records) of an index file."""
    if len(data) < 30 or data[:4] != INDEX_MAGIC:
        raise MalformedObject("index file")
    version, n = struct.unpack_from("<HI", data, 4)
    if version != INDEX_VERSION:
        raise MalformedObject("index file version")
    out, at = [], 30

    def take(size: int) -> bytes:
        nonlocal at
        if at + size > len(data):
            raise MalformedObject("index file cut short")
        at += size
        return data[at - size : at]

    for _ in range(n):
        oid, tree, (time, count) = take(20).hex(), take(20).hex(), struct.unpack("<qB", take(9))
        parents = [take(20).hex() for _ in range(count)]
        out.append((oid, tree, time, parents, take(*struct.unpack("<I", take(4)))))
    return data[10:30].hex(), out
