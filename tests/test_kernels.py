"""Byte-level kernels: golden vectors, limits, properties."""

import hashlib
import random
import struct
import zlib

import pytest

from chronolith.errors import CorruptedObject, LimitExceeded, MalformedObject
from chronolith.functions import codec


def ops(a, b):
    sign = {"equal": "=", "delete": "-", "insert": "+"}
    return " ".join(f"{sign[o]}{'' if i is None else i}{',' if i is not None and j is not None else ''}{'' if j is None else j}" for o, i, j in codec.align(a, b))


@pytest.mark.parametrize(
    "a,b,want",
    [("", "", ""), ("x", "y", "-0 +0"), ("abcd", "aced", "=0,0 -1 =2,1 +2 =3,3"), ("ab", "ba", "-0 =1,0 +1"), ("x", "yz", "-0 +0 +1"), ("abc", "abc", "=0,0 =1,1 =2,2"), ("", "xy", "+0 +1"), ("xy", "", "-0 -1")],
)
def test_golden_scripts(a, b, want):
    assert ops(list(a), list(b)) == want


def test_scripts_are_valid_and_shortest():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 10))] for _ in range(2))
        found = codec.align(a, b)
        assert [b[j] if o == "insert" else a[i] for o, i, j in found if o != "delete"] == b
        assert [i for o, i, _ in found if o != "insert"] == list(range(len(a)))
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        assert sum(o == "equal" for o, _, _ in found) == lcs[-1][-1]
    with pytest.raises(LimitExceeded):
        codec.align(list("abc"), list("xyz"), max_edits=3)


@pytest.mark.parametrize("text,n", [("", 0), ("a\nb\n", 2), ("x\ny", 2), ("a\n\nb\n", 3), ("a\r\nb", 2), ("\n", 1)])
def test_split_lines(text, n):
    assert len(codec.split_lines(text)) == n


def test_inflate():
    assert codec.inflate(bytes.fromhex("789c010000ffff00000001")) == b""
    raw = zlib.compress(b"x" * 100)
    assert codec.inflate(raw, 101) == b"x" * 100
    for bad in (raw[:-1] + b"\0", raw[:-4], b"\0" + raw[1:], raw[:3]):
        with pytest.raises(CorruptedObject):
            codec.inflate(bad)
    with pytest.raises(LimitExceeded):
        codec.inflate(raw, 100)


def test_loose():
    raw = codec.loose_bytes("blob", b"hello")
    oid = codec.object_id("blob", b"hello")
    assert codec.read_loose(raw, oid) == ("blob", b"hello")
    with pytest.raises(CorruptedObject):
        codec.read_loose(raw, "0" * 40)
    for head, error in ((b"blob 6\0hello", CorruptedObject), (b"blob5\0hello", MalformedObject), (b"blub 5\0hello", MalformedObject), (b"blob x\0hello", MalformedObject), (b"blob 5hello", MalformedObject)):
        with pytest.raises(error):
            codec.parse_loose(head)
    assert hashlib.sha1(b"hello").hexdigest() == "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d"


def test_deltas():
    base = b"Hello, World!"
    delta = bytes([13, 19, 0x90, 7, 6]) + b"there " + bytes([0x91, 7, 6])
    assert codec.apply_delta(base, delta) == b"Hello, there World!"
    big = bytes(range(256)) * 256
    assert codec.apply_delta(big, b"\x80\x80\x04" + b"\x80\x80\x04" + b"\x80") == big
    for bad, error in (
        (bytes([12, 1, 1, 65]), CorruptedObject),
        (bytes([13, 2, 1, 65]), CorruptedObject),
        (bytes([13, 1, 0x91, 13, 1]), MalformedObject),
        (bytes([13, 9, 9, 65]), MalformedObject),
        (bytes([13, 1, 0]), MalformedObject),
        (bytes([13]), MalformedObject),
        (bytes([13, 1, 2, 65, 66]), CorruptedObject),
        (bytes([13, 5, 0x91]), MalformedObject),
    ):
        with pytest.raises(error):
            codec.apply_delta(base, bad)
    with pytest.raises(LimitExceeded):
        codec.apply_delta(base, bytes([13, 9]), limit=8)
    rng = random.Random(2)
    for _ in range(200):
        a = rng.randbytes(rng.randint(0, 300))
        b = a[: rng.randint(0, 300)] + rng.randbytes(rng.randint(0, 300)) + a[rng.randint(0, 200) :]
        assert codec.apply_delta(a, codec.make_delta(a, b)) == b


@pytest.mark.parametrize("by_id", [False, True])
@pytest.mark.parametrize("inside", [False, True])
def test_delta_depth(by_id, inside):
    texts = [("blob", b"line\n" * 30 + str(i).encode()) for i in range(53)]
    pack, idx = codec.write_pack(texts, True, by_id)
    index = codec.PackIndex(idx)
    assert codec.check_pack(pack, index) == 53
    assert dict(zip(index.oids, index.offsets, strict=True)) == {o: index.find(o) for o in index.oids} and index.find("0" * 40) is None
    assert [o for o, _ in index.in_pack_order(0, 60)] == sorted(index.offsets)

    def read(i, known=None):
        entry = lambda o: codec.read_entry(pack, o)

        def outside(oid, used):
            return codec.resolve_chain(index.find(oid), entry, outside, known=known, used=used)

        place = index.find if inside else lambda oid: None
        return codec.resolve_chain(index.find(codec.object_id(*texts[i])), entry, outside, known=known, place=place)

    assert read(49) == (*texts[49], 49) and read(50) == (*texts[50], 50)
    with pytest.raises(LimitExceeded):
        read(51)
    base = index.find(codec.object_id(*texts[1]))
    assert read(51, {base: (*texts[1], 0)})[:2] == texts[51]
    with pytest.raises(LimitExceeded):  # what is remembered counts its own hops
        read(51, {base: (*texts[1], 1)})


def test_circle_of_bases():
    entry = lambda o: ("ref_delta", 0, None, f"{1 - o:040x}", b"\0\0")
    with pytest.raises(LimitExceeded):
        codec.resolve_chain(0, entry, lambda oid, used: codec.resolve_chain(int(oid, 16), entry, lambda *a: None, used=used), place=lambda oid: int(oid, 16))
    with pytest.raises(LimitExceeded):

        def outside(oid, used):
            return codec.resolve_chain(int(oid, 16), entry, outside, used=used)

        codec.resolve_chain(0, entry, outside)


def test_packs():
    pack, idx = codec.write_pack([("blob", b"a" * 5000), ("tree", b""), ("blob", b"a" * 5001)], True)
    index = codec.PackIndex(idx)
    with pytest.raises(CorruptedObject):
        codec.check_pack(pack[:40] + bytes([pack[40] ^ 1]) + pack[41:], index)
    with pytest.raises(MalformedObject):
        codec.check_pack(b"JUNK" + pack[4:], index)
    with pytest.raises(MalformedObject):
        codec.PackIndex(b"\0" * 2000)
    other, _ = codec.write_pack([("blob", b"b")])
    with pytest.raises(CorruptedObject):
        codec.check_pack(other, index)
    with pytest.raises(MalformedObject):
        codec.read_entry(pack, len(pack))
    large = idx[:-40]
    n = len(index.oids)
    at = 8 + 1024 + 24 * n
    moved = large[:at] + struct.pack(">I", 1 << 31) + large[at + 4 :] + struct.pack(">Q", 5 << 32) + idx[-40:]
    assert codec.PackIndex(moved).offsets[0] == 5 << 32


def test_trees():
    entries = [("file", "a.txt", "1" * 40), ("directory", "a", "2" * 40), ("executable", "x", "3" * 40), ("symlink", "l", "4" * 40), ("submodule", "m", "5" * 40)]
    raw = codec.write_tree(entries)
    assert [e[1] for e in codec.parse_tree(raw)] == ["a.txt", "a", "l", "m", "x"]
    odd = raw + b"100664 old\0" + b"\1" * 20 + b"100644 z\0" + b"\1" * 20
    assert len(codec.parse_tree(odd)) == 5
    with pytest.raises(MalformedObject):
        codec.parse_tree(odd, strict=True)
    with pytest.raises(MalformedObject):
        codec.parse_tree(raw[:-3], strict=True)


def test_commits_and_tags():
    t = "a" * 40
    full = f"tree {t}\nparent {'B' * 40}\nauthor A <a> 5 +0100\ncommitter C <c> 7 -0100\nencoding x\n\nmsg\n\nbody\n".encode()
    assert codec.parse_commit(full) == (t, ["b" * 40], 5, 7, "msg\n\nbody\n")
    for bad in (b"tree abc\n\n", f"tree {t}\nparent abc\ncommitter C 1 +0\n\nx".encode(), f"tree {t}\n\nx".encode(), full.replace(b"\n\n", b"\n"), full.replace(b" 7 ", b" q ")):
        with pytest.raises(MalformedObject):
            codec.parse_commit(bad)
    assert codec.parse_tag(f"object {t}\ntype commit\n\nx".encode()) == t
    with pytest.raises(MalformedObject):
        codec.parse_tag(b"object abc\n\n")


def test_bloom():
    assert codec.bloom_bits(0) == 0 and codec.bloom_bits(1) == 16 and all(codec.bloom_bits(n) % 8 == 0 for n in range(500))
    members = [f"src/{i}.c" for i in range(100)]
    bloom = codec.bloom_build(members)
    assert all(codec.bloom_might_contain(bloom, m) for m in members)
    assert sum(codec.bloom_might_contain(bloom, f"doc/{i}.md") for i in range(1000)) < 60
    assert codec.bloom_might_contain(b"", "x") and codec.bloom_might_contain(None, "x") and codec.bloom_build([]) == b""
    assert codec.murmur3(b"hello") == 0x248BFA47
