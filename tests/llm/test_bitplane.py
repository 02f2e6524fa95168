import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolith.llm import bitplane
from chronolith.llm.common import Workspace

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@example("İ: \u0958. e\u0301, K")
@given(st.text(max_size=60) | st.text(alphabet="aAhHeE .,!?'sÉé̱́\n\x1c <|endoftext|>ΣςİI1", max_size=40))
def test_as_the_library(text):
    own = bitplane.pieces_of(PATH)
    assert np.frombuffer(own.encode_all([text.encode()])[0], "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_shard_round_trip(bits):
    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 1 << 31, rng.integers(0, 50)).astype("<u4").tobytes()) for i in range(200)]
    out = io.BytesIO()
    writer = bitplane.ShardWriter(out, 2, 64, bits)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    assert writer.close()[0] == 200
    read = bitplane.ShardReader(pa.BufferReader(out.getvalue()))
    assert [(d, i.tobytes()) for d, i in read.documents()] == [(d, i + struct.pack("<I", 2)) for d, i in docs]
    whole = np.concatenate([i for _, i in read.documents()])
    assert (read.slice(63, 321) == whole[63:321]).all()
    with pytest.raises(ValueError):
        bitplane.ShardReader(pa.BufferReader(out.getvalue()[:-1]))


def test_documents(spark, odd_docs, no_docs):
    folder = Workspace(spark, "t").at("ids")
    bitplane.write_token_shards(odd_docs, folder, PATH, end_id=2, block=500)
    got = [tuple(r) for r in bitplane.read_token_shards(spark, folder, keep_ids=True).collect()]
    got.sort(key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda x: (x is not None, x))
    texts: dict = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(struct.pack("<I", 2).join([np.array(LIB.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes(), b""]))
    start = 0
    for doc_id, at, n, crc, ids in got:
        assert (at, n, crc) == (start, len(ids) // 4, zlib.crc32(ids))
        texts[doc_id].remove(bytes(ids))
        start += n
    empty = Workspace(spark, "t").at("none")
    assert bitplane.write_token_shards(no_docs, empty, PATH, end_id=2) == []
    assert bitplane.read_token_shards(spark, empty).count() == 0
