import hashlib
import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm import bpe_piece

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_piece.read_ranks(PATH), special_tokens={})


ENC = library()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \n\t\r ab1!'sé\x1c", max_size=40))
def test_as_the_library(text):
    own = bpe_piece.codec(PATH, public_tokenizers.PATTERN)
    ids = own.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == ENC.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_documents(spark, odd_docs, no_docs):
    got = sorted(map(tuple, bpe_piece.encode_documents(odd_docs, PATH, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        ids = ENC.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe_piece.encode_documents(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
