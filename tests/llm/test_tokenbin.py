import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import tokenbin
from webloom.llm.queries import tokenizer_path


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def plain(rows):
    tok, at, out = library(), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def key(r):
    return (r[0] is not None, r[0], r[1])


def test_against_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((tuple(r) for r in tokenbin.round_trip(docs, tokenizer_path()).collect()), key=key)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(edge_docs, empty_docs):
    got = sorted((tuple(r) for r in tokenbin.round_trip(edge_docs, tokenizer_path()).collect()), key=key)
    assert got == plain([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert tokenbin.round_trip(empty_docs, tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 1 << 20), max_size=300), st.integers(1, 40))
def test_pack_round_trip(bits, ids, block):
    ids = np.array(ids, np.uint32) % (1 << bits)
    counts = np.array([len(ids) // 2, len(ids) - len(ids) // 2])
    s = tokenbin.Shard(tokenbin.write_shard(ids, counts, bits, block))
    assert (s.ids(0, len(ids)) == ids).all()
    assert (s.document(1) == ids[len(ids) // 2 :]).all()
    for a in range(0, len(ids), 17):
        assert (s.ids(a, min(a + 5, len(ids))) == ids[a : a + 5]).all()


def test_bits():
    assert [tokenbin.bits_for(v) for v in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError, match="token shard"):
        tokenbin.Shard(b"\0" * 64)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n\r'sdtreAZéß0½²9_-—中 !<|>ªº×"), max_size=40))
def test_pre_tokens_agree_with_library(text):
    global _enc
    try:
        _enc
    except NameError:
        with open(tokenizer_path(), encoding="utf-8") as f:
            _enc = tokenbin.Encoder(f.read())
    assert np.frombuffer(_enc.encode([text])[0], "<u4").tolist() == _enc.tok.encode(text, add_special_tokens=False).ids
