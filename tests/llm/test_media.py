import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import media, webp


@pytest.mark.parametrize("transforms", [(), (2,), (0,), (1,), (0, 1), (1, 0, 2), (3,), (3, 0)])
@pytest.mark.parametrize("cache", [0, 4])
@pytest.mark.parametrize("references", [False, True])
def test_every_tool_of_the_format(transforms, cache, references):
    rng = np.random.default_rng(1)
    img = rng.integers(0, [256, 40, 9], (13, 17, 3)).astype(np.uint8)
    if 3 in transforms:
        img = (rng.integers(0, 5, (13, 17, 1)) * np.array([[[30, 7, 3]]])).astype(np.uint8)
    img[5:9] = img[1:5]
    got = webp.decode(webp.encode(img, transforms, cache, references, mode=-1))
    assert (got[:, :, :3] == img).all() and (got[:, :, 3] == 255).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(colours):
    rng = np.random.default_rng(2)
    table = rng.integers(0, 256, (colours, 3)).astype(np.uint8)
    img = table[rng.integers(0, colours, (9, 23))]
    assert (webp.decode(webp.encode(img, (3,), 0, True))[:, :, :3] == img).all()


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=2000))
def test_payloads(data):
    p = media.payload_of(data)
    assert len(p) % 192 == 0 and p.rstrip(b" ") == data.rstrip(b" ")
    m = media.store(p)
    assert (media.pixels(m)[:, :, 1] == media.pixels(m)[:, :, 2]).all() and media.pixels(m)[:, :, 0].tobytes() == p
    with pytest.raises((ValueError, IndexError)):
        media.pixels(m[: len(m) // 2])


def test_hand_made_stream():
    """A 2 x 1 image written bit by bit: simple codes of one symbol, so no bits a pixel."""
    w = webp.Writer()
    for v, n in ((0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.put(v, n)
    for s in (10, 20, 30, 255, 0):
        for v, n in ((1, 1), (0, 1), (1, 1), (s, 8)):
            w.put(v, n)
    body = w.done()
    assert webp.decode(webp._container(body)).tolist() == [[[20, 10, 30, 255]] * 2]


def test_distance_codes_follow_the_specification():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def test_query_and_edges(spark, sf, edge_docs, empty_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edge_docs.selectExpr("doc_id + 100000 doc_id", "text"))
    rows = {r.doc_id: r for r in media.digest(media.encode_column(docs)).collect()}
    feature = {}
    for r in docs.collect():
        data = (r.text or "").encode()
        p = data + b" " * (-len(data) % 192 or (0 if data else 192))
        got = rows[r.doc_id]
        assert (got.n_bytes, got.payload_bytes) == (len(data), len(p))
        assert got.payload_sha256 == hashlib.sha256(p).hexdigest() and got.tail_crc32 == zlib.crc32(p[-16:])
        assert feature.setdefault(r.text or "", (got.feature, got.media_sha256)) == (got.feature, got.media_sha256)
    assert media.digest(media.encode_column(empty_docs)).count() == 0
    arrays = media.decode_column(media.encode_column(edge_docs.where("doc_id = 3"))).first()
    assert arrays.width == 192 and bytes(arrays.samples)[::3].startswith(b"word0 filler")


def test_tall_payloads_are_several_files(monkeypatch):
    monkeypatch.setattr(media, "TILE", 4)
    p = media.payload_of(b"abc def " * 300)
    m = media.store(p)
    assert len(webp.files(m)) > 1 and media.pixels(m)[:, :, 0].tobytes() == p


def test_stored_columns_use_the_format(monkeypatch):
    """Stored texts have a transform, references and codes of several lengths; windows of any size read the same."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(2, 9, 200)]
    text = b" ".join(words[i] for i in rng.integers(0, 200, 3000)) + b"ab" * 5000 + bytes(range(256))
    p = media.payload_of(text)
    m = media.store(p)
    assert len(m) < 0.5 * len(p) and (media.pixels(m)[:, :, 0].tobytes() == p)
    found = webp._references(np.frombuffer(p, np.uint8))
    assert len(found) > 100 and any(d < n for _, n, d in found) and max(n for _, n, _ in found) <= 4096
    monkeypatch.setattr(webp, "WINDOW", 40)
    assert media.pixels(m)[:, :, 0].tobytes() == p


def test_extended_container():
    img = np.random.default_rng(4).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    body = webp.encode(img)[12:]
    chunks = b"VP8X" + (10).to_bytes(4, "little") + bytes(10) + b"ICCP" + (3).to_bytes(4, "little") + b"abc\0" + body
    whole = b"RIFF" + (4 + len(chunks)).to_bytes(4, "little") + b"WEBP" + chunks
    assert (webp.decode(whole)[:, :, :3] == img).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=280), st.sampled_from([7, 9, 15]))
def test_prefix_codes(counts, limit):
    """Lengths are those of a complete code within the limit, and its code words are read back."""
    counts = np.array(counts[: 1 << limit])
    lengths = webp.code_lengths(counts, limit)
    used = np.flatnonzero(counts)
    assert (np.flatnonzero(lengths) == used).all() and lengths.max(initial=0) <= limit
    if len(used) > 1:
        assert sum(2.0 ** -int(lengths[s]) for s in used) == 1
        words, code = webp.code_words(lengths), webp.Prefix(lengths)
        assert all(code.array[words[s]] == s * 16 + lengths[s] for s in used)
