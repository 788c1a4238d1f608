import hashlib
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import winnow
from webloom.llm.common import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(text, items):
    words = WORD.findall(lower(text or ""))
    hit, met = set(), set()
    for name, t in items:
        w = WORD.findall(lower(t or ""))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[i : i + n]:
                    hit.update(range(p, p + n))
                    met.add(name)
    ids = ",".join(sorted(met))
    return len(words), len(hit), len(met), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in winnow.decontaminate(docs, bench).collect()}
    for r in docs.collect():
        if r.n_chars < 1500 or got[r.doc_id][4]:
            assert got[r.doc_id] == plain(r.text, items)
    assert any(x[4] for x in got.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.lists(st.sampled_from("abcd"), max_size=25), max_size=4))
def test_search_property(doc, items):
    named = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    index = winnow.Index.build([(n, t.encode()) for n, t in named])
    runs, seqs = index.search(words_of(" ".join(doc).encode()))
    hit = {p for a, b in runs for p in range(a, b)}
    names = {n for s in seqs for n in index.names[s]}
    want = plain(" ".join(doc), named)
    assert (len(hit), len(names)) == want[1:3]


def test_repeated_words_take_linear_time():
    """40,000 equal words against an item of 20,000, and against a thousand items that repeat the same few words."""
    items = [("long", b"x " * 20_000), ("short", b"x x x"), *((f"i{i}", b"y z " * (5 + i)) for i in range(1000))]
    index = winnow.Index.build(items)
    began = time.process_time()
    assert index.search([b"x"] * 40_000) == ([(0, 40_000), (0, 40_000)], {0, 1})
    runs, seqs = index.search([b"y", b"z"] * 20_000)
    assert runs == [(0, 40_000)] and len(seqs) == 1000
    assert time.process_time() - began < 1


def test_windows_that_share_a_hash(monkeypatch):
    """With a hash that tells little apart, windows are still told by their words."""
    real = winnow.gram_hashes
    monkeypatch.setattr(winnow, "gram_hashes", lambda ids, k: np.where(real(ids, k) == winnow._NONE, winnow._NONE, real(ids, k) % np.uint64(3)))
    items = [("a", b"a b c d e f g h i j k"), ("b", b"b b b a a a c c c d d"), ("c", b"d e"), ("d", b"e d")]
    index = winnow.Index.build(items)
    for text in (b"q a b c d e f g h i j q", b"d e d", b"b b b a a a c c c d d e", b"a b c d e f g h i"):
        runs, seqs = index.search(text.split())
        hit = {p for x, y in runs for p in range(x, y)}
        want = plain(text.decode(), [(n, t.decode()) for n, t in items])
        assert (len(hit), len(seqs)) == want[1:3]


def test_edges(spark, edge_docs, empty_docs):
    bench = spark.createDataFrame([(1, "two THREE four"), (2, None), (3, ""), (None, "seven eight"), (1, "two three four"), (9, "x " * 40)], "item_id long, text string")
    rows = {r.doc_id: r for r in winnow.decontaminate(edge_docs, bench).collect()}
    assert rows[4].n_hit == 5 and rows[4].n_items == 2
    assert rows[0].n_words == 0 and not rows[0].contaminated
    assert winnow.decontaminate(empty_docs, bench).count() == 0
    none = bench.where("false")
    assert winnow.decontaminate(edge_docs, none).where("contaminated").count() == 0
    kept = winnow.clean(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 1, 2, 3, 6, 7]


def test_blocks_agree(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = winnow.hits(docs, bench), winnow.hits(docs, bench, block_bytes=4000)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
