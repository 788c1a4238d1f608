"""Importance resampling against strings, counters and a sort."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import resample
from webloom.llm.common import words_of


def grams(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, least=20, percent=10):
    b = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(b, grams(x, n)[1]))
    for x in target:
        t.update(map(b, grams(x, n)[1]))
    ss, tt = sum(s.values()), sum(t.values())
    out, drawn = [], []
    for d, x in docs:
        words, f = grams(x, n)
        weight = sum(math.floor(1000 * math.log((t[k] + 1) * (ss + buckets) / ((s[k] + 1) * (tt + buckets)))) for k in map(b, f))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, words, len(f), weight, score, None])
        if words >= least:
            drawn.append(out[-1])
    drawn.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[5] = i
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("ngram", [1, 3])
def test_whole_tables(spark, sf, ngram):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], ngram)
    assert got(resample.resample(docs, bench, ngram=ngram)) == want


def test_edges(spark, edge_docs, empty_docs):
    bench = spark.createDataFrame([("a", "seven words and then some more filler"), ("b", None), (None, "")], "item_id string, text string")
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    clash = edge_docs.selectExpr("*", "1 as rank", "2 as score", "3 as part", "4 as n", "5 as tie", "6 as bucket")
    for kw in ({}, {"percent": 100, "least": 1}, {"percent": 50, "least": 0}):
        want = plain(rows, [r.text for r in bench.collect()], **kw)
        args = {"percent": kw.get("percent", 10), "least_words": kw.get("least", 20)}
        assert got(resample.resample(clash, bench, **args)) == want
    assert got(resample.resample(edge_docs, bench.limit(0))) == plain(rows, [])
    assert resample.resample(empty_docs, bench).count() == 0


def test_copies_of_one_row(spark):
    """A third of all rows is one row: it ties with itself and takes ranks that follow each other."""
    rows = [(i, " ".join(f"w{(i * j) % 91}" for j in range(30))) for i in range(200)] + [(7, " ".join(["same"] * 25))] * 100 + [(None, " ".join(["none"] * 25))] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("same w1 w2 none",)], "text string")
    assert got(resample.resample(docs, bench, percent=40)) == plain(rows, ["same w1 w2 none"], percent=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=70).filter(lambda b: b" " not in b), min_size=1, max_size=12), st.integers(1, 5))
def test_crc_algebra(words, n):
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    found = [g.tolist() for g in resample.gram_crcs(crc, np.array([len(w) for w in words]), n)]
    want = [[zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)] for k in range(1, n + 1)]
    assert found == [w for w in want if w]


def test_long_shift():
    a, b = b"abc", b"x" * 5_000_003
    assert resample.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))[0] == zlib.crc32(a + b)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab Zé,9\n", max_size=120), st.integers(1, 4), st.integers(1, 30))
def test_pieces(text, n, size):
    parts = list(resample.features(text.encode(), n, 1000, size))
    words, want = grams(text, n)
    assert sum(p[0] for p in parts) == words == len(words_of(text.encode()))
    assert Counter(np.concatenate([p[1] for p in parts]).tolist() if parts else []) == Counter(zlib.crc32(g.encode()) % 1000 for g in want)
