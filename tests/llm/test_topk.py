"""Top-k search against every pair."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import topk
from webloom.llm.vectors import LONG

EMB = "vec_id long, embedding array<double>"


def plain(rows, k=10, every=100):
    """Rows (id, vector) that take part, compared one by one in Python's integers."""
    good = [(i, tuple(max(min(math.floor(1024 * c), LONG), -LONG) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, v in {r for r in good if r[0] is not None and r[0] % every == 0}:
        found = [(max(min(sum(a * b for a, b in zip(v, w, strict=True)), LONG), -LONG), i) for i, w in good if i != q and len(w) == len(v)]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, n, i, s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [topk.BLOCK_BYTES, 1000])
def test_whole_table(spark, sf, block):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in df.collect()])
    assert got(topk.top_k(df, block_bytes=block)) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=9)]) for i in range(60)]
    rows += [(100, rows[3][1]), (200, rows[3][1]), (200, rows[3][1]), (200, rows[4][1]), (None, rows[3][1]), (None, None), (300, None), (301, [1.0, None]), (302, [nan] * 9), (303, [inf] * 9), (304, [])]
    rows += [(7, rows[7][1])] * 40 + [(400, [1.0, 2.0]), (401, [0.5, 0.1]), (500, [1.0]), (600, [1e18] * 3), (601, [-1e18] * 3), (602, [3e9, 2e9, 0.0])]
    df = spark.createDataFrame(rows, EMB).selectExpr("*", "1 as v", "2 as rank", "3 as block", "4 as q", "5 as query_id")
    assert got(topk.top_k(df)) == plain(rows)
    assert got(topk.top_k(df, block_bytes=300)) == plain(rows)
    assert got(topk.top_k(spark.createDataFrame([], EMB))) == []


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 20), st.integers(1, 25), st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([2, 50, 10**5]))
def test_search_by_blocks(d, nq, nc, seed, top):
    rng = np.random.default_rng(seed)
    qm, cm = rng.integers(-top, top, (nq, d)), rng.integers(-top, top, (nc, d))
    ids = rng.choice(30, nq)
    q = topk.Queries.of(ids, qm, 3)
    pool = np.concatenate([cm, qm])
    pool_ids = np.concatenate([100 + rng.permutation(nc), ids])
    best = topk.Best(nq, 3, q.least)
    for at in range(0, len(pool), 11):
        part = pool_ids[at : at + 11]
        q.search(best, part, np.zeros(len(part), bool), pool[at : at + 11])
    for i in range(nq):
        want = sorted(((-int(qm[i] @ v), int(c)) for c, v in zip(pool_ids, pool, strict=True) if c != ids[i]))[:3]
        assert sorted(zip((-best.score[best.q == i]).tolist(), best.id[best.q == i].tolist(), strict=True)) == want


def test_bounds_let_pairs_go():
    """Clustered vectors: most pairs end after the first blocks."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    m = (1024 * (centres[rng.integers(0, 20, 2000)] + 0.1 * rng.normal(size=(2000, 64)))).astype(np.int64)
    q = topk.Queries.of(np.arange(50), m[:50], 5, pilot=50)
    c = topk.Columns.of(m, q.order)
    least = np.sort(m[:50] @ m.T, axis=1)[:, -6].astype(float)
    i, j, s = topk.survivors(q.columns, c, least)
    assert (s == (m[i] * m[j]).sum(axis=1)).all() and (s >= least[i]).all() and len(s) >= 50 * 6
    after = np.count_nonzero((q.columns.v[:16].T @ c.v[:16]) + q.columns.rest[2][:, None] * c.rest[2] >= least[:, None])
    assert after < 0.2 * 50 * 2000
