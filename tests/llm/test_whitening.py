"""Whitening against Python's integers and a plain eigendecomposition."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import whitening
from webloom.llm.vectors import LONG, exact_dot
from webloom.session import materialize

EMB = "vec_id long, embedding array<float>, label int"


def plain(vectors, k=whitening.COMPONENTS):
    """(n, deviations, whitened, explained, covariance error) of whole-number vectors, centred first, in exact fractions until the last step."""
    fit = sorted(set(vectors))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    y = [[n * x[i] - s[i] for i in range(d)] for x in fit]
    v = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    dev = {x: sum(c * c for c in r) for x, r in zip(fit, y, strict=True)}
    white = {x: (np.array([c / n for c in r]) @ u) / np.sqrt(e) for x, r in zip(fit, y, strict=True)}
    return n, dev, white, e / np.trace(v)


def to_whole(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def test_against_plain(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r.vec_id: to_whole(r.embedding) for r in df.collect()}
    n, dev, white, explained = plain(list(rows.values()))
    got = whitening.whiten(df).collect()
    assert len(got) == len(rows) * 16
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    for r in got:
        x = rows[r.vec_id]
        want = white[x][r.component - 1]
        assert r.deviation == dev[x] and r.deviation_text is None
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        if abs(want) > 1e-6:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(r.whitened) - abs(want)) < 1e-8


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=3)], i) for i in range(20)]
    rows = [*good, (None, good[0][1], None), (5, good[5][1], 5), (90, None, 1), (91, [1.0, None, 2.0], 1), (92, [nan, 1.0, 2.0], 1), (93, [inf, 1.0, 2.0], 1), (94, [1.0, 2.0], 1), (95, [], 1)]
    rows += [(96, good[7][1], 1)] * 30  # a third of all rows
    df = spark.createDataFrame(rows, EMB).selectExpr("*", "1 as x", "2 as component", "3 as n", "4 as e")
    got = whitening.whiten(df).collect()
    kept = Counter([r[0] for r in rows if r[1] is not None and len(r[1]) == 3 and all(c is not None and math.isfinite(c) for c in r[1])])
    assert Counter(r.vec_id for r in got) == Counter({k: 3 * c for k, c in kept.items()})
    n, dev, _, _ = plain([to_whole(r[1]) for r in good])
    assert {r.n for r in got} == {n}
    assert {(r.vec_id, r.deviation) for r in got if r.vec_id in range(20)} == {(g[0], dev[to_whole(g[1])]) for g in good}
    assert whitening.whiten(spark.createDataFrame([], EMB)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], EMB)).count() == 0


def test_no_variance_and_great_values(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], EMB)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, 0.0, 0.0)] * 4
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)], EMB)).collect()
    assert [(r.vec_id, r.component, r.whitened is None, r.explained) for r in sorted(flat)] == [(i, c, c == 2, float(c == 1)) for i in (1, 2) for c in (1, 2)]
    wide = [(1, [1e30, 1.0]), (2, [-1e30, 5.0]), (3, [1e12, 7.0]), (4, [0.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    x = {i: tuple(max(min(math.floor(64 * c), LONG - 10**6), 10**6 - LONG) + 10**6 for c in v) for i, v in wide}
    _, dev, white, explained = plain(list(x.values()))
    for r in got:
        assert r.deviation is None and r.deviation_text == str(dev[x[r.vec_id]])
    one = [r for r in got if r.component == 1]
    assert all(abs(abs(r.whitened) - abs(white[x[r.vec_id]][0])) < 1e-9 and r.explained == pytest.approx(explained[0]) for r in one)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**62), min_size=3, max_size=3), min_size=1, max_size=8))
def test_scatter_is_exact(spark, rows):
    fit = materialize(spark.createDataFrame([(r,) for r in rows], "x array<bigint>"), "test-fit")
    c = whitening.scatter(fit, 3)
    n, s = len(rows), [sum(r[i] for r in rows) for i in range(3)]
    assert c.n == n and c.S.tolist() == s
    assert c.C.tolist() == [[n * sum(r[i] * r[j] for r in rows) - s[i] * s[j] for j in range(3)] for i in range(3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-LONG, LONG) | st.integers(-9, 9), min_size=2, max_size=2), min_size=1, max_size=5))
def test_exact_dot(rows):
    m = np.array(rows, np.int64)
    assert exact_dot(np.ascontiguousarray(m.T), m).tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(2)] for i in range(2)]
