import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.llm import kdshards


def check(rows, docs, shards=40):
    """Sizes near equal, slots gapless, one row a document; returns the bytes of each shard."""
    assert len(rows) == docs.count()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_sizes(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = kdshards.shard(docs).collect()
    size = check(rows, docs)
    mean = sum(size.values()) / 40
    assert len(size) == 40 and max(size.values()) < 1.02 * mean and min(size.values()) > 0.98 * mean
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    groups = defaultdict(set)
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        groups[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 3
    if sf == "sf0.01":
        against_brute_force({r.doc_id: r.leaf for r in rows}, docs.collect())


def plain_cell(text, lang):
    data = (text or "").encode()
    letter = lambda i, step: (ord(lang.lower()[i]) - 97) // step + 1 if len(lang or "") > i and "a" <= lang.lower()[i] <= "z" else 0
    return math.floor(math.log2(len(data) + 16) * 4), letter(0, 1) * 4 + letter(1, 9), math.floor(math.log1p(20 * max(0, len(data) / max(len(text or ""), 1) - 1)) * (16 / math.log(61)))


def against_brute_force(leaf, docs):
    """A k-d tree of single rows: at each node the rows beside the weighted quantile's cell fall on the tree's side of it."""
    rows = [(plain_cell(r.text, r.lang), len((r.text or "").encode()) + 16, leaf[r.doc_id]) for r in docs]
    span = [max(c[d] for c, *_ in rows) - min(c[d] for c, *_ in rows) for d in range(3)]
    wrong = 0

    def node(rows, lo, hi):
        nonlocal wrong
        if hi - lo == 1 or not rows:
            wrong += sum(n != lo for *_, n in rows)
            return
        mid = lo + (hi - lo) // 2
        wide = max(range(3), key=lambda d: ((max(c[d] for c, *_ in rows) - min(c[d] for c, *_ in rows)) / max(span[d], 1), -d))
        rows = sorted(rows, key=lambda r: (r[0][wide], r[0]))
        goal, done, at = sum(w for _, w, _ in rows) * (mid - lo) / (hi - lo), 0, None
        for cell, w, _ in rows:
            done += w
            at = cell
            if done > goal:
                break
        below = [r for r in rows if (r[0][wide], r[0]) < (at[wide], at) or r[0] == at and r[2] < mid]
        above = [r for r in rows if (r[0][wide], r[0]) > (at[wide], at) or r[0] == at and r[2] >= mid]
        node(below, lo, mid)
        node(above, mid, hi)

    node(rows, 0, 40)
    assert wrong <= 0.03 * len(rows), wrong  # cells are cut by weight, whole rows lie a little beside


def test_evened():
    """Sums come together by moves and exchanges, whatever can't be moved."""
    weights = {(0, 0): 900, (0, 1): 100, (0, 2): 55, (1, 0): 500, (1, 1): 245, (2, 0): 40, (2, 1): 1160}
    size = Counter()
    for (n, slab), w in weights.items():
        size[kdshards.evened(weights, 3).get((n, slab), n)] += w
    assert sum(size.values()) == sum(weights.values()) and max(size.values()) <= 1160
    assert kdshards.evened({}, 3) == {} and kdshards.evened({(0, 0): 5}, 2) == {}
    many = {(n, s): 10 + (n * s) % 7 for n in range(10) for s in range(100 + n * 5)}
    size = Counter()
    moves = kdshards.evened(many, 10)
    for k, w in many.items():
        size[moves.get(k, k[0])] += w
    assert max(size.values()) < 1.01 * sum(many.values()) / 10


def test_a_third_are_copies(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text " * 40)).otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 512))).alias("text"),
        F.lit("en").alias("lang"),
    )
    size = check(kdshards.shard(docs).collect(), docs)
    mean = sum(size.values()) / 40
    assert max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean


def test_edges(spark, edge_docs, empty_docs):
    wide = edge_docs.withColumn("shard", F.lit("x")).withColumn("slab", F.lit(1))
    rows = kdshards.shard(wide).collect()
    check(rows, edge_docs)
    assert {r.size for r in rows if r.doc_id in (0, 1)} == {16}
    assert kdshards.shard(empty_docs).count() == 0


def test_tree_splits_at_weighted_medians():
    cells = [((x, y, 0), 1 + x) for x in range(8) for y in range(3)]
    leaves = kdshards.build_tree(cells, 5)
    total = sum(w for _, w in cells)
    assert [sum(s.hi - s.lo for s in leaf) for leaf in leaves] == pytest.approx([total / 5] * 5, abs=1.5)
    parts = defaultdict(list)
    for leaf in leaves:
        for s in leaf:
            parts[s.cell].append((s.lo, s.hi))
    for cell, w in cells:
        got = sorted(parts[cell])
        assert got[0][0] == 0 and got[-1][1] == w and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
