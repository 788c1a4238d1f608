import random
from fractions import Fraction

import numpy as np
import pytest

from webloom.llm import setsim, simhash


def plain_set(text, k=5):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def plain_groups(texts):
    """The root of each text's component by comparing all pairs of sets."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def near_copies():
    """Texts with words replaced, added and dropped so that similarities lie on both sides of 0.8."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    line = [word() for _ in range(25)]
    texts = []
    for n in (5, 9, 30, 60, 60, 200, 1500):
        base = [word() for _ in range(n)] + (line if n == 60 else [])
        for edits in (0, 0, 1, 1, 1, 2, 3, 5, 9, 20):
            w = list(base)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([word()], [word(), w[at]], []))
            texts.append(" ".join(w))
    base = [word() for _ in range(150)]
    for _ in range(60):  # a large group whose members differ in other places
        w = list(base)
        for at in rng.sample(range(150), 3):
            w[at] = word()
        texts.append(" ".join(w))
    texts += [" ".join(line + [word() for _ in range(40)]) for _ in range(80)]
    texts += ["", "  ", "one two", "One  two"]
    rng.shuffle(texts)
    return texts


def test_dedup_finds_all_near_copies(spark):
    """Each pair with Jaccard 0.8 of five-word shingles links; most of these are over two SimHash bits apart."""
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = plain_groups(texts)
    want = {}
    for i, g in enumerate(group):
        want.setdefault(g, i)
    assert sorted(r.doc_id for r in simhash.dedup(docs).collect()) == sorted(want.values())


def test_dedup_of_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {}
    for (d, _), g in zip(rows, plain_groups([t for _, t in rows]), strict=True):
        want.setdefault(g, d)
    assert sorted(r.doc_id for r in simhash.dedup(docs).collect()) == sorted(want.values())


@pytest.mark.parametrize("similarity", [Fraction(4, 5), Fraction(1, 2), Fraction(1)])
def test_prefixes_of_similar_sets_meet(similarity):
    rng = np.random.default_rng(1)
    common = np.arange(0, 400, 3, dtype=np.uint64)
    for _ in range(500):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.choice(400, n, replace=False).astype(np.uint64))
        b = np.unique(np.r_[rng.choice(a, int(rng.integers(0, n + 1)), replace=False), rng.choice(400, int(rng.integers(1, 5))).astype(np.uint64)])
        both, differ = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
        assert (both >= similarity * len(np.union1d(a, b))) == (both >= setsim.least_overlap(len(a) + len(b), similarity))
        assert np.bitwise_count(setsim.sketch(a) ^ setsim.sketch(b)).sum() <= differ
        if both >= similarity * len(np.union1d(a, b)):
            assert np.isin(setsim.prefix(a, common, common + 1, similarity), setsim.prefix(b, common, common + 1, similarity)).any()


def test_one_row_of_each_group_stays(spark):
    """Null and repeated ids: the row decides, not its id."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [
        (None, a, "en"), (None, a, "en"), (None, a + " more", None), (7, b, "en"), (7, b + " more", "en"), (7, b + " more", "en"), (9, b, "de"),
        (3, "alone with an id of two groups", None), (3, b + " and more", "en"), (None, "alone without an id", None), (None, None, "en"), (None, None, "en"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [tuple(r) for r in simhash.dedup(docs).collect()]
    assert len(kept) == 5 and set(kept) <= set(rows)
    assert sorted(r for r in kept if r[0] is not None) == [(3, "alone with an id of two groups", None), (3, b + " and more", "en")]
    assert sum(r[0] is None and (r[1] or "").startswith("a0") for r in kept) == 1
    assert (None, "alone without an id", None) in kept and (None, None, "en") in kept
