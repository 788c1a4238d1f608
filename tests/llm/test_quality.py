import zlib

import numpy as np
import pytest

from webloom.llm import quality


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = (y == 1).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").select("doc_id", "score", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    assert auc(y, s) > 0.93
    assert ((s >= 0.5) == y)[y == 1].mean() > 0.97


def test_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (3, None, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    wide = edge_docs.withColumn("score", edge_docs["n_chars"]).withColumn("quality", edge_docs["lang"])
    rows = quality.classify(wide, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(empty_docs, labels).count() == 0
    none = quality.classify(edge_docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(wide, labels.where("quality = 1")).columns == wide.columns


def test_temperature_and_vectors_are_repeatable():
    memo = quality.Codes()
    docs = [quality.codes_of(f"good text number {i} the of and".encode() if i % 2 else f"BAD!! {i} !!".encode(), memo) for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    sums = quality.Contexts()
    for d in docs:
        sums.add(*d)
    vectors = quality.word_vectors(sums.done())
    a, b = quality.fit_network(docs, y, vectors), quality.fit_network(docs, y, vectors)
    assert a.temperature == b.temperature and (a.w1 == b.w1).all()
    x = np.stack([quality.pooled(*d, a.vectors) for d in docs]).astype(float)
    assert ((a.score(x) > 0.5) == y).mean() > 0.95


def test_sample_passes_over_long_texts_and_repeats(spark):
    """A text beyond the budget costs its own place only; an id takes one place, however often it is repeated; nothing that fits is an error."""
    rows = [(i, "short text") for i in range(20)] + [(i, "x" * 5000) for i in range(20, 40)] + [(7, "short text")] * 50 + [(7, "another longer one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.labelled_sample(docs, labels, "quality", 40, 4000)
    assert sorted(got) == sorted((b"short text", i % 2) for i in range(20))
    assert len(quality.labelled_sample(docs, labels, "quality", 40, 20 * 10 + 5000)) == 21
    with pytest.raises(ValueError, match="fits"):
        quality.labelled_sample(docs.where("doc_id >= 20"), labels, "quality", 40, 4000)
    assert quality.labelled_sample(docs, labels.where("false"), "quality", 40, 4000) == []


def test_context_sums_of_all_texts(spark, edge_docs, empty_docs, monkeypatch):
    """Neighbours within the reach, words and marks apart, over all rows, whatever the chunks and partitions."""
    rows = edge_docs.select("text").collect()
    index = quality.index_vectors().astype(int)
    want = np.zeros((quality.BUCKETS, quality.DIM), int)
    for r in rows:
        for run in quality.codes_of(None if r.text is None else r.text.encode(), quality.Codes()):
            b = run // quality.SHAPES
            for o in range(1, quality.REACH + 1):
                np.add.at(want, b[o:], index[b[:-o]])
                np.add.at(want, b[:-o], index[b[o:]])
    assert (quality.context_sums(edge_docs.repartition(3)) == want).all()
    assert not quality.context_sums(empty_docs).any()
    for chunk in (7, 1000):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        sums = quality.Contexts()
        for r in rows:
            sums.add(*quality.codes_of((r.text or "")[:20_000].encode(), quality.Codes()))
        small = sums.done().copy()
        monkeypatch.setattr(quality, "CHUNK", 50_000)
        whole = quality.Contexts()
        for r in rows:
            whole.add(*quality.codes_of((r.text or "")[:20_000].encode(), quality.Codes()))
        assert (small == whole.done()).all()


def test_score_by_hand(spark, edge_docs):
    """A score from given weights, word by word in plain Python: pooled vectors, two layers, temperature."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    k = quality.FEATURES
    net = quality.Network(vectors, rng.normal(size=k), rng.uniform(0.5, 2, k), rng.normal(size=(k, 5)), rng.normal(size=5), rng.normal(size=5), 0.3, 1.7)

    def shape(t):
        if not (t[0].isascii() and t[0].isalnum() or ord(t[0]) >= 128):
            return 7
        return 3 if t.isdigit() else 5 if len(t) == 1 else 6 if len(t) > 24 else 0 if t.islower() else 2 if t.isupper() else 1 if t.istitle() else 4

    def by_hand(text):
        alnum = lambda c: c.isascii() and c.isalnum() or ord(c) >= 128
        words = "".join(c if alnum(c) else " " for c in text or "").split(" ")
        marks = "".join(" " if alnum(c) or c in "\t\n\v\f\r " else c for c in text or "").split(" ")
        words, marks = [w for w in words if w], [m for m in marks if m]
        bucket = lambda t: zlib.crc32(t.encode()) % quality.BUCKETS
        x = [0.0] * k
        for part, at in ((words, 0), (marks, quality.DIM)):
            for t in part:
                for d in range(quality.DIM):
                    x[at + d] += float(vectors[bucket(t)][d]) / len(part)
        for w in words:
            x[2 * quality.DIM + shape(w)] += 1 / len(words)
        if words:
            x[-4] = sum(bucket(a) == bucket(b) for a, b in zip(words, words[1:], strict=False)) / len(words)
            x[-3] = len(set(map(bucket, words))) / len(words)
        x[-2] = len(marks) / (len(words) + len(marks)) if words or marks else 0.0
        x[-1] = np.log1p(len(words)) / 10
        hidden = [np.tanh(sum((x[i] - net.mean[i]) / net.scale[i] * net.w1[i][j] for i in range(k)) + net.b1[j]) for j in range(5)]
        z = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        return 1 / (1 + np.exp(-max(-30, min(30, z))))

    docs = edge_docs.where("doc_id is null or doc_id <> 3")
    got = sorted((str(r.doc_id), r.score) for r in quality.score(docs, net).collect())
    want = sorted((str(r.doc_id), by_hand(r.text)) for r in docs.collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-5)
