import numpy as np
import xxhash
from pyspark.sql import functions as F

from webloom.llm import simhash
from webloom.llm.components import connected_components


def plain_fingerprint(text):
    words, cur = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    if cur:
        words.append(cur)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (doc_id, fp) -> component of each row by comparing all fingerprints."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            k = find(f)
            least[k] = min(least.get(k, d), d)
    return {(d, f, least.get(find(f))) for d, f in rows}


def result(df):
    return {(r[0], int(r[1], 16), r[2]) for r in df.collect()}


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert result(simhash.near_duplicates(docs)) == plain_components(rows)


def test_edges(edge_docs, empty_docs):
    got = simhash.near_duplicates(edge_docs)
    assert got.count() == edge_docs.count()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in edge_docs.collect()]
    assert result(got) == plain_components(rows)
    assert simhash.near_duplicates(empty_docs).count() == 0
    kept = simhash.dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 3, 4, 6, 7]


def test_hamming_links_with_refined_buckets(spark):
    """A dense group, so that buckets overflow and are refined down to the last ring."""
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 5)]
    fps = set(centre)
    for c in centre:
        for _ in range(150):
            f = c
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                f ^= 1 << int(b)
            fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    signed = lambda f: f - (1 << 64) if f >= 1 << 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = {}
    for d, f, c in plain_components([(signed(f), f) for f in fps]):
        want.setdefault(c, set()).add(d)
    for bucket in (256, 4):
        roots = {r.node: r.root for r in connected_components(simhash.hamming_edges(df, bucket=bucket)).collect()}
        got = {}
        for f in fps:
            got.setdefault(roots.get(signed(f), signed(f)), set()).add(signed(f))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for piece in (500_000, 30):
        got = connected_components(edges, piece=piece)
        assert got.count() == 201 and got.where("root <> 0").count() == 0
    assert connected_components(edges.where("false")).count() == 0
