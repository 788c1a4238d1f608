"""Every stage of the corpus pipeline against a brute-force version, on documents with planted copies, passages and junk."""

import random
import zlib
from collections import Counter

import pytest
from test_setsim import plain_groups
from test_winnow import plain as plain_hits

import corpus_pipeline
from webloom.llm import mixing
from webloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, __p string, sig string"


def corpus():
    """Rows, labels and benchmark items: good prose, junk, near copies, passages, null and repeated ids, empty texts."""
    rng = random.Random(9)
    good = [f"{a}{b}" for a in ("river", "stone", "window", "garden", "letter", "winter") for b in ("", "s", "side", "ward", "like", "less", "hood")]
    prose = lambda n: " ".join(rng.choice(good) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(("BUY!!!", "$$$", "click###", "WIN%%%", "cheap***")) + str(rng.randrange(90)) for _ in range(n))
    items = [(i, prose(14)) for i in range(3)]
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        text = junk(rng.randrange(60, 260)) if bad else prose(rng.randrange(60, 260))
        if i % 10 == 1:
            words = text.split()
            words[30:30] = items[i % 3][1].split()
            text = " ".join(words)
        rows.append((i, text))
        if i % 3:
            labels.append((i, 0 if bad else 1, 1 if bad and i % 8 == 0 else 0))
    for i in range(20):  # near and exact copies of good documents
        words = rows[4 * i + 2][1].split()
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(None, rows[3][1]), (None, rows[3][1] + " more"), (7, rows[6][1] + " too"), (300, None), (301, ""), (302, "river stone"), (302, "river stone")]
    rows += [(303, " ".join(prose(20) for _ in range(30)))]
    return [(d, t, None if d == 5 else "en", "s", None if t is None else len(t), None, "x", None) for d, t in rows], labels, items


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, items = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    _, labels, items = corpus()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "mixing", "token_output"]
    step = lambda name, df: corpus_pipeline.materialize(stages[name](spark, df, base), f"test-{name}")
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    good = step("quality", docs)
    assert good.schema == docs.schema
    left = rows(good)
    marks = [d for d, t in left if t and "$$$" in t]
    assert not marks and all((d, t) in left for d, t in rows(docs) if t and "$$$" not in t and len(t) > 300)

    once = step("near_dedup", good)
    assert once.schema == docs.schema
    given = sorted(((r.doc_id is None, r.doc_id, r.text) for r in good.collect()), key=lambda r: (r[0], r[1] or 0))
    want, kept = {}, rows(once)
    for g, (_, d, _t) in zip(plain_groups([t for *_, t in given]), given, strict=True):
        want.setdefault(g, d)
    assert Counter(d for d, _ in kept.elements()) == Counter(want.values()) and not kept - rows(good)

    clean = step("decontaminate", once)
    assert clean.schema == docs.schema
    texts = [(str(i), t) for i, t in items]
    assert rows(clean) == Counter({k: n for k, n in kept.items() if not plain_hits(k[1], texts)[4]})
    assert any(d % 10 == 1 for d, _ in kept if d is not None) and not any(d % 10 == 1 for d, _ in rows(clean) if d is not None and d < 160)

    mixed = step("mixing", clean)
    assert mixed.schema == docs.schema
    rates = mixing.mixture(clean, mixing.domain_of_labels(spark.read.parquet(f"{base}/labels.parquet")), corpus_pipeline.WEIGHTS, corpus_pipeline.BUDGET, corpus_pipeline.FLOOR)
    copies = Counter()
    for r in rates.collect():
        copies[r.doc_id] += r.copies
    assert Counter(d for d, _ in rows(mixed).elements()) == +copies

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    out = step("token_output", mixed).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in mixed.collect()), key=lambda d: (d is not None, d or 0))
    at, found = 0, Counter()
    for r in out:
        assert r.start == at
        at += r.n_tokens
        found[(r.doc_id, r.n_tokens, r.ids_crc32)] += 1
    expect = Counter()
    for r in mixed.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        expect[(r.doc_id, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))] += 1
    assert found == expect


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, base, tmp_path, empty):
    """An empty documents table gives no row; without labels nothing is rejected and there is one domain; without a benchmark nothing is contaminated."""
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{base}/{t}.parquet")
        (df.where("false") if t == empty else df.limit(40)).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert (n == 0) == (empty == "documents")
