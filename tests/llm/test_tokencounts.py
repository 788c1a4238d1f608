import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import tokencounts
from webloom.llm.queries import op1_token_counts


def plain(word, scores):
    """(pieces, score) by trying every segmentation's prefixes."""
    state = {0: (0, 0)}
    for e in range(1, len(word) + 1):
        found = [(state[s][0] + scores[word[s:e]], -state[s][1] - 1) for s in range(e) if s in state and word[s:e] in scores]
        best = max(found)
        state[e] = (best[0], -best[1])
    return state[len(word)][1], state[len(word)][0]


VOCAB = {bytes([b]): -9_000_000 for b in range(256)} | {b" the": -2_000_000, b"th": -5_000_000, b"he": -5_000_000, b"the": -4_000_000, b" t": -6_000_000, b"ing": -3_000_000, b"in": -4_000_000}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="theinq", max_size=12), max_size=12))
def test_trie_against_every_segmentation(words):
    trie = tokencounts.ForwardTrie(VOCAB)
    for w in words:
        raw = b" " + w.encode()
        assert trie.insert(raw) == plain(raw, VOCAB) == trie._alone(raw)


def test_shared_prefixes_are_scored_once():
    trie = tokencounts.ForwardTrie(VOCAB)
    trie.insert(b" thing")
    n = len(trie.best)
    trie.insert(b" thin")
    trie.insert(b" things")
    assert n == 7 and len(trie.best) == 8


def test_query_against_brute_force(spark, sf):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        scores = tokencounts.ranked_scores(f.read().splitlines())
    got = {r.doc_id: tuple(r)[1:] for r in op1_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in random.Random(5).sample(docs, 25):
        words = r.text.encode().split()
        each = [plain(b" " + w, scores) for w in words]
        assert got[r.doc_id] == (len(words), sum(x[0] for x in each), sum(x[1] for x in each))


def test_edges(edge_docs, empty_docs):
    rows = tokencounts.token_counts(edge_docs, VOCAB).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == by[1].n_tokens == by[2].n_tokens == 0 and by[3].n_pretokens == 60_000
    assert tokencounts.token_counts(empty_docs, VOCAB).count() == 0


def test_vocabularies_do_not_share_a_memory(spark):
    """Two vocabularies of one size and one sum of scores give each its own counts; one without a byte is refused."""
    base = {bytes([b]): -100 for b in range(256)}
    one, two = {**base, b" ab": -10, b" cd": -400}, {**base, b" ab": -400, b" cd": -10}
    docs = spark.createDataFrame([(1, "ab cd ab")], "doc_id long, text string")
    assert [tokencounts.token_counts(docs, v).first().n_tokens for v in (one, two)] == [1 + 3 + 1, 3 + 1 + 3]
    with pytest.raises(ValueError, match="lacks"):
        tokencounts.token_counts(docs, {b"a": -1})
