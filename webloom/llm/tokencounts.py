"""Token counts under a unigram vocabulary: forward scores on a trie of distinct pre-tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, bytes_column, small_batches

#: Piece scores from the rank r of a vocabulary file that gives no probabilities: Zipf-Mandelbrot, p(r) ~ 1 / (r + SHIFT).
SHIFT = 2.7
#: Scores are whole numbers of this part of a nat, so that sums and ties are exact.
UNIT = 1_000_000
#: Trie nodes and remembered pre-tokens (none longer than LONG) of a worker (about 0.4 GB); beyond its bound either starts anew (results stay the same).
NODES, MEMO = 1_200_000, 600_000
#: Pre-tokens longer than this many bytes are scored on their own path, which neither the trie nor the memory keeps.
LONG = 64


def ranked_scores(lines: list[bytes]) -> dict[bytes, int]:
    """Scores of a ranks file (base64 piece, rank). Every single byte must be a piece, so that any text has a path."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    norm = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    return {p: -round(UNIT * (math.log(r + SHIFT) + norm)) for p, r in ranks.items()}


class ForwardTrie:
    """Distinct pre-tokens as a trie whose nodes hold the forward state of their prefix.

    A node's state (best score of the prefix, fewest pieces among the best) depends on the prefix
    alone: it is worked out once, from the states on the path above it, when the first
    pre-token with that prefix is inserted. A pre-token's terminal node gives its count.
    """

    def __init__(self, scores: dict[bytes, int]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0], [0]

    def insert(self, word: bytes) -> tuple[int, int]:
        """(pieces, score) of a pre-token."""
        if len(word) > LONG:
            return self._alone(word)
        child, best, count, scores, longest = self.child, self.best, self.count, self.scores, self.longest
        node, path = 0, [0]
        for depth, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key)
            if node is None:
                top, pieces = None, 0
                for start in range(max(0, depth - longest), depth):
                    s = scores.get(word[start:depth])
                    if s is not None:
                        above = path[start]
                        total = best[above] + s
                        if top is None or total > top or total == top and count[above] + 1 < pieces:
                            top, pieces = total, count[above] + 1
                node = child[key] = len(best)
                best.append(top)
                count.append(pieces)
            path.append(node)
        return count[node], best[node]

    def _alone(self, word: bytes) -> tuple[int, int]:
        state = [(0, 0)]
        for depth in range(1, len(word) + 1):
            top = None
            for start in range(max(0, depth - self.longest), depth):
                s = self.scores.get(word[start:depth])
                if s is not None:
                    got = (state[start][0] + s, -state[start][1] - 1)
                    top = got if top is None or got > top else top
            state.append((top[0], -top[1]))
        return state[-1][1], state[-1][0]


#: A pre-token's pieces and score as one number: pieces << SHIFT_BITS, less the score, which is never above 0.
SHIFT_BITS = 80


class Counts(dict):
    """pre-token -> pieces and score (one number, so that a document is one sum) from the trie, each different pre-token once."""

    def __init__(self, scores: dict[bytes, int]) -> None:
        super().__init__()
        self.trie = ForwardTrie(scores)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        if len(self.trie.best) >= NODES:
            self.trie.clear()
        pieces, score = self.trie.insert(b" " + word)
        got = (pieces << SHIFT_BITS) - score
        if len(word) <= LONG:
            self[word] = got
        return got

    def of(self, words: list[bytes]) -> tuple[int, int]:
        """(pieces, score) of all words; the scores of a text stay far below 2 ** SHIFT_BITS."""
        total = sum(map(self.__getitem__, words))
        return total >> SHIFT_BITS, -(total & ((1 << SHIFT_BITS) - 1))


def pre_tokens(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space; each is scored with one leading space."""
    return text.split() if text else []


def token_counts(docs: DataFrame, scores: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens, score)``, one row for each row of ``docs``; ``score`` in UNITs of a nat.

    A document's count is the sum of its pre-tokens' terminal counts. One pass, no shuffle; the
    vocabulary is broadcast (its file's size) and the trie is bounded. Null and empty texts have no
    pre-tokens and score 0; of equal scores the fewest pieces count; repeated rows come out alike,
    as often as they came in; an empty table gives no row; other columns are ignored. A vocabulary
    without one of the 256 bytes is refused, since some text would have no path.
    """
    missing = [b for b in range(256) if bytes([b]) not in scores]
    if missing:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:8]}")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts_for(shared.value)
        for b in batches:
            sizes, tokens, total = [], [], []
            for t in bytes_column(b, "text"):
                words = pre_tokens(t)
                pieces, score = known.of(words)
                sizes.append(len(words))
                tokens.append(pieces)
                total.append(score)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, tokens, total))], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_pretokens long, n_tokens long, score long")


_counts: list[Counts] = []


def counts_for(scores: dict[bytes, int]) -> Counts:
    """One memory for each worker process and vocabulary, shared by its tasks; a process keeps that of the vocabulary it met last."""
    if not _counts or _counts[0].trie.scores != scores:
        _counts[:] = [Counts(scores)]
    return _counts[0]
