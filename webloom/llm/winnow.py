"""Benchmark decontamination by winnowing: shared fingerprints, then exact extension of every hit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, bytes_column, small_batches, words_of

#: A span of at least this many words is found: K + W - 1.
SPAN = 10
#: Words of a fingerprint, and fingerprints of a winnowing window.
K = 5
W = SPAN - K + 1
#: Benchmark bytes that one pass holds (broadcast); a larger benchmark goes in blocks, one pass after the other.
BLOCK_BYTES = 32 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive ids; grams with an unknown word (0) get the greatest value."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, gap = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(k):
        part = ids[i : i + n]
        h = (h ^ part.astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
        gap |= part == 0
    h[h == _NONE] = np.uint64(0)
    h[gap] = _NONE
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of each window of ``w`` (the rightmost of equals), once each; all if fewer."""
    if len(h) <= w:
        return np.unique(len(h) - 1 - np.argmin(h[::-1])) if len(h) else np.empty(0, np.int64)
    n = len(h) - w + 1
    best, at = h[w - 1 :].copy(), np.arange(w - 1, len(h))
    for i in range(w - 2, -1, -1):
        part = h[i : i + n]
        less = part < best
        best[less] = part[less]
        at[less] = np.flatnonzero(less) + i
    at = at[best != _NONE]
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


@dataclass
class Windows:
    """The different windows of ``n`` words among some sequences: their hashes in order, a place where each stands, and which sequences have it."""

    n: int
    keys: np.ndarray
    at: np.ndarray
    ptr: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, n: int, flat: np.ndarray, at: np.ndarray, owner: np.ndarray) -> Windows:
        """``at`` are places in ``flat``. Equal windows are told by their words; those that only share a hash stay apart."""
        h = gram_hashes(flat, n)[at]
        order = np.lexsort((owner, h))
        h, at, owner = h[order], at[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | ~_equal(flat, at[1:], flat, at[:-1], n)
        group = np.cumsum(new) - 1
        pair = np.ones(len(h), bool)
        pair[1:] = new[1:] | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        return cls(n, h[first], at[first], np.searchsorted(group[pair], np.arange(len(first) + 1)), owner[pair])

    def found(self, ids: np.ndarray, h: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``starts`` at which one of the windows stands in ``ids`` (hashed as ``h``), and the windows met."""
        starts = starts[h[starts] != _NONE]
        lo, hi = np.searchsorted(self.keys, h[starts], "left"), np.searchsorted(self.keys, h[starts], "right")
        hit, met = np.zeros(len(starts), bool), []
        for k in range(int((hi - lo).max()) if len(starts) else 0):
            some = np.flatnonzero(lo + k < hi)
            some = some[_equal(ids, starts[some], flat, self.at[lo[some] + k], self.n)]
            hit[some] = True
            met.append(lo[some] + k)
        return starts[hit], np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)

    def owners_of(self, windows: np.ndarray) -> np.ndarray:
        size = self.ptr[windows + 1] - self.ptr[windows]
        return np.unique(self.owners[np.repeat(self.ptr[windows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]) if len(windows) else windows


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: int) -> np.ndarray:
    """For each pair of places whether ``n`` words are the same there."""
    same = np.ones(len(at), bool)
    for k in range(n):
        same &= a[at + k] == b[bt + k]
    return same


@dataclass
class Index:
    """A block of benchmark items, ready to be searched for in documents."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    names: list[list[str]] = field(default_factory=list)
    flat: np.ndarray = None
    prints: np.ndarray = None
    full: Windows = None
    short: list[Windows] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple[str, bytes | None]], span: int = SPAN, k: int = K) -> Index:
        """Items with equal words are one sequence with several names; items without words are left out."""
        self, at, seqs = cls(), {}, []
        for name, text in items:
            words = words_of(text)
            if words:
                key = b" ".join(words)
                if key not in at:
                    at[key] = len(seqs)
                    seqs.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in words], np.int64))
                    self.names.append([])
                self.names[at[key]].append(name)
        pad = np.zeros(span, np.int64)
        self.flat = np.concatenate([*seqs, pad])
        begin = np.r_[0, np.cumsum([len(s) for s in seqs])].astype(np.int64)
        prints, places = [np.empty(0, np.uint64)], {}
        for i, s in enumerate(seqs):
            n = min(len(s), span)
            if n == span:
                g = gram_hashes(s, k)
                prints.append(np.unique(g[winnow(g, span - k + 1)]))
            count = len(s) - n + 1
            places.setdefault(n, []).append((begin[i] + np.arange(count), np.full(count, i)))
        self.prints = np.unique(np.concatenate(prints))
        tables = {n: Windows.of(n, self.flat, np.concatenate([a for a, _ in x]), np.concatenate([o for _, o in x])) for n, x in sorted(places.items())}
        self.full = tables.pop(span, None)
        self.short = list(tables.values())
        return self

    def search(self, words: list[bytes], span: int = SPAN, k: int = K) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal shared runs of at least ``span`` words (or a whole shorter item), merged, as [start, end), and the sequences met.

        A shared fingerprint is extended to the windows that hold it, at most span - k + 1 of them however often it stands in the
        items; each is looked up among the items' different windows and compared word by word. So a text and items
        that repeat one word take time by their lengths, not by the product of these.
        """
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        runs, found = [], set()
        for table in (self.full, *self.short):
            if table is None or len(ids) < table.n:
                continue
            if table is self.full:
                g = gram_hashes(ids, k)
                at = winnow(g, span - k + 1)
                place = np.searchsorted(self.prints, g[at])
                at = at[(place < len(self.prints)) & (self.prints[np.minimum(place, len(self.prints) - 1)] == g[at])]
                if not len(at):
                    continue
                starts = np.unique((at[:, None] - np.arange(span - k + 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(ids) - span)]
            else:
                starts = np.arange(len(ids) - table.n + 1)
            hit, met = table.found(ids, gram_hashes(ids, table.n), starts, self.flat)
            if len(hit):
                apart = np.flatnonzero(np.r_[True, hit[1:] > hit[:-1] + table.n])
                runs += zip(hit[apart].tolist(), (hit[np.r_[apart[1:] - 1, len(hit) - 1]] + table.n).tolist(), strict=True)
                found.update(table.owners_of(met).tolist())
        return runs, found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark's items, one bounded block after the other."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.encode(text_col, "UTF-8").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-int(total) // block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield [(r[0], None if r[1] is None else bytes(r[1])) for r in part.toLocalIterator()]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, runs array<struct<a, b>>, items array<string>)``, one row for each row of ``docs``.

    ``runs`` are the maximal shared spans [a, b) in document words, merged and in order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, {}n_words long, runs array<struct<a:long,b:long>>, items array<string>"
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for n, (items, last) in enumerate(_with_last(_blocks(benchmark, item_col, item_text, block_bytes))):
        shared = spark.sparkContext.broadcast(Index.build(items))

        def run(batches: Iterator[pa.RecordBatch], first: bool = n == 0, last: bool = last, shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                before_r = None if first else b.column(b.schema.get_field_index("runs")).to_pylist()
                before_i = None if first else b.column(b.schema.get_field_index("items")).to_pylist()
                size, runs, names = [], [], []
                for r, text in enumerate(bytes_column(b, "text")):
                    words = words_of(text)
                    got, seqs = index.search(words)
                    ids = {x for s in seqs for x in index.names[s]}
                    if not first:
                        got += [(x["a"], x["b"]) for x in before_r[r]]
                        ids.update(before_i[r])
                    size.append(len(words))
                    runs.append([{"a": x, "b": y} for x, y in _merged(got)])
                    names.append(sorted(ids))
                cols = [b.column(0)] + ([] if last else [b.column(b.schema.get_field_index("text"))])
                kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                cols += [pa.array(size, pa.int64()), pa.array(runs, kind), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id"] + ([] if last else ["text"]) + ["n_words", "runs", "items"])

        df = arrow_map(df, run, schema.format("" if last else "text string, "))
    return df


def _with_last(it: Iterator) -> Iterator:
    held = next(it)
    for x in it:
        yield held, False
        held = x
    yield held, True


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of :func:`hits`: ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``.

    A word is hit if it lies in an occurrence of 10 consecutive item words, or of a whole shorter
    item. Null and empty texts have no words and no hits; an empty benchmark hits nothing; items
    with equal ids count once, an item without an id is listed as the empty string; equal
    documents give equal rows, each as often as it came in; other columns are ignored.
    """
    h = hits(docs, benchmark, id_col, text_col)
    return h.select(
        "doc_id", "n_words",
        F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` whose texts hold no benchmark window, with all their columns: a filter, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    df = docs
    for items in _blocks(benchmark, item_col, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(Index.build(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                texts = b.column(at).cast(pa.binary()).to_pylist()
                yield b.filter(pa.array([not index.search(words_of(t))[0] for t in texts], pa.bool_()))

        df = arrow_map(df, run, docs.schema)
    return df


def oracle_sql() -> str:
    """The same in DuckDB's SQL: every window of the items joined with every window of the documents, by its words."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {words} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS g FROM (SELECT item, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM (SELECT item, w, least(len(w), {SPAN}) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT rn, n, s, array_to_string(list_slice(w, s + 1, s + n), ' ') AS g FROM (SELECT rn, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT rn, dw.n AS n, s, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rn, s, n FROM m)) GROUP BY 1),
k AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rn, item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rn = h.rn LEFT JOIN k ON d.rn = k.rn"""
