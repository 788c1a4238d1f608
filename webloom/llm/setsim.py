"""Near-duplicates by exact Jaccard similarity of word shingles: prefix-filtered candidates, pigeonring chains on parity sketches, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, bytes_column, materialize, small_batches
from webloom.llm.components import connected_components

SEED = 42
#: Words of a shingle, and the least similarity of a link.
SHINGLE, SIMILARITY = 5, Fraction(4, 5)
#: One text in so many is counted to find common shingles; those met so often there go last in the order of prefixes, as many as this at most.
SAMPLE, COMMON, COMMON_MOST = 8, 4, 200_000
#: Segments of a sketch's ring.
RING = 8
#: Sets that share a prefix member are paired before their sketches are fetched up to this number, and after it beyond.
FEW = 32
#: Slots of the filter on the documents that have candidates.
SLOTS = 1 << 22
#: Names that a task remembers to work a repeated text out once.
REMEMBERED = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's shingles; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split() if text else []
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x, SEED) for x in words], dtype=np.uint64)
    n = len(w) - shingle + 1
    h = w[:n].copy()
    for i in range(1, shingle):
        h = h * MULTIPLIER + w[i : i + n]
    return np.unique(h)


def signature(s: np.ndarray) -> int:
    """The set's name: equal sets have equal names."""
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the members' slots, 2 to 4 slots a member; two sketches differ in no more bits than the sets differ in members."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch that a set has over fewer slots."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def chains_hold(x: np.ndarray, budget: np.ndarray, ring: int = RING) -> np.ndarray:
    """Rows of XORs of shape (rows, words) that differ in ``budget`` bits at most.

    Pigeonring filter: the words form a ring of segments; if all differ in ``budget`` bits at most, there is a
    segment from which chains of l of m segments hold l / m of the budget at most, for each l. Chains grow by one
    segment a step, rows without a start left go, and the last chain is the full Hamming distance.
    """
    m = min(ring, x.shape[1])
    seg = np.bitwise_count(x).reshape(len(x), m, -1).sum(axis=2, dtype=np.int64)
    left = np.arange(len(x))
    open_starts = np.ones((len(x), m), dtype=bool)
    total = np.zeros_like(seg)
    for l in range(1, m + 1):
        total += np.roll(seg[left], 1 - l, axis=1)
        open_starts &= total * m <= l * budget[left, None]
        stay = open_starts.any(axis=1)
        left, open_starts, total = left[stay], open_starts[stay], total[stay]
    ok = np.zeros(len(x), dtype=bool)
    ok[left] = True
    return ok


def least_overlap(total: int, similarity: Fraction = SIMILARITY) -> int:
    """Common members that two sets of ``total`` members together need."""
    return -(-total * similarity.numerator // (similarity.numerator + similarity.denominator))


def prefix(s: np.ndarray, common: np.ndarray, weight: np.ndarray, similarity: Fraction = SIMILARITY) -> np.ndarray:
    """The first members in the order (weight, hash); two similar sets share one of these at least."""
    n = len(s)
    p = n + (-n * similarity.numerator // similarity.denominator) + 1 if n else 0
    if n and len(common):
        at = np.searchsorted(common, s)
        at[at == len(common)] = 0
        w = np.where(common[at] == s, weight[at], 0)
        if w.any():
            s = s[np.lexsort((s, w))]
    return s[:p]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(text_col).alias("text"))


def row_keys(columns: list[str]) -> list:
    """Two hashes that name a row by all its columns; nulls count, which the hash alone passes over."""
    parts = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(*parts).alias("row"), F.xxhash64(F.lit(SEED), *parts).alias("row2")]


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that many texts hold, sorted, and how many do. A wrong answer costs time, not results: any order is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for t in bytes_column(b, "text"):
                if t and (name := xxhash.xxh64_intdigest(t, SEED)) % SAMPLE == 0 and name not in seen:
                    seen.add(name)
                    yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], ["h"])

    counts = arrow_map(texts, run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON_MOST).toArrow()
    h, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _described(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: Fraction) -> DataFrame:
    """``(doc_id, row, row2, sig, n, prefix, sketch)``: one row for each row of ``docs``; row and row2 as in ``row_keys``, n the set's size.

    Prefix and sketch are null for an empty set and where the task has just met the same set.
    """
    common, weight = common_shingles(_texts(docs, text_col), shingle)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_keys(docs.columns), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sigs, sizes, heads, bins = [], [], [], []
            for t in bytes_column(b, "text"):
                s = shingle_set(t, shingle)
                sig = signature(s)
                fresh = len(s) and sig not in seen
                if fresh:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(sig)
                sigs.append(sig)
                sizes.append(len(s))
                heads.append(prefix(s, common, weight, similarity).view(np.int64) if fresh else None)
                bins.append(sketch(s).tobytes() if fresh else None)
            cols = [pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(bins, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["doc_id", "row", "row2", "sig", "n", "prefix", "sketch"])

    return arrow_map(texts, run, "doc_id long, row long, row2 long, sig long, n int, prefix array<long>, sketch binary")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``(h, size, sig, n, pos)`` sorted by the first three -> those whose h is in two sets at least, with the first of their size class.

    Holds one batch and one row, however many sets share an h.
    """
    held = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.int32)]
    lead0, tied = 0, False
    for b in chain(batches, (None,)):
        cols = held if b is None else [np.r_[x, b.column(i).to_numpy(zero_copy_only=False)] for i, x in enumerate(held)]
        h, size, sig = cols[:3]
        if not len(h):
            continue
        own = np.r_[True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])]
        h, size, sig, n, pos = cols = [x[own] for x in cols]
        same = h[1:] == h[:-1]
        before, after = np.r_[tied, same], np.r_[same, False]
        first = np.r_[True, ~same | (size[1:] != size[:-1])]
        lead = sig[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        if len(held[0]):
            lead[: int(np.argmax(first[1:])) + 1 if first[1:].any() else len(h)] = lead0
        many = before | after
        done = len(h) - (b is not None)
        many[done:] = False
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (h, sig, n, pos, lead)], ["h", "sig", "n", "pos", "lead"])
        held, lead0, tied = [x[done:] for x in cols], int(lead[-1]), bool(before[-1])


def _fits(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether sets i and j can be similar if h, at ``pos`` of their orders, is their first common member."""
    total = n[i] + n[j]
    least = -(-total * similarity.numerator // (similarity.numerator + similarity.denominator))
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least


def _cross_pairs(batches: Iterator[pa.RecordBatch], similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """Rows of ``(h, sig, n, pos, root[, sketch])`` sorted by h -> different pairs of one h with unlike roots that sizes, positions and sketches let be similar."""
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int64, object)
    held: list[np.ndarray] = []
    p, q = similarity.numerator, similarity.denominator
    found: list[np.ndarray] = []

    def told() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    def small(cols: list[np.ndarray]) -> None:
        h, sig, n, pos, root = cols
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[start, len(h)])
        for s in np.unique(count[count > 1]):
            x, y = np.triu_indices(s, 1)
            at, step = start[count == s], max(1, 1_000_000 // len(x))
            for k in range(0, len(at), step):
                i, j = (at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel()
                ok = (root[i] != root[j]) & _fits(n, pos, i, j, similarity)
                if ok.any():
                    a, b = sig[i[ok]], sig[j[ok]]
                    found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))

    def large(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = cols[0]
        edge = np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            at = s + np.argsort(cols[2][s:e], kind="stable")
            sig, n, pos, root, bits = (x[at] for x in cols[1:])
            bits = [np.frombuffer(x, np.uint64) for x in bits]
            words = np.array([len(x) for x in bits])
            far = np.searchsorted(n, n * q // p, side="right")
            for w in np.unique(words):
                lo = int(np.searchsorted(words, w))
                own = np.flatnonzero(words == w)
                hi = int(far[own].max())
                folded = np.stack([fold(x, int(w)) for x in bits[lo:hi]])
                for i in own:
                    j = i + 1 + np.flatnonzero(root[i + 1 : far[i]] != root[i])
                    j = j[_fits(n, pos, np.full(len(j), i), j, similarity)]
                    for c in range(0, len(j), max(1, (1 << 20) // int(w))):
                        k = j[c : c + max(1, (1 << 20) // int(w))]
                        total = n[k] + n[i]
                        k = k[chains_hold(folded[k - lo] ^ folded[i - lo], total - 2 * (-(-total * p // (p + q))))]
                        if len(k):
                            found.append(np.stack([np.minimum(sig[i], sig[k]), np.maximum(sig[i], sig[k])], 1))
                    if len(found) > 1 << 10:
                        yield told()

    for b in chain(batches, (None,)):
        if b is not None:
            new = [np.array(b.column(i).to_pylist(), object) if kinds[i] is object else b.column(i).to_numpy(zero_copy_only=False).astype(kinds[i]) for i in range(b.num_columns)]
            held = [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)] if held else new
        if not held or not len(held[0]):
            continue
        cut = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            if len(held) == 5:
                small([x[:cut] for x in held])
            else:
                yield from large([x[:cut] for x in held])
            held = [x[cut:] for x in held]
        if sum(map(len, found)) > 1 << 18:
            yield told()
    if found:
        yield told()


def _near(pairs: DataFrame, sketches: DataFrame, similarity: Fraction) -> DataFrame:
    """The ``pairs(a, b)`` whose sizes and sketches ``(sig, n, sketch)`` let them be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + b.column(3).to_numpy(zero_copy_only=False)
            budget = n - 2 * (-(-n * similarity.numerator // (similarity.numerator + similarity.denominator)))
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(i).to_pylist()] for i in (4, 5))
            words = np.array([min(len(u), len(v)) for u, v in zip(x, y, strict=True)])
            keep = np.zeros(b.num_rows, dtype=bool)
            for w in np.unique(words):
                at = np.flatnonzero(words == w)
                keep[at] = chains_hold(np.stack([fold(x[i], int(w)) ^ fold(y[i], int(w)) for i in at]), budget[at])
            yield b.select(["a", "b"]).filter(pa.array(keep))

    one, two = (sketches.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"of_{k}")) for k in ("a", "b"))
    return arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b"), run, "a long, b long")


def _members(docs: DataFrame, text_col: str, need: DataFrame, shingle: int) -> DataFrame:
    """``(sig, members)`` of the sets of the rows in ``need(sig, row)``."""
    slots = np.zeros(SLOTS, dtype=bool)
    slots[need.select(F.col("row").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("x")).distinct().toArrow().column(0).to_numpy()] = True
    bits = np.packbits(slots)
    small_batches(docs.sparkSession)
    texts = docs.select(row_keys(docs.columns)[0], F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False) & (SLOTS - 1)
            b = b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            sets = {signature(s): s.tobytes() for s in (shingle_set(t, shingle) for t in bytes_column(b, "text"))}
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], ["sig", "members"])

    return arrow_map(texts, run, "sig long, members binary").join(need.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The ``pairs(a, b)`` whose sets ``(sig, members)`` are similar, compared member by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                keep.append(int((both[1:] == both[:-1]).sum()) >= least_overlap(len(x) + len(y), similarity))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("sig").alias(k), F.col("members").alias(f"of_{k}")) for k in ("a", "b"))
    return arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b"), run, "a long, b long")


def links(docs: DataFrame, about: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """``(node, root)`` on the names of sets: the components of all pairs with Jaccard ``similarity`` or more; ``about`` as of :func:`_described`.

    Two sets that are similar share a member of their prefixes. Each set is first compared with one
    set for each prefix member and size class (the first by name), which joins a group in as many
    comparisons as it has members; then all pairs that share a prefix member, fit in size and
    position and are not in one component yet are compared. So no pair is missed, and few are made
    inside a group. A comparison is one of sketches first (pigeonring chains, then all bits);
    only sets of pairs that pass are fetched from the texts and compared member by member.
    """
    told = about.where("sketch is not null")
    size = F.floor(F.log("n") / F.log(F.lit(float(1 / similarity)))).cast("int") if similarity < 1 else F.col("n")
    rows = told.select("sig", "n", F.posexplode("prefix").alias("pos", "h")).select("h", size.alias("size"), "sig", "n", "pos")
    shared = arrow_map(rows.repartition("h").sortWithinPartitions("h", "size", "sig"), _shared, "h long, sig long, n int, pos int, lead long")
    shared = materialize(shared, "setsim-shared")
    sketches = told.select("sig", "n", "sketch").dropDuplicates(["sig"])
    places = told.select("sig", "row")

    def compared(pairs: DataFrame, tag: str) -> DataFrame:
        near = materialize(_near(pairs, sketches, similarity), f"setsim-near-{tag}")
        need = places.join(near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "sig"), "sig", "left_semi")
        need = materialize(need.groupBy("sig").agg(F.min("row").alias("row")), f"setsim-need-{tag}")
        return materialize(similar(near, _members(docs, text_col, need, shingle), similarity), f"setsim-links-{tag}")

    first = shared.where("sig <> lead").select(F.least("sig", "lead").alias("a"), F.greatest("sig", "lead").alias("b")).distinct()
    first = materialize(first, "setsim-first")
    found = compared(first, "first")
    roots = connected_components(found, "setsim-roots")
    rooted = shared.join(roots, shared["sig"] == roots["node"], "left").select("h", "sig", "n", "pos", F.coalesce("root", "sig").alias("root")).repartition("h")
    mixed = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("h", "c")
    left = materialize(rooted.join(mixed, "h").select("h", "sig", "n", "pos", "root", "c"), "setsim-left")
    few = left.where(F.col("c") <= FEW).drop("c")
    many = left.where(F.col("c") > FEW).drop("c").join(sketches.select("sig", "sketch"), "sig").select("h", "sig", "n", "pos", "root", "sketch")
    parts = [arrow_map(x.repartition("h").sortWithinPartitions("h"), lambda it: _cross_pairs(it, similarity), "a long, b long") for x in (few, many)]
    rest = materialize(parts[0].unionByName(parts[1]).distinct().join(first, ["a", "b"], "left_anti"), "setsim-rest")
    return connected_components(found.unionByName(compared(rest, "rest")), "setsim-edges")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """``(row, row2, n)``, written: the one row of each component that stays, n its equal copies; the least doc_id, null last, then the least key."""
    about = materialize(_described(docs, id_col, text_col, shingle, similarity), "setsim-about")
    roots = links(docs, about, text_col, shingle, similarity)
    rows = about.groupBy("sig", "row", "row2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = rows.join(roots, rows["sig"] == roots["node"], "left").withColumn("root", F.coalesce("root", "sig"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "row2", "n")).alias("x"))
    return materialize(least.select("x.row", "x.row2", "x.n"), "setsim-kept")
