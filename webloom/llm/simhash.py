"""SimHash near-duplicates: pigeonring-filtered Hamming links and their components."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import setsim
from webloom.llm.common import arrow_map, aside, bytes_column, join_counted, materialize, small_batches
from webloom.llm.components import connected_components

SEED = 42
#: Members of a bucket that are compared directly; a larger bucket is refined first.
BUCKET = 256
#: Ring of four segments. Chains (start i): segments i and i+1 equal; or i equal, i+1 off by one bit, i+2 equal.
CHAINS = ((0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: bit is 1 if set in over half of the shingles' XXH64."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.array([digest(join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``: one row for each row of ``docs``; whole texts, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in bytes_column(b, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _ring(df: DataFrame, width: int) -> DataFrame:
    """Six chain buckets for each row of ``(fp, bucket, rest)``; ``rest`` keeps the bits a bucket leaves open."""
    w = width // 4
    seg = [F.shiftrightunsigned("rest", w * i).bitwiseAND(F.lit((1 << w) - 1)) for i in range(4)]
    rows = []
    for n, (i, j) in enumerate(CHAINS):
        p, q = (k for k in range(4) if k not in (i, j))
        rows.append(F.struct(F.xxhash64("bucket", F.lit(width), F.lit(n), seg[i], seg[j]).alias("bucket"), F.shiftleft(seg[q], w).bitwiseOR(seg[p]).alias("rest")))
    return df.select("fp", F.explode(F.array(*rows)).alias("x")).select("fp", "x.bucket", "x.rest")


def chain_survives(x: np.ndarray) -> np.ndarray:
    """Pigeonring test on XORs: from some start, chains of 1..4 of the four 16-bit segments hold l * 2 / 4 differences at most."""
    b = [np.bitwise_count((x >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(4)]
    ok = np.zeros(x.shape, dtype=bool)
    for i in range(4):
        ok |= (b[i] == 0) & (b[(i + 1) % 4] <= 1) & (b[(i + 1) % 4] + b[(i + 2) % 4] <= 1)
    return ok


def _stars(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """``fps`` of shape (runs, members) -> (member, root) within each run's own links."""
    x = fps[:, :, None] ^ fps[:, None, :]
    link = chain_survives(x)
    link[link] = np.bitwise_count(x[link]) <= distance
    s = fps.shape[1]
    label = np.broadcast_to(np.arange(s), fps.shape)
    while True:
        new = np.where(link, label[:, None, :], s).min(axis=2)
        if (new == label).all():
            break
        label = new
    run, member = np.nonzero(label != np.arange(s))
    return fps[run, member], fps[run, label[run, member]]


def _link_sorted(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``(bucket, fp)`` sorted by bucket -> star edges; holds one batch and one open bucket."""
    kb, kf = np.empty(0, np.int64), np.empty(0, np.uint64)

    def solve(b: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        size = np.diff(np.r_[start, len(b)])
        for s in np.unique(size[size > 1]):
            at = start[size == s]
            step = max(1, 2_000_000 // int(s * s))
            for k in range(0, len(at), step):
                m, r = _stars(f[at[k : k + step, None] + np.arange(s)], distance)
                if len(m):
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(r.view(np.int64))], ["a", "b"])

    for batch in batches:
        kb = np.r_[kb, batch.column(0).to_numpy(zero_copy_only=False)]
        kf = np.r_[kf, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if len(kb):
            cut = int(np.searchsorted(kb, kb[-1]))
            if cut:
                yield from solve(kb[:cut], kf[:cut])
                kb, kf = kb[cut:], kf[cut:]
    if len(kb):
        yield from solve(kb, kf)


def hamming_edges(distinct: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: edges whose components are those of all pairs at ``distance`` (2 at most).

    Pigeonring filter with budget 2 on a ring of four segments: a pair within two bits has a start
    from which chains of 1, 2, 3 segments hold 0, 1, 1 differences, so two segments of one of the
    six chains agree. They are the bucket key. A bucket of more than ``bucket`` fingerprints is
    not compared: its open bits form the next, finer ring (64 -> 32 -> 16 bits), and after the
    third ring only 8 bits are open, so 256 different fingerprints at most. The work for a
    fingerprint thus has a fixed bound, whatever the size of its group; a bucket gives a star for
    each of its components and not its pairs.
    """
    if distance > 2:
        raise ValueError("chains are laid out for distances up to 2")
    level = distinct.select("fp", F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest"))
    parts = []
    for width in (64, 32, 16):
        level = materialize(_ring(level, width), "simhash-ring")
        if width > 16:
            heavy = level.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket")
            heavy = materialize(heavy, "simhash-heavy")
            if heavy.isEmpty():
                parts.append(level)
                break
            parts.append(level.join(heavy, "bucket", "left_anti").select("fp", "bucket", "rest"))
            level = level.join(heavy, "bucket", "left_semi").select("fp", "bucket", "rest")
        else:
            parts.append(level)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return arrow_map(rows, lambda it: _link_sorted(it, distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Equal fingerprints are one node; nodes link at ``distance`` or fewer differing bits;
    ``component_id`` is the least doc_id reachable. Null and empty texts have fingerprint zero and
    link like any other; a null doc_id never is a component's id unless nothing else is in it;
    repeated rows come out as often as they came in; other columns are ignored. A fingerprint that a
    large share of all rows has (copies, empty texts) is no hot key, see :func:`join_counted`.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = connected_components(hamming_edges(distinct.select("fp"), distance), "simhash-edges")
    nodes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    nodes = materialize(nodes, "simhash-nodes")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "component_id", "n")
    out = join_counted(fps, materialize(named, "simhash-named"), ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = setsim.SHINGLE, similarity: Fraction = setsim.SIMILARITY) -> DataFrame:
    """Keeps one row of each group: the least id's, null ids last; among rows of one id the least key of the whole row.

    Texts link at Jaccard ``similarity`` or more of their sets of ``shingle`` words, not by op 9's
    fingerprints. Of rows that are equal in all columns one stays.
    """
    kept = setsim.kept_rows(docs, id_col, text_col, shingle, similarity)
    renamed, back = aside(docs, "__row", "__row2")
    keyed = renamed.select("*", *(k.alias(f"__{n}") for n, k in zip(("row", "row2"), setsim.row_keys(renamed.columns), strict=True)))
    keys = ["__row", "__row2"]
    once, many = (kept.where(c).select(F.col("row").alias("__row"), F.col("row2").alias("__row2")) for c in ("n = 1", "n > 1"))
    out = keyed.join(once, keys, "left_semi").select(back)
    if not many.isEmpty():
        out = out.unionByName(keyed.join(many, keys, "left_semi").dropDuplicates(keys).select(back))
    return out
