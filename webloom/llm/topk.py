"""Exact top-k search: inner products added up dimension block by dimension block, what cannot reach the k-th best let go."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, materialize, small_batches
from webloom.llm.vectors import EXACT, LONG, exact_dot, finite, largest, matrix, whole

#: An entry x becomes floor(FACTOR * x).
FACTOR = 1024
TOP = 10
#: Rows whose id this divides are queries.
EVERY = 100
#: Dimensions of a block.
DIMS = 8
#: Bytes of queries that one pass over the candidates holds.
BLOCK_BYTES = 16 << 20
#: Queries of a block that the first lower bounds come from (any rows would do; results don't depend on it), and queries compared at once.
PILOT, TILE = 1024, 512
#: A block is gone through in a matrix while more than this share of its pairs is left, then pair by pair.
DENSE = 0.1
_NO_ID = np.int64(LONG)
_LEAST = -float("inf")
OUT = "query_id long, rank int, vec_id long, score long"


@dataclass
class Columns:
    """Vectors in vertical layout: a row of ``v`` is a dimension; ``rest[b]`` is the length of what comes after the first ``b`` blocks."""

    v: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, m: np.ndarray, order: np.ndarray, dims: int = DIMS) -> Columns:
        v = np.ascontiguousarray(m[:, order].T.astype(np.float64))
        tail = np.concatenate([np.cumsum((v * v)[::-1], axis=0)[::-1], np.zeros((1, v.shape[1]))])
        ends = [*range(0, len(v), dims), len(v)]
        return cls(v, np.sqrt(tail[ends]) * (1 + 1e-12))

    def take(self, part: slice) -> Columns:
        return Columns(self.v[:, part], self.rest[:, part])


def survivors(q: Columns, c: Columns, least: np.ndarray, dims: int = DIMS, dense: float = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate, score) that reach ``least`` of their query, exactly.

    Block by block: what a pair has so far, and at most the product of both rests' lengths (Cauchy
    and Schwarz); pairs that cannot reach the bound any more go, the rest is compacted.
    """
    nq, nc = q.v.shape[1], c.v.shape[1]
    acc, pairs = np.zeros((nq, nc)), None
    for b, at in enumerate(range(0, len(q.v), dims)):
        block = slice(at, at + dims)
        if pairs is None:
            acc += q.v[block].T @ c.v[block]
            alive = acc + q.rest[b + 1][:, None] * c.rest[b + 1] >= least[:, None]
            if np.count_nonzero(alive) <= dense * alive.size:
                pairs = np.nonzero(alive)
                acc = acc[pairs]
        else:
            i, j = pairs
            for row_q, row_c in zip(q.v[block], c.v[block], strict=True):
                acc += row_q[i] * row_c[j]
            alive = acc + q.rest[b + 1][i] * c.rest[b + 1][j] >= least[i]
            pairs, acc = (i[alive], j[alive]), acc[alive]
    if pairs is None:
        pairs = np.nonzero(acc >= least[:, None])
        acc = acc[pairs]
    return pairs[0], pairs[1], acc.astype(np.int64)


def every_pair(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of vectors whose products doubles can't hold, in Python's integers; a score that no long holds is the nearest long."""
    scores = np.clip(exact_dot(q, np.ascontiguousarray(c.T)), -LONG, LONG).astype(np.int64)
    i, j = np.indices(scores.shape)
    return i.ravel(), j.ravel(), scores.ravel()


class Best:
    """The best ``k`` of each query so far: by score, then by the smaller id (null last)."""

    def __init__(self, n: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.q, self.score, self.id, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(q):
            return
        q, score, ids, null = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, q))
        q, score, ids, null = q[order], score[order], ids[order], null[order]
        first = np.r_[True, q[1:] != q[:-1]]
        place = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = place < self.k
        self.q, self.score, self.id, self.null = q[kept], score[kept], ids[kept], null[kept]
        full = place == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], score[full].astype(np.float64))


@dataclass
class Queries:
    """A bounded block of queries of one length, ready to be searched for in candidates."""

    ids: np.ndarray
    m: np.ndarray
    order: np.ndarray
    columns: Columns
    least: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, m: np.ndarray, k: int, pilot: int = PILOT) -> Queries:
        """Dimensions go by falling weight among the queries. The first lower bounds are the k-th best among some of the block's own rows, which are candidates too."""
        order = np.argsort(-(m.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        columns, least = Columns.of(m, order), np.full(len(m), _LEAST)
        self = cls(ids, m, order, columns, least)
        some = np.unique(ids, return_index=True)[1][:pilot]  # a row of each id, so that no row counts twice
        if largest(m) ** 2 * m.shape[1] < EXACT and len(some) > k:
            for at in range(0, len(m), TILE):
                scores = columns.v[:, at : at + TILE].T @ columns.v[:, some]
                scores[ids[at : at + TILE, None] == ids[some]] = _LEAST
                least[at : at + TILE] = np.partition(scores, len(some) - k, axis=1)[:, len(some) - k]
        return self

    def search(self, best: Best, ids: np.ndarray, null: np.ndarray, m: np.ndarray) -> None:
        """Adds what these candidates have to ``best``; a query's own row (a row of its id) is none."""
        if max(largest(m), largest(self.m)) ** 2 * m.shape[1] < EXACT:
            c = Columns.of(m, self.order)
            found = ((at, *survivors(self.columns.take(slice(at, at + TILE)), c, best.least[at : at + TILE])) for at in range(0, len(self.m), TILE))
        else:
            found = ((at, *every_pair(self.m[at : at + TILE], m)) for at in range(0, len(self.m), TILE))
        for at, i, j, score in found:
            other = null[j] | (self.ids[at + i] != ids[j])
            best.add(at + i[other], score[other], ids[j[other]], null[j[other]])


def search(rows: DataFrame, queries: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``queries(query_id, v)`` against all of ``rows(vec_id, v)``, vectors of longs: ``(query_id, rank, vec_id, score)``.

    The queries go in blocks of ``block_bytes`` (by a hash of the row); the driver holds one block at
    a time, each block meets all candidates in one pass. A task hands on at most ``k`` rows a query, and of
    these only what reaches the bound that the block's own rows set; ranks are given by Spark.
    """
    spark = rows.sparkSession
    queries = materialize(queries.where(F.size("v") > 0).distinct().withColumn("d", F.size("v")), "topk-queries")
    found: list[DataFrame] = []
    for length in queries.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect():
        d, n = length["d"], -(-length["n"] * (length["d"] + 1) * 8 // block_bytes)
        for block in range(n):
            part = queries.where((F.col("d") == d) & (F.pmod(F.xxhash64("query_id", "v"), F.lit(n)) == block)).select("query_id", "v")
            held = part.toArrow()
            if not held.num_rows:
                continue
            m = np.concatenate([matrix(b, "v", d) for b in held.to_batches()])
            q = Queries.of(held.column("query_id").to_numpy(), m, k)
            shared = spark.sparkContext.broadcast(q)

            def run(batches: Iterator[pa.RecordBatch], d: int = d, shared=shared) -> Iterator[pa.RecordBatch]:
                q = shared.value
                best = Best(len(q.ids), k, q.least)
                for b in batches:
                    if b.num_rows:
                        null = b.column(0).is_null().to_numpy(zero_copy_only=False)
                        q.search(best, b.column(0).fill_null(int(_NO_ID)).to_numpy(), null, matrix(b, "v", d))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best.q), pa.array(q.ids[best.q]), pa.array(best.id, mask=best.null), pa.array(best.score)], ["q", "query_id", "vec_id", "score"]
                )

            small_batches(spark)
            found.append(arrow_map(rows.where(F.size("v") == d), run, "q long, query_id long, vec_id long, score long").withColumn("block", F.lit(len(found))))
    if not found:
        return spark.createDataFrame([], OUT)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = TOP, every: int = EVERY, factor: int = FACTOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` greatest integer inner products of each row whose id ``every`` divides, with all other rows.

    Vectors that are null or hold null or non-finite entries take no part, an empty vector neither. A row without an id is
    no query, as a candidate it comes last among ties. Candidates have the query's length. A query's own row
    is any row of its id; rows of one id with different vectors are queries of their own, whole copies
    are one. Repeated candidates each count. A query with fewer than ``k`` candidates gets all of
    them, with none no row. Entries and scores that no long holds are the nearest long. An empty
    table gives no row; other columns are ignored.
    """
    e = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("e")).where(finite(F.col("e")))
    rows = e.select("vec_id", whole(F.col("e"), factor).alias("v"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    return search(rows, queries, k, block_bytes)


def oracle_sql() -> str:
    """The same in DuckDB's SQL: every query against every row."""
    good = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
    return f"""WITH v AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda e: floor({FACTOR} * e::DOUBLE)) AS v FROM embeddings WHERE {good}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, c.rn AS rn, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, rn) AS rank FROM s) WHERE rank <= {TOP}"""
