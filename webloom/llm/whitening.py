"""Embedding whitening from an exact integer scatter: no sum is rounded before the decomposition."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, materialize, small_batches
from webloom.llm.vectors import LONG, exact_dot, finite, largest, matrix, whole

#: An entry c becomes floor(FACTOR * c) + OFFSET.
FACTOR, OFFSET = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 16
#: Bits of a part of a big number on its way through Spark's sums: 2**22 tasks' parts add up within a long.
PART = 40
OUT = "vec_id long, component int, n long, deviation long, deviation_text string, whitened double, explained double, identity_error double"


@dataclass
class Scatter:
    """What the fit list adds up to, in Python's integers: ``n`` vectors, their sums ``S`` and ``C = n * X'X - SS'`` (n squared times the covariance)."""

    n: int
    S: np.ndarray
    C: np.ndarray


def scatter(fit: DataFrame, d: int) -> Scatter:
    """Of ``fit(x array<bigint>)``, vectors of ``d`` entries.

    One vector is subtracted from all (any will do: C doesn't depend on it), so that the sums are of
    small numbers. A task adds up sums and cross-products without bounds on their size and hands on
    each number in parts of 40 bits, which Spark adds up; d * d / 2 numbers reach the driver.
    """
    shift = np.array(fit.first()["x"], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for b in batches:
            if b.num_rows:
                x = matrix(b, "x", d)
                ones = np.ones((len(x), 1), np.int64)
                if largest(x) + largest(shift) <= LONG:
                    y = np.concatenate([ones, x - shift], axis=1)
                    total += exact_dot(np.ascontiguousarray(y.T), y)
                else:
                    y = np.concatenate([ones.astype(object), x.astype(object) - shift.astype(object)], axis=1)
                    total += y.T @ y
        at, parts = [], []
        for i in range(d + 1):
            for j in range(i, d + 1):
                v, k = int(total[i, j]), 0
                while v:
                    part = v & ((1 << PART) - 1) if not -(1 << PART) < v < 1 << PART else v
                    at.append((i, j, k))
                    parts.append(part)
                    v, k = (v - part) >> PART, k + 1
        i, j, k = np.array(at, np.int32).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(k), pa.array(parts, pa.int64())], ["i", "j", "k", "v"])

    small_batches(fit.sparkSession)
    sums = arrow_map(fit, run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    m = np.zeros((d + 1, d + 1), object)
    for r in sums.toLocalIterator():
        m[r["i"], r["j"]] += r["v"] << (PART * r["k"])
    m = np.triu(m) + np.triu(m, 1).T
    n, s = m[0, 0], m[0, 1:]
    return Scatter(n, s + n * shift.astype(object), n * m[1:, 1:] - np.outer(s, s))


def components(c: Scatter, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` eigenvalues (falling), their unit vectors as columns, and each one's share of the trace.

    A vector's entry of greatest absolute value is positive. Values that double precision can't tell from nothing are 0.
    """
    square = c.n * c.n
    v = np.array([[x / square for x in row] for row in c.C], np.float64)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k].copy(), u[:, ::-1][:, :k]
    trace = sum(c.C.diagonal())
    e[e <= len(v) * np.finfo(float).eps * max(e[0], 0.0)] = 0.0
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return e, u, e / (trace / square) if trace else np.zeros(len(e))


class Whitener:
    """n * x - S exactly, and its projection; what tasks need of a fit, of a size that only the dimension decides."""

    def __init__(self, c: Scatter, e: np.ndarray, u: np.ndarray) -> None:
        self.n, self.S, self.most = c.n, c.S, max(map(abs, c.S.tolist()))
        self.P = np.where(e > 0, u / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in longs where they hold it, else in Python's integers."""
        if self.n * largest(x) + self.most <= LONG:
            return self.n * x - self.S.astype(np.int64)
        return self.n * x.astype(object) - self.S

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """(x - S / n) projected: the exact difference is rounded once, as a double."""
        return np.array(centred / self.n, np.float64) @ self.P


def identity_error(fit: DataFrame, d: int, w: Whitener, kept: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity, measured over the whole list; of components with a variance."""
    k = w.P.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            if b.num_rows:
                y = w.whitened(w.centred(matrix(b, "x", d)))
                y = np.concatenate([np.ones((len(y), 1)), y], axis=1)
                total += y.T @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    small_batches(fit.sparkSession)
    m = np.zeros((k + 1, k + 1))
    for r in arrow_map(fit, run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        m[r["i"], r["j"]] = r["v"]
    mean = m[0, 1:] / w.n
    cov = (m[1:, 1:] / w.n - np.outer(mean, mean))[np.ix_(kept, kept)]
    return float(np.abs(cov - np.eye(len(cov))).max()) if len(cov) else 0.0


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, factor: int = FACTOR, offset: int = OFFSET) -> DataFrame:
    """``(vec_id, component, n, deviation, deviation_text, whitened, explained, identity_error)``: a row for each vector and component up to ``k``.

    The fit list is each distinct whole-number vector once, so a copied vector, however often it
    stands, counts once; copies are summed up before the shuffle. Rows whose vector is null or holds
    null or non-finite entries are dropped. Of vectors of several lengths those count whose length
    most distinct vectors have (of equals the shorter); others are dropped. A component without
    variance has explained 0 and whitened null. A deviation that no long holds is null and stands in
    ``deviation_text`` (else null). An entry that no long holds is the nearest long. Null and repeated
    ids are rows like any. An empty table gives no row; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("e")).where(finite(F.col("e"))).select("vec_id", whole(F.col("e"), factor, offset).alias("x"))
    fit = materialize(rows.select("x").where(F.size("x") > 0).distinct(), "whitening-fit")
    length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], OUT)
    d = length["d"]
    fit = fit.where(F.size("x") == d)
    c = scatter(fit, d)
    e, u, explained = components(c, k)
    k = len(e)
    w = Whitener(c, e, u)
    error = identity_error(fit, d, w, np.flatnonzero(e > 0))
    shared = spark.sparkContext.broadcast((w, explained, e > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, explained, there = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            centred = w.centred(matrix(b, "x", d))
            white = w.whitened(centred)
            m = largest(centred) if centred.dtype != object else LONG
            if m * m * d <= LONG:
                dev, text = pa.array((centred * centred).sum(axis=1)), pa.nulls(len(white), pa.string())
            else:
                every = [sum(v * v for v in row) for row in centred.astype(object).tolist()]
                dev = pa.array([v if v <= LONG else None for v in every], pa.int64())
                text = pa.array([str(v) if v > LONG else None for v in every], pa.string())
            at = np.repeat(np.arange(len(white)), k)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(white))), pa.array(np.full(n, w.n)), dev.take(pa.array(at)), text.take(pa.array(at)),
                    pa.array(white.ravel(), mask=np.tile(~there, len(white))), pa.array(np.tile(explained, len(white))), pa.array(np.full(n, error)),
                ],
                ["vec_id", "component", "n", "deviation", "deviation_text", "whitened", "explained", "identity_error"],
            )

    small_batches(spark)
    return arrow_map(rows.where(F.size("x") == d), run, OUT)
