"""Connected components of an edge table: bounded pieces by union-find, then star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, materialize

#: Edges that one task contracts at a time.
PIECE = 500_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (node, least node of its component), without the roots themselves."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def solve() -> pa.RecordBatch:
        n, r = contract(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(r)], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= PIECE:
            yield solve()
            held, size = [], 0
    if size:
        yield solve()


def connected_components(edges: DataFrame, tag: str = "components", piece: int = PIECE) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for every node of an edge; root is the least node.

    Each round first contracts pieces of at most ``piece`` edges to stars, each in one task. If
    one piece holds all edges, that is the answer. Else a large-star and a small-star step follow
    (Kiveris et al., 2014): aggregations and equi-joins on the edge table; neighbours of a node
    are never gathered into one row. Every round is written; rounds end when the edges stay the
    same. Null ends and self loops are ignored; an empty table gives none.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, tag)
    seen = None
    while True:
        parts = -(-e.count() // piece)
        if parts == 0:
            break
        e = materialize(arrow_map(e.repartition(parts), _pieces, "a long, b long"), tag)
        if parts == 1:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct(), tag)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
