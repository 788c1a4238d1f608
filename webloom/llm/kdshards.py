"""Sharding by a k-d tree over document metadata: weighted medians, widest dimension first. Native only."""

from __future__ import annotations

import math
from bisect import insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import inline_table, materialize

#: Bytes that every row has beside its text.
OVERHEAD = 16
#: Grid of the dimensions: steps of log2 size per doubling, steps of the bytes that a character takes (logarithmic from 1 to 4).
SIZE_STEPS, WIDTH_STEPS = 4, 16
#: Order of a cut cell's rows: two digits of the text's hash, then one of the id's, each of SLABS values.
DIGITS, SLABS = ("slab", "slab2", "fine"), 512
#: What straddles a cut and weighs more than this share of a shard is divided by the next digit.
FINE = 0.01
#: Sizes are evened out until the largest and the smallest shard lie this close to the mean, by this many moves at most.
EVEN, MOVES = 0.005, 5000
#: Rows of a shard's block, in whose order slots are dealt.
BLOCK_ROWS = 500_000
DIMS = ("d_size", "d_lang", "d_width")


def text_size(col: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus OVERHEAD."""
    return (F.coalesce(F.octet_length(col), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def _letter(col: Column, at: int, step: int) -> Column:
    """Place of a letter in the alphabet from 1, ``step`` letters to a place; 0 for anything else."""
    code = F.ascii(F.lower(F.substring(col, at, 1)))
    return F.when(code.between(97, 122), F.floor((code - 97) / step) + 1).otherwise(0).cast("int")


def features(docs: DataFrame) -> DataFrame:
    """Metadata, sizes and hashes of each row; coordinates depend on the text and language alone, so copies share a cell.

    Coordinates: size, the language's name in the order of its first two letters, and bytes a character.
    """
    size = text_size()
    chars = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))
    wide = F.greatest((size - OVERHEAD) / chars - 1, F.lit(0.0))
    lang = F.coalesce("lang", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.floor(F.log2(size.cast("double")) * SIZE_STEPS).cast("int").alias("d_size"),
        (_letter(lang, 1, 1) * 4 + _letter(lang, 2, 9)).alias("d_lang"),
        F.floor(F.log1p(wide * 20) * (WIDTH_STEPS / math.log(61))).cast("int").alias("d_width"),
        F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(SLABS)).cast("int").alias("slab"),
        F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(2)), F.lit(SLABS)).cast("int").alias("slab2"),
        F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SLABS)).cast("int").alias("fine"),
    )


@dataclass
class Span:
    """Part [lo, hi) of the bytes of a cell, in the order of its slabs."""

    cell: tuple[int, ...]
    lo: int
    hi: int


def _range(spans: list[Span], d: int) -> int:
    return max(s.cell[d] for s in spans) - min(s.cell[d] for s in spans)


def _halve(spans: list[Span], share: float, scale: list[int]) -> tuple[list[Span], list[Span]]:
    """Splits at the weighted quantile ``share`` along the dimension whose values lie widest apart, measured by ``scale``, the range of all rows."""
    ranges = [_range(spans, d) / max(scale[d], 1) for d in range(len(DIMS))]
    wide = max(range(len(DIMS)), key=lambda d: (ranges[d], -d))
    order = sorted(spans, key=lambda s: (s.cell[wide], s.cell, s.lo))
    goal = share * sum(s.hi - s.lo for s in spans)
    left: list[Span] = []
    right: list[Span] = []
    done = 0.0
    for s in order:
        w = s.hi - s.lo
        if done + w <= goal:
            left.append(s)
        elif done >= goal:
            right.append(s)
        else:
            cut = s.lo + round(goal - done)
            left.append(Span(s.cell, s.lo, cut))
            right.append(Span(s.cell, cut, s.hi))
        done += w
    return [s for s in left if s.hi > s.lo], [s for s in right if s.hi > s.lo]


def build_tree(cells: list[tuple[tuple[int, ...], int]], shards: int) -> list[list[Span]]:
    """Leaves of the k-d tree over weighted cells, each with its target of bytes; empty leaves only if there is nothing to give."""

    def split(spans: list[Span], k: int) -> list[list[Span]]:
        if k == 1 or not spans:
            return [spans] + [[] for _ in range(k - 1)]
        a, b = _halve(spans, (k // 2) / k, scale)
        return split(a, k // 2) + split(b, k - k // 2)

    every = [Span(c, 0, w) for c, w in cells]
    scale = [_range(every, d) for d in range(len(DIMS))] if every else []
    return split(every, shards)


def evened(weights: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """Moves ``(shard, slab) -> shard`` that bring the sums of ``weights`` close together.

    The fullest shard gives to the emptiest one what lies closest to half of their difference: a slab, or a
    slab in exchange for one; if that doesn't bring the pair closer to the mean, the next emptiest, and so on.
    It ends when all lie within EVEN of the mean or neither the fullest nor the emptiest finds a partner.
    """
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(shards)]
    for (n, slab), w in sorted(weights.items()):
        held[n].append((w, n, slab))
    for h in held:
        h.sort()
    size = np.array([sum(w for w, *_ in h) for h in held], np.int64)
    mean = size.sum() / shards

    def exchange(a: int, b: int) -> tuple[float, int, int]:
        """The lesser greatest distance from the mean of shards a and b, and the places in their slabs that give it (one past the end: none)."""
        give, take = (np.array([w for w, *_ in held[x]] + [0], np.int64) for x in (a, b))
        order = np.argsort(take, kind="stable")
        at = np.clip(np.searchsorted(take[order], give - (size[a] - size[b]) / 2), 1, max(len(take) - 1, 1))
        near = np.stack([order[at - 1], order[np.minimum(at, len(take) - 1)]])
        net = give[None, :] - take[near]
        left = np.maximum(np.abs(size[a] - net - mean), np.abs(size[b] + net - mean))
        k, i = np.unravel_index(int(left.argmin()), left.shape)
        return float(left[k, i]), int(i), int(near[k, i])

    for _ in range(MOVES):
        order = np.argsort(size, kind="stable").tolist()
        if max(size[order[-1]] - mean, mean - size[order[0]]) <= EVEN * mean:
            break
        for a, b in [(order[-1], x) for x in order[:-1]] + [(x, order[0]) for x in reversed(order[1:-1])]:
            found, i, j = exchange(a, b)
            if found < max(abs(size[a] - mean), abs(size[b] - mean)):
                break
        else:
            break
        moved = [(a, b, held[a].pop(i))] if i < len(held[a]) else []
        moved += [(b, a, held[b].pop(j))] if j < len(held[b]) else []
        for source, target, item in moved:
            insort(held[target], item)
            size[source] -= item[0]
            size[target] += item[0]
    return {(n, slab): x for x in range(shards) for _, n, slab in held[x] if n != x}


def _assign(table: DataFrame, leaves: list[list[Span]], weights: dict[tuple[int, ...], int], target: float) -> DataFrame:
    """Adds ``shard``. Whole cells by a lookup; cut cells digit by digit of their rows' order, as long as what straddles a cut is heavy."""
    spark = table.sparkSession
    whole: list[tuple] = []
    cut: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
    for n, leaf in enumerate(leaves):
        for s in leaf:
            if s.lo == 0 and s.hi == weights[s.cell]:
                whole.append((*s.cell, n))
            else:
                cut.setdefault(s.cell, []).append((s.lo, s.hi, n))

    def place(parts: list[tuple[int, int, int]], at: float) -> int:
        return next((n for lo, hi, n in parts if lo <= at < hi), parts[-1][2])

    keys = list(DIMS)
    schema = ", ".join(f"{d} int" for d in DIMS)
    out = table.join(F.broadcast(inline_table(spark, whole, f"{schema}, shard int")), keys, "left")
    open_keys = dict.fromkeys(cut, 0)
    for digit in DIGITS:
        rows = []
        if open_keys:
            marked = F.broadcast(inline_table(spark, list(open_keys), schema))
            sums = table.join(marked, keys, "left_semi").groupBy(*keys, digit).agg(F.sum("size").alias("w")).orderBy(*keys, digit).collect()
            following: dict[tuple[int, ...], int] = {}
            for r in sums:
                key = tuple(r[k] for k in keys)
                a, b = open_keys[key], open_keys[key] + r["w"]
                open_keys[key] = b
                parts = cut[key[: len(DIMS)]]
                if digit != DIGITS[-1] and r["w"] > FINE * target and place(parts, a) != place(parts, b - 1):
                    following[(*key, r[digit])] = a
                else:
                    rows.append((*key, r[digit], place(parts, (a + b) / 2)))
            open_keys = following
        keys, schema = [*keys, digit], f"{schema}, {digit} int"
        if rows:
            found = inline_table(spark, rows, f"{schema}, shard_{digit} int")
            out = out.join(F.broadcast(found), keys, "left").withColumn("shard", F.coalesce("shard", f"shard_{digit}")).drop(f"shard_{digit}")
    return out


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, leaf)``, one row for each row of ``docs``; law ``bytes``.

    The grid sums (cells of metadata, at most 128 * 108 * 17 of them, whatever the corpus) go to the
    driver, which lays the k-d tree: each node is split at the weighted quantile of its widest
    dimension until the leaves hold one shard's bytes. A cell that a median cuts is divided by
    text hash, so equal texts stay together unless their copies alone outweigh FINE of a shard;
    those are divided by id. At most shards - 1 cells are cut, so the sums by digit are bounded too.
    What the rows' own sizes leave uneven is evened out by moves of slabs (a text hash's rows in a leaf, at
    most SLABS a shard, see :func:`evened`); ``leaf`` is the shard before the moves.
    Slots number a shard's rows from 0 without gaps: rows are dealt to blocks of about BLOCK_ROWS
    by id hash, and each block starts after the ones before it.

    Null and empty texts weigh OVERHEAD; null ids and languages have a place of their own; repeated
    rows and equal texts are rows like any other; an empty table gives no row; other columns are
    ignored.
    """
    table = materialize(features(docs), "shards-features")
    spark = docs.sparkSession
    grid = table.groupBy(*DIMS).agg(F.sum("size").alias("w"), F.count("*").alias("n")).orderBy(*DIMS).collect()
    cells = [(tuple(r[d] for d in DIMS), r["w"]) for r in grid]
    weights = dict(cells)
    leaves = build_tree(cells, shards)
    placed = _assign(table, leaves, weights, sum(weights.values()) / shards).withColumnRenamed("shard", "leaf")
    blocks = -(-sum(r["n"] for r in grid) // (shards * BLOCK_ROWS)) + 1
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(9)), F.lit(blocks)).cast("int")
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "leaf", "slab", block.alias("block")), "shards-placed")
    by_slab = placed.groupBy("leaf", "slab").agg(F.sum("size").alias("w")).collect()
    moves = inline_table(spark, [(*k, v) for k, v in sorted(evened({(r["leaf"], r["slab"]): r["w"] for r in by_slab}, shards).items())], "leaf int, slab int, moved int")
    placed = placed.join(F.broadcast(moves), ["leaf", "slab"], "left").withColumn("shard", F.coalesce("moved", "leaf"))
    counts = placed.groupBy("shard", "block").count().orderBy("shard", "block").collect()
    rows, last, at = [], None, 0
    for r in counts:
        at = at if r["shard"] == last else 0
        last = r["shard"]
        rows.append((r["shard"], r["block"], at))
        at += r["count"]
    first = inline_table(spark, rows, "shard int, block int, first bigint")
    order = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("n", F.row_number().over(order)).join(F.broadcast(first), ["shard", "block"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "leaf"
    )
