"""Helpers of the training-data operators: words, written tables, Arrow loops."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import materialize, ship_package

__all__ = ["arrow_map", "aside", "ascii_lower", "bytes_column", "inline_table", "join_counted", "materialize", "small_batches", "words_of"]

#: Word rule of the contracts on bytes: A-Z become a-z; 0-9, a-z and every byte from 0x80 stay; the rest separates.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same rule as a Java / RE2 pattern, for text that is already lower-cased in A-Z.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text by the rule above; null has none."""
    return text.translate(WORD_TABLE).split() if text else []


def ascii_lower(col):
    """Lower-case A-Z only, natively."""
    return F.translate(col, UPPER, LOWER)


def bytes_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Bytes of an Arrow batch.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes, since a text may be long; always the same setting, and results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns called like ``names`` renamed, and the selection that gives its own columns back."""
    new = {}
    for c in df.columns:
        new[c] = c
        while new[c] in names or (new[c] != c and new[c] in df.columns):
            new[c] += "_"
    return df.withColumnsRenamed(new), [F.col(f"`{n}`").alias(c) for c, n in new.items()]


#: Keys that more than one in so many of all rows have are joined by a broadcast; there are fewer than this.
HOT = 10_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n", hot: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and, in ``n``, how many of ``rows`` have it (the column is dropped).

    Keys with a large share of all rows go by a broadcast of at most HOT rows, the rest by a shuffle without a hot key.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * (hot or HOT) > total
    few, many = table.where(often).drop(n), table.where(~often).drop(n)
    return rows.join(F.broadcast(few), keys).unionByName(rows.join(F.broadcast(few.select(keys)), keys, "left_anti").join(many, keys))


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver as one literal, without a Python stage; ``schema`` like ``a int, b string``."""
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    kind = ", ".join(f"{f.split()[0]}: {' '.join(f.split()[1:])}" for f in schema.split(", "))
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{kind}>>")))
