"""Page cache as a table of batches: point reads with a time to live, last write wins."""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import cache_key, expired
from webloom.session import materialize, ship_package

PAGE = "struct<url:string,title:string,markdown:string,etag:string,last_modified:string,content_hash:string>"
SCHEMA = f"key string, t bigint, p {PAGE}"


def latest(entries: DataFrame) -> DataFrame:
    """One entry a key: the last written; of equal times the greatest page. An aggregate, so a hot key is summed before the shuffle."""
    return entries.groupBy("key").agg(F.max(F.struct("t", "p")).alias("e")).select("key", "e.t", "e.p")


def with_entries(frontier: DataFrame, entries: DataFrame) -> DataFrame:
    """``frontier(url, ...)`` with ``entry`` (t and p of its url, or null), fresh or not. A short frontier filters the entries beside their scan."""
    e = entries.select(F.col("key").alias("__key"), F.struct("t", "p").alias("entry"))
    e = e.join(frontier.select(cache_key(F.col("url")).alias("__key")).distinct(), "__key", "left_semi")
    return frontier.join(e, cache_key(F.col("url")) == F.col("__key"), "left").drop("__key")


def fresh(entry: Column, now: Column, ttl_seconds: int) -> Column:
    return F.coalesce(entry.isNotNull() & ~expired(now, entry["t"], ttl_seconds), F.lit(False))


def lookup(frontier: DataFrame, entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """``frontier(url, ...)`` with ``hit`` (the page, or null): entries older than the ttl are misses."""
    got = with_entries(frontier, entries)
    return got.withColumn("hit", F.when(fresh(F.col("entry"), now, ttl_seconds), F.col("entry.p"))).drop("entry")


def stats(entries: DataFrame) -> DataFrame:
    """``(entries, bytes)``."""
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length(F.to_json("p"))), F.lit(0)).alias("bytes"))


def change_status(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``status``: new, changed or unchanged by content hash against the cache."""
    e = entries.select(F.col("key").alias("__key"), F.col("p.content_hash").alias("__old"))
    got = pages.join(e, cache_key(F.col("url")) == F.col("__key"), "left")
    status = F.when(F.col("__key").isNull(), "new").when(F.col("__old").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("changed")
    return got.withColumn("status", status).drop("__key", "__old")


#: A row for each data file of a batch: its least and greatest key, a Bloom filter of its keys, and the batches that its batch replaces.
INDEX = "file string, batch string, n bigint, bytes bigint, low string, high string, bloom binary, replaces array<string>"
#: Bits a key and probes a key of a filter: about one in a hundred keys that aren't there seem to be.
BITS, PROBES = 10, 7
#: Keys that are looked up by the index; more read all entries beside the scan.
POINT = 4096


_INDEX = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[k]) for n, k in (f.split() for f in INDEX.split(", "))])


def _hashes(keys: list[str]) -> np.ndarray:
    """Two whole numbers a key; probe i is the first and i times the second."""
    raw = b"".join(hashlib.blake2b(k.encode(), digest_size=8).digest() for k in keys)
    return np.frombuffer(raw, "<u4").reshape(-1, 2).astype(np.uint64)


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes[:, :1] + hashes[:, 1:] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def bloom(keys: list[str]) -> bytes:
    """A filter of whole bytes, BITS bits a key."""
    held = np.zeros(-(-max(len(keys), 1) * BITS // 8) * 8, np.uint8)
    held[_probes(_hashes(keys), len(held)).ravel()] = 1
    return np.packbits(held).tobytes()


def may_hold(data: bytes, hashes: np.ndarray) -> np.ndarray:
    """For each key whether a filter holds it; a no is certain."""
    held = np.unpackbits(np.frombuffer(data, np.uint8))
    return held[_probes(hashes, len(held))].all(axis=1)


class PageCache:
    """A cache at a path of any store: ``<epoch>/<batch>/data`` and ``index``, and a table of epochs, of which the last counts.

    An upsert adds a batch and rewrites nothing, so writers don't disturb each other. A batch's entries are sorted, each of
    its files holds a range of keys, and its index has a row a file; it counts once the index is written. Looking up a few
    keys asks the index first and opens only files that can hold one of them. :meth:`compact` merges batches of like size; the merged
    batch names those it replaces, which counts from the moment its index is there. Clearing starts a new epoch
    (not beside a writer: its batch goes to the old one).
    """

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = 72 * 3600, file_rows: int = 1 << 16) -> None:
        self.spark, self.path, self.ttl, self.file_rows = spark, path.rstrip("/"), ttl_seconds, file_rows

    def _listed(self, path: str, done: str = "_SUCCESS") -> list[str]:
        """Written tables under ``path``; none if there is no such folder. Any other failure is one."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        found = [s.getPath() for s in fs.listStatus(where) if s.isDirectory()]
        return sorted(p.toString() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, done)))

    def _epoch(self) -> str:
        points = self._listed(f"{self.path}/epochs")
        row = self.spark.read.schema("epoch string, n bigint").parquet(*points).orderBy(F.desc("n"), "epoch").first() if points else None
        return row["epoch"] if row else "e-0"

    def _begin(self, epoch: str) -> None:
        stamp = F.unix_micros(F.current_timestamp())
        self.spark.range(1).select(F.lit(epoch).alias("epoch"), stamp.alias("n")).coalesce(1).write.parquet(f"{self.path}/epochs/{epoch}")

    def index(self) -> DataFrame:
        """The index rows of all batches that count."""
        batches = self._listed(f"{self.path}/{self._epoch()}", "index/_SUCCESS")
        if not batches:
            return self.spark.createDataFrame([], INDEX)
        rows = self.spark.read.schema(INDEX).parquet(*[f"{b}/index" for b in batches])
        if len(batches) == 1:
            return rows
        gone = rows.select(F.explode("replaces").alias("batch")).distinct()
        return rows.join(gone, "batch", "left_anti")

    def _batches(self) -> dict[str, int]:
        """Bytes of each batch that counts: a row a batch."""
        return {r["batch"]: r["bytes"] for r in self.index().groupBy("batch").agg(F.sum("bytes").alias("bytes")).collect()}

    def _read(self, paths: list[str]) -> DataFrame:
        return latest(self.spark.read.schema(SCHEMA).parquet(*paths)) if paths else self.spark.createDataFrame([], SCHEMA)

    def entries(self) -> DataFrame:
        """All entries, the last of each key."""
        return self._read([f"{b}/data" for b in sorted(self._batches())])

    def candidates(self, keys: list[str]) -> list[str]:
        """The files that can hold one of ``keys``: their range and their filter say so. At most a file a key and batch, and the filters' errors."""
        hashed = sorted(zip(keys, _hashes(keys).tolist(), strict=True))
        shared = self.spark.sparkContext.broadcast(([k for k, _ in hashed], np.array([h for _, h in hashed], np.uint64).reshape(-1, 2)))
        ship_package(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, hashes = shared.value
            for b in batches:
                found = []
                for file, low, high, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    part = hashes[bisect_left(keys, low) : bisect_right(keys, high)]
                    if len(part) and may_hold(data, part).any():
                        found.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["file"])

        inside = (F.col("high") >= min(keys)) & (F.col("low") <= max(keys))
        return sorted(r["file"] for r in self.index().where(inside).select("file", "low", "high", "bloom").mapInArrow(run, "file string").collect())

    def point(self, keys: list[str]) -> DataFrame:
        """The last entries of a few keys."""
        files = self.candidates(keys) if keys else []
        if not files:
            return self.spark.createDataFrame([], SCHEMA)
        return latest(self.spark.read.schema(SCHEMA).parquet(*files).where(F.col("key").isin(keys)))

    def entries_for(self, frontier: DataFrame) -> DataFrame:
        """Entries that hold all that ``frontier(url)`` asks for: by the index where it asks for few keys, else all."""
        keys = [r[0] for r in frontier.select(cache_key(F.col("url"))).distinct().take(POINT + 1)]
        return self.entries() if len(keys) > POINT else self.point([k for k in keys if k is not None])

    def lookup(self, frontier: DataFrame, now: Column | None = None) -> DataFrame:
        return lookup(frontier, self.entries_for(frontier), F.unix_timestamp() if now is None else now, self.ttl)

    def upsert(self, pages: DataFrame, now: Column | None = None) -> None:
        """``pages(url, title, markdown, etag, last_modified, content_hash)``; time is now, in whole seconds."""
        p = F.struct("url", "title", "markdown", "etag", "last_modified", "content_hash").cast(PAGE)
        rows = pages.select(cache_key(F.col("url")).alias("key"), (F.unix_timestamp() if now is None else now).cast("bigint").alias("t"), p.alias("p"))
        self._add(latest(rows.where(F.col("key").isNotNull())), [])

    def _add(self, entries: DataFrame, replaces: list[str]) -> str:
        """Writes a batch: the entries once, then by ranges of their keys (Spark finds the ranges by reading them again), then the index."""
        batch = f"{self.path}/{self._epoch()}/batch-{uuid.uuid4().hex}"
        ranged = materialize(entries, "cache-batch").repartitionByRange("key").sortWithinPartitions("key")
        ranged.write.option("maxRecordsPerFile", self.file_rows).parquet(f"{batch}/data")
        ship_package(self.spark)

        def row(table: pa.Table) -> pa.Table:
            keys = table.column("key").to_pylist()
            cells = [table.column("file")[0].as_py(), batch, len(keys), table.column("bytes")[0].as_py(), min(keys), max(keys), bloom(keys), replaces]
            return pa.Table.from_pylist([dict(zip([f.split()[0] for f in INDEX.split(", ")], cells, strict=True))], schema=_INDEX)

        data = self.spark.read.schema(SCHEMA).parquet(f"{batch}/data").select("key", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        data.groupBy("file").applyInArrow(row, INDEX).write.parquet(f"{batch}/index")
        return batch

    def compact(self, fanout: int = 4) -> int:
        """Merges batches of like size while ``fanout`` of them are in one tier (sizes between powers of ``fanout``); gives the number of merges.

        So an entry is rewritten once a tier, and a key lies in no more than ``fanout`` batches a tier. With ``fanout`` 1 all become one.
        """
        merges = 0
        while True:
            sizes, tiers = self._batches(), {}
            for b, n in sorted(sizes.items()):
                tiers.setdefault(0 if fanout == 1 else max(n, 1).bit_length() // (fanout.bit_length() - 1), []).append(b)
            full = next((t for t in tiers.values() if len(t) >= max(fanout, 2)), None)
            if full is None:
                return merges
            self._add(self._read([f"{b}/data" for b in full]), full)
            merges += 1

    def clear(self) -> None:
        self._begin(f"e-{uuid.uuid4().hex}")

    def stats(self) -> DataFrame:
        return stats(self.entries())
