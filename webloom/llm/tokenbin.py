"""Token ids as bit-packed shards: minimum bits an id, blocks with offsets, vectorised unpacking, random access."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, small_batches
from webloom.session import new_path

MAGIC = b"WLTB1\0\0\0"
#: magic, bits, ids in a block, ids, documents
HEADER = struct.Struct("<8sHHQQ")
#: Ids in a block (each block starts at a byte) and in a shard, which ends with the document that reaches it.
BLOCK, SHARD_IDS = 1024, 2_000_000
END = 0
#: Different pre-tokens, and bytes of them, that a worker remembers.
MEMO, MEMO_BYTES = 600_000, 64 << 20


def bits_for(vocab: int) -> int:
    """Bits of the greatest id."""
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, each in ``bits`` bits, least bit first, without gaps."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    b = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(b.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    b = np.unpackbits(np.frombuffer(data, np.uint8, (n * bits + 7) // 8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = b
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write_shard(ids: np.ndarray, counts: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """Header, ids a document, byte offset of each block, blocks."""
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join((HEADER.pack(MAGIC, bits, block, len(ids), len(counts)), counts.astype("<u8").tobytes(), offsets.tobytes(), *blocks))


class Shard:
    """A shard's bytes, read at random: ``ids(a, b)`` opens only the blocks that it needs."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        magic, self.bits, self.block, self.n_ids, n_docs = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.counts = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.counts)]
        at += 8 * n_docs
        n = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        self.base = at + 8 * (n + 1)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from ``a`` up to ``b``."""
        if b <= a:
            return np.empty(0, np.uint32)
        i, j = a // self.block, (b - 1) // self.block
        full = self.block * self.bits % 8 == 0
        if full:
            n = min((j + 1) * self.block, self.n_ids) - i * self.block
            got = unpack(self.data[self.base + self.offsets[i] : self.base + self.offsets[j + 1]], n, self.bits)
        else:
            got = np.concatenate([unpack(self.data[self.base + self.offsets[x] : self.base + self.offsets[x + 1]], min((x + 1) * self.block, self.n_ids) - x * self.block, self.bits) for x in range(i, j + 1)])
        return got[a - i * self.block : b - i * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


#: Texts of these letters are cut into the tokenizer's own pre-tokens by ``re``; any other goes through the library whole.
_PLAIN = re.compile(r"[\t-\r -~\xa1-\xa8\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ɏ]*")
_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")


class Encoder:
    """The tokenizers library, asked once for each different pre-token of plain texts."""

    def __init__(self, json: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_str(json)
        self.special = [str(x.content) for x in self.tok.get_added_tokens_decoder().values()]
        self.line_end = self.tok.encode("\n", add_special_tokens=False).ids[0]
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, new: list[str]) -> None:
        """Encodes pre-tokens by the thousand as lines of one text: a line end is a pre-token of its own, whatever stands after it."""
        lines = [w for w in new if "\n" not in w and "\r" not in w and not w.isspace()]
        for at in range(0, len(lines), 5000):
            some = lines[at : at + 5000]
            ids = np.array(self.tok.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            parts = np.split(ids, np.flatnonzero(ids == self.line_end)) if len(ids) else []
            if len(parts) != len(some):
                continue
            self.memo.update((w, (p if k == 0 else p[1:]).tobytes()) for k, (w, p) in enumerate(zip(some, parts, strict=True)))
        alone = [w for w in new if w not in self.memo]
        for at in range(0, len(alone), 5000):
            some = alone[at : at + 5000]
            self.memo.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        memo, parts, other = self.memo, [], []
        if len(memo) > MEMO or self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        fresh: set[str] = set()
        for i, t in enumerate(texts):
            if t and (not _PLAIN.fullmatch(t) or any(s in t for s in self.special)):
                other.append(i)
                parts.append([])
                continue
            pre = _PRE.findall(t) if t else []
            parts.append(pre)
            fresh.update(set(pre).difference(memo))
        self._learn(list(fresh))
        self.held += sum(map(len, fresh))
        out = [b"".join(map(memo.__getitem__, p)) for p in parts]
        if other:
            for i, e in zip(other, self.tok.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder_for(json: str) -> Encoder:
    """One encoder for each worker process, so that tasks share what it remembers."""
    if json not in _encoders:
        _encoders[json] = Encoder(json)
    return _encoders[json]


def write(docs: DataFrame, tokenizer: str, vocab: int, path: str) -> None:
    """Writes shards in ascending doc_id order (nulls first) as ``part, seq, first, ids, doc_ids, data``.

    A row of the table is one shard file's bytes with its place; a table, since only Spark's
    writers reach every store and commit only whole tasks. ``first`` counts the ids of the same
    part before the shard; parts are ranges of doc_id in order. The texts are put in order before
    they are encoded, since ranges are found by reading their rows once more, which must not cost
    an encoding. The driver reads the tokenizer's file (a few MB) and broadcasts it. Each id and
    each document's end id take the vocabulary's least number of bits.
    """
    spark = docs.sparkSession
    bits = bits_for(vocab)
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("text").alias("h"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "n", "h").sortWithinPartitions("doc_id", "n", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(shared.value)
        part, seq, first, total = TaskContext.get().partitionId(), 0, 0, 0
        names = ["part", "seq", "first", "ids", "doc_ids", "data"]
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def shard() -> pa.RecordBatch:
            data = write_shard(np.concatenate(held), np.array([len(x) for x in held], np.int64), bits)
            cols = [pa.array([x], pa.int64()) for x in (part, seq, first, total)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([doc_ids], pa.list_(pa.int64())), pa.array([data], pa.binary())], names)

        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + END.to_bytes(4, "little"), "<u4")
                held.append(ids.astype(np.uint16) if bits <= 16 else ids)
                doc_ids.append(d)
                total += len(ids)
                if total >= SHARD_IDS:
                    yield shard()
                    seq, first, held, doc_ids, total = seq + 1, first + total, [], [], 0
        if held:
            yield shard()

    arrow_map(rows, run, "part long, seq long, first long, ids long, doc_ids array<bigint>, data binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the shards' bytes.

    The ids before each part come from the parts' totals (a row a part, so bounded by the number
    of partitions); inside a part the shard knows its own place.
    """
    shards = spark.read.parquet(path)
    ends = shards.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()
    before, at = [], 0
    for r in ends:
        before.append((r["part"], at))
        at += r["ids"]
    base = dict(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, ids, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                s = Shard(data)
                every = s.ids(0, s.n_ids).astype("<u4")
                crc = [zlib.crc32(every[x:y]) for x, y in zip(s.starts[:-1], s.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s.starts[:-1] + base[part] + first), pa.array(s.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(spark)
    return arrow_map(shards.select("part", "first", "doc_ids", "data"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, vocab: int = 50257) -> DataFrame:
    """Writes the shards of ``docs`` into the shared folder and reads them back: ``(doc_id, start, n_tokens, ids_crc32)``.

    Null and empty texts are the end id alone; repeated ids follow each other in the order of
    their texts' length and hash; an empty table writes no shard and gives no row; other columns are ignored.
    """
    path = new_path(docs.sparkSession, "tokenbin")
    write(docs, tokenizer, vocab, path)
    return read(docs.sparkSession, path)
