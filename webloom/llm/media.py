"""Media columns: texts' bytes as lossless WebP samples, read back from the stored bytes into pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import webp
from webloom.llm.common import arrow_map, bytes_column, small_batches

#: Samples of a row. Taller payloads are a sequence of files of TILE rows.
WIDTH, TILE = 192, 1024


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes, filled up with spaces to a positive multiple of WIDTH."""
    data = text or b""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b" ")


def store(payload: bytes) -> bytes:
    """The payload as the grey samples of one WebP file, or of several."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.encode_grey(rows[i : i + TILE]) for i in range(0, len(rows), TILE))


def pixels(media: bytes) -> np.ndarray:
    """Pixels (rows, WIDTH, 3) of the stored bytes; a grey sample stands in each channel."""
    parts = [webp.decode(f)[:, :, :3] for f in webp.files(media)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


@lru_cache(maxsize=1024)
def _bands(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and height of the eight bands of an image."""
    edge = [i * rows // 8 for i in range(8)]
    return np.minimum(edge, rows - 1), np.maximum(1, np.diff([*edge, rows]))[:, None]


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and an 8 x 8 average hash of the brightness."""
    n = rgb.shape[0] * rgb.shape[1]
    total = [int(np.add.reduce(rgb[:, :, c], axis=None, dtype=np.int64)) * 1000 // n for c in range(3)]
    grey = np.add(rgb[:, :, 0], rgb[:, :, 1], dtype=np.uint32)
    grey += rgb[:, :, 2]
    start, heights = _bands(len(grey))
    bands = np.add.reduceat(grey, start, axis=0)
    cells = np.add.reduce(bands.reshape(8, 8, -1), axis=2, dtype=np.int64) * 1000 // heights
    bits = (cells.ravel() * 64 > cells.sum()).astype(np.uint8)
    return f"{rgb.shape[1]}x{rgb.shape[0]};mean={total[0]},{total[1]},{total[2]};hash={np.packbits(bits).tobytes().hex()}"


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = bytes_column(b, "text")
            media = [store(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, width, height, samples)`` of a media column: the pixel arrays as bytes in reading order."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [pixels(m) for m in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([a.shape[1] for a in arrays], pa.int32()), pa.array([a.shape[0] for a in arrays], pa.int32()), pa.array([a.tobytes() for a in arrays], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "width", "height", "samples"])

    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, width int, height int, samples binary")


def digest(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` from the stored bytes.

    Null and empty texts are one row of spaces; equal texts give equal values; repeated rows come
    out as often as they came in; an empty table gives no row; other columns are ignored.
    """
    small_batches(media.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                rgb = pixels(m)
                p = rgb[:, :, 0].tobytes()
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(rgb)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names)

    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, schema)
