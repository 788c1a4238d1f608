"""Importance resampling towards a target: hashed n-gram features whose CRCs are composed, never their strings."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import WORD_TABLE, arrow_map, bytes_column, materialize, small_batches

#: Runs of 1 to NGRAM words are features; their buckets; fewest words of a document that can be drawn; percent drawn; seed of the draw.
NGRAM, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: The reversed polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320


def _shift_tables(powers: int = 40) -> np.ndarray:
    """For 2**k zero bytes, k < ``powers``: what a CRC becomes by them, as four tables by the CRC's bytes.

    Appending zeros is linear over GF(2), so a 32 x 32 bit matrix; its columns are kept as tables for a byte each.
    """
    column = np.zeros(32, np.uint32)  # one zero bit
    column[0] = POLYNOMIAL
    column[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)

    def apply(columns: np.ndarray, v: np.ndarray) -> np.ndarray:
        bits = (v[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        return np.bitwise_xor.reduce(np.where(bits == 1, columns, np.uint32(0)), axis=1)

    for _ in range(3):
        column = apply(column, column)  # 2, 4, 8 bits
    out = np.zeros((powers, 4, 256), np.uint32)
    for k in range(powers):
        for byte in range(4):
            out[k, byte] = apply(column, np.arange(256, dtype=np.uint32) << np.uint32(8 * byte))
        column = apply(column, column)
    return out


SHIFT = _shift_tables()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC's part in the CRC of a text that goes on for ``length`` more bytes."""
    out = crc.copy()
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        at = np.flatnonzero((length >> k) & 1)
        v, t = out[at], SHIFT[k]
        out[at] = t[0][v & 255] ^ t[1][(v >> np.uint32(8)) & 255] ^ t[2][(v >> np.uint32(16)) & 255] ^ t[3][v >> np.uint32(24)]
    return out


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of two texts one after the other, of their CRCs and the second one's length."""
    return shifted(left, length) ^ right


#: CRC of a blank, the joint between words.
BLANK = zlib.crc32(b" ")


def gram_crcs(crc: np.ndarray, length: np.ndarray, ngram: int) -> Iterator[np.ndarray]:
    """For n = 1 to ``ngram`` the CRC of each run of n words, joined by a blank, from the words' CRCs and lengths."""
    yield crc
    if ngram > 1:
        tail = joined(np.full(len(crc), BLANK, np.uint32), crc, length)  # a blank and the word
        run = crc
        for n in range(2, ngram + 1):
            if len(crc) < n:
                return
            run = joined(run[:-1], tail[n - 1 :], length[n - 1 :] + 1)
            yield run


def word_pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece; a piece ends where a word ends."""
    text, at = text.translate(WORD_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(text: bytes | None, ngram: int, buckets: int, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """``(words, buckets of the runs that end in them)`` of a text, piece by piece; null and empty texts have none."""
    crc, length = np.empty(0, np.uint32), np.empty(0, np.int64)
    for words in word_pieces(text or b"", size):
        held = len(crc)
        crc = np.concatenate([crc, np.fromiter(map(zlib.crc32, words), np.uint32, len(words))])
        length = np.concatenate([length, np.fromiter(map(len, words), np.int64, len(words))])
        # Runs of n words that lie in the words held over were there in the piece before.
        found = [g[max(held - n + 1, 0) :] for n, g in enumerate(gram_crcs(crc, length, ngram), 1)]
        yield len(words), np.concatenate(found) % np.uint32(buckets)
        keep = len(crc) - (ngram - 1)
        crc, length = crc[max(keep, 0) :], length[max(keep, 0) :]


def counts(texts: DataFrame, ngram: int, buckets: int) -> DataFrame:
    """``(bucket, n)`` over all rows of ``texts(text)``: a task hands on at most a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for text in bytes_column(b, "text"):
                for _, found in features(text, ngram, buckets):
                    n += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    small_batches(texts.sparkSession)
    return arrow_map(texts, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """What a feature of each bucket adds to a weight: floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all))) for b in range(buckets)], np.int64)


def draw_part(doc_id: int | None, seed: int) -> int:
    """The Gumbel part of a score, by the id alone; a null id is the empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, ngram: int, seed: int) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), bytes_column(b, "text"), strict=True):
                words = total = weight = 0
                for n, found in features(text, ngram, len(gain)):
                    words, total, weight = words + n, total + len(found), weight + int(gain[found].sum())
                rows.append((doc_id, words, total, weight, weight + draw_part(doc_id, seed)))
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

    small_batches(docs.sparkSession)
    return arrow_map(docs, run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", ngram: int = NGRAM,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of each row of ``docs``; ``rank`` is null where it isn't drawn.

    A document's weight says how much likelier its features are under ``target`` than under ``docs``;
    with Gumbel noise fixed by the id the best scores are a draw without replacement by weight. Of the N
    rows with at least ``least_words`` words the best floor(percent * N / 100) are drawn, ties to the
    smaller id (null last). Null and empty texts have no features and weight 0. Repeated rows are rows of
    their own and tie; which of two equal rows comes first doesn't show. An empty target has no counts; an empty
    table gives no row; other columns are ignored. The feature counts are whole numbers summed by Spark; the
    driver holds a number a bucket. Ranks come from ranges of scores and their sizes, so no task sorts all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = lambda df: {r["bucket"]: r["n"] for r in counts(df, ngram, buckets).collect()}
    gain = gains(table(rows.select("text")), table(target.select(F.col(target_text).alias("text"))), buckets)
    out = materialize(weighted(rows, gain, ngram, seed), "resample-weights")
    fits = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    # The last key only deals equal rows out over ranges.
    ranged = out.where(fits).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "resample-ranges")
    before, at = [], 0
    for r in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r["part"], at))
        at += r["n"]
    drawn = percent * at // 100
    placed = ranged.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    placed = placed.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    cols = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return placed.select(cols).unionByName(out.where(~fits).withColumn("rank", F.lit(None).cast("long")).select(cols))


def oracle_sql() -> str:
    """The same in DuckDB's SQL: CRC-32 of every distinct word by its table, everything else by grouping and windows. Features are single words there."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    step = f"xor(c >> 1, {POLYNOMIAL} * (c & 1))"
    return f"""WITH RECURSIVE bits AS (SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) t(b) UNION ALL SELECT b, k + 1, {step} FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS rn, doc_id, {words} AS w FROM documents),
dw AS (SELECT rn, unnest(w) AS word FROM d),
bw AS (SELECT unnest({words}) AS word FROM benchmark),
v AS (SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i::BIGINT + 1, 2))::BIGINT) AS bytes FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
h AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN h USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN h USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
f AS (SELECT rn, sum(gain)::BIGINT AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT rn, doc_id, len(w)::BIGINT AS n, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS u FROM d LEFT JOIN f USING (rn)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rn) AS rank FROM y WHERE n >= {LEAST_WORDS})
SELECT doc_id, n AS n_words, n AS n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (rn)"""
