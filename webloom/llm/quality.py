"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import arrow_map, aside, bytes_column, inline_table, small_batches

#: Word buckets, vector length, neighbours on each side, nonzeros of an index vector.
BUCKETS, DIM, REACH, SPARSE = 1 << 15, 48, 2, 4
#: Labelled rows and bytes of text that the fit takes at most, in the order of a hash of the id. Whole texts only.
FIT_ROWS, FIT_BYTES = 6000, 48 << 20
#: Words whose vectors are summed at a time, and ranges of buckets in which the tasks' sums meet.
CHUNK, PARTS = 50_000, 64
HIDDEN, EPOCHS, RATE, DECAY = 24, 250, 0.01, 1e-4
#: Different tokens of at most LONG bytes that a worker remembers; beyond that many it forgets them all (results stay the same).
MEMO, LONG = 400_000, 64

_SPACE = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))
_ALNUM = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
_TO_WORDS = bytes(b if _ALNUM[b] else 32 for b in range(256))
_TO_MARKS = bytes(32 if _ALNUM[b] else _SPACE[b] for b in range(256))
SHAPES = 8


def _shape(token: bytes) -> int:
    """0 lower, 1 title, 2 upper, 3 digits, 4 mixed, 5 one letter, 6 very long, 7 marks."""
    if not _ALNUM[token[0]]:
        return 7
    s = token.decode("utf-8", "replace")
    if s.isdigit():
        return 3
    if len(s) == 1:
        return 5
    if len(s) > 24:
        return 6
    return 0 if s.islower() else 2 if s.isupper() else 1 if s.istitle() else 4


class Codes(dict):
    """token -> bucket * SHAPES + shape, worked out once for each different token."""

    def __missing__(self, token: bytes) -> int:
        code = (zlib.crc32(token) % BUCKETS) * SHAPES + _shape(token)
        if len(token) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[token] = code
        return code


def codes_of(text: bytes | None, memo: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words in order, and of the runs of other marks in order."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words, marks = text.translate(_TO_WORDS).split(), text.translate(_TO_MARKS).split()
    get = memo.__getitem__
    return np.fromiter(map(get, words), np.int64, len(words)), np.fromiter(map(get, marks), np.int64, len(marks))


def index_vectors(seed: int = 7) -> np.ndarray:
    """A sparse vector of small whole numbers for each bucket, by the seed alone."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.int8)
    at = rng.integers(0, DIM, (BUCKETS, SPARSE))
    sign = rng.choice(np.array([-1, 1], np.int8), (BUCKETS, SPARSE))
    np.add.at(out, (np.arange(BUCKETS)[:, None], at), sign)
    return out


class Contexts:
    """Sums of the index vectors of each bucket's neighbours: whole numbers, the same in whatever order texts come."""

    def __init__(self) -> None:
        # The last row stands for the gap between texts: no bucket, no vector.
        self.index = np.vstack([index_vectors(), np.zeros((1, DIM), np.int8)])
        self.sums = np.zeros((BUCKETS + 1, DIM), np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, *runs: np.ndarray) -> None:
        """Takes the codes of a text, words and marks each as a run of their own."""
        for codes in runs:
            for at in range(0, len(codes), CHUNK):
                # Runs of CHUNK overlap by the reach on each side, which is taken as neighbours only.
                lo, hi = max(0, at - REACH), min(len(codes), at + CHUNK + REACH)
                part = (codes[lo:hi] // SHAPES).astype(np.uint16)
                self.held.append((part, at - lo, min(len(codes), at + CHUNK) - lo))
                self.size += hi - lo + REACH
                if self.size > CHUNK:
                    self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        gap = np.full(REACH, BUCKETS, np.uint16)
        b = np.concatenate([x for part, _, _ in self.held for x in (part, gap)])
        own = np.zeros(len(b), bool)
        at = 0
        for part, lo, hi in self.held:
            own[at + lo : at + hi] = True
            at += len(part) + REACH
        r = self.index[b]
        near = np.zeros_like(r)
        for o in range(1, REACH + 1):
            near[o:] += r[:-o]
            near[:-o] += r[o:]
        places = np.flatnonzero(own)
        order = places[np.argsort(b[places], kind="stable")]
        keys = b[order]
        start = np.flatnonzero(np.diff(keys.astype(np.int32), prepend=-1))
        self.sums[keys[start]] += np.add.reduceat(near[order], start, axis=0, dtype=np.int32)
        self.held, self.size = [], 0

    def done(self) -> np.ndarray:
        self.flush()
        return self.sums[:BUCKETS]


def context_sums(docs: DataFrame) -> np.ndarray:
    """:class:`Contexts` over all rows of ``docs(text)``: one pass; a task sends BUCKETS * DIM numbers at most, packed, in PARTS ranges of buckets that are summed apart."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, memo = Contexts(), Codes()
        for b in batches:
            for t in bytes_column(b, "text"):
                sums.add(*codes_of(t, memo))
        parts = np.split(sums.done(), PARTS)
        full = [i for i, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(parts[i].astype("<i8").tobytes(), 1) for i in full], pa.binary())], ["part", "data"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(data), "<i8")
                found[part] = found[part] + x if part in found else x
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["part", "data"])

    sent = arrow_map(docs.select("text"), run, "part int, data binary").repartition(PARTS, "part")
    out = np.zeros((PARTS, BUCKETS // PARTS * DIM), np.int64)
    for r in arrow_map(sent, total, "part int, data binary").collect():
        out[r["part"]] = np.frombuffer(r["data"], "<i8")
    return out.reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Each bucket's own index vector plus the sum of its neighbours', both scaled to length one."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-6)
    return (unit(sums.astype(np.float64)) + unit(index_vectors().astype(np.float64))).astype(np.float32)


FEATURES = 2 * DIM + SHAPES + 4


def pooled(words: np.ndarray, marks: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Fixed-size features of a document: mean word vector, mean mark vector, shares of shapes, repetition, length."""
    out = np.zeros(FEATURES, np.float32)
    n, m = len(words), len(marks)
    if n:
        b = words // SHAPES
        for at in range(0, n, 1 << 16):
            out[:DIM] += vectors[b[at : at + (1 << 16)]].sum(axis=0)
        out[:DIM] /= n
        out[2 * DIM : 2 * DIM + SHAPES] = np.bincount(words % SHAPES, minlength=SHAPES) / n
        out[-4] = np.count_nonzero(b[1:] == b[:-1]) / n
        out[-3] = len(np.unique(b)) / n
    if m:
        b = marks // SHAPES
        for at in range(0, m, 1 << 16):
            out[DIM : 2 * DIM] += vectors[b[at : at + (1 << 16)]].sum(axis=0)
        out[DIM : 2 * DIM] /= m
    out[-2] = m / (n + m) if n + m else 0
    out[-1] = np.log1p(n) / 10
    return out


@dataclass
class Network:
    """Everything a score needs; a few MB whatever the corpus."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, vectors: np.ndarray, seed: int = 11) -> Network:
    """Adam on four fifths of the rows; the temperature by golden section on the other fifth."""
    x = np.stack([pooled(*d, vectors) for d in docs]).astype(np.float64) if docs else np.zeros((0, FEATURES))
    y = y.astype(np.float64)
    rng = np.random.default_rng(seed)
    prior = (y.sum() + 1) / (len(y) + 2)
    b2 = float(np.log(prior / (1 - prior)))
    mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(FEATURES)
    net = Network(vectors, mean, scale, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), b2, 1.0)
    if len(np.unique(y)) < 2:
        return net
    net.w1, net.w2 = rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), rng.normal(0, HIDDEN**-0.5, HIDDEN)
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held[:] = False
    xs, ys = ((x - mean) / scale)[~held], y[~held]
    params = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, EPOCHS + 1):
        w1, b1, w2, b = params
        h = np.tanh(xs @ w1 + b1)
        g = (1 / (1 + np.exp(-np.clip(h @ w2 + b, -30, 30))) - ys) / len(ys)
        gh = np.outer(g, w2) * (1 - h * h)
        for i, d in enumerate((xs.T @ gh + DECAY * w1, gh.sum(axis=0), h.T @ g + DECAY * w2, g.sum())):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
    if held.any():
        z, yh = net.logit(x[held]), y[held]
        lo, hi, r = np.log(0.25), np.log(8.0), (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if _loss(z / np.exp(a), yh) < _loss(z / np.exp(b), yh) else (a, hi)
        net.temperature = float(np.exp((lo + hi) / 2))
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int) -> list[tuple[bytes | None, object]]:
    """At most ``rows`` labelled texts of at most ``size`` bytes in all, in the order of a hash of the id.

    ``labels(doc_id, <label>)``: of several labels of one id the least counts; null ids and labels
    are left out; of several texts of one id the shortest counts (ties by hash). Ids are chosen
    first, from the two id columns alone; their texts are then met by a broadcast of at most
    ``rows`` ids, so no text is shuffled. Sizes come before texts: a text that doesn't fit what is
    left of ``size`` is passed over for the next. If none fits, that is an error and no empty sample.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("__label"))
    order = F.xxhash64("doc_id", F.lit(1))
    known = docs.select("doc_id").distinct().join(one, "doc_id")
    label_of = {r["doc_id"]: r["__label"] for r in known.orderBy(order, "doc_id").limit(rows).collect()}
    ids = inline_table(docs.sparkSession, [(d,) for d in label_of], "doc_id bigint")
    mine = docs.select("doc_id", "text", F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("h")).alias("x"))
    sizes = mine.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy(order, "doc_id").select("doc_id", "x.size", "x.h").collect()
    picked, total = [], 0
    for r in sizes:
        if total + r["size"] <= size:
            total += r["size"]
            picked.append((r["doc_id"], r["h"]))
    if sizes and not picked:
        raise ValueError(f"none of {len(sizes)} labelled texts fits into {size} bytes")
    texts = mine.select("doc_id", "x.h", F.encode("text", "UTF-8").alias("text"))
    got = texts.join(F.broadcast(inline_table(docs.sparkSession, picked, "doc_id bigint, h bigint")), ["doc_id", "h"]).dropDuplicates(["doc_id"])
    return [(None if r["text"] is None else bytes(r["text"]), label_of[r["doc_id"]]) for r in got.orderBy(order, "doc_id").collect()]


def learnable(col: str = "doc_id"):
    """Rows that may teach: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(col).cast("string")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Network:
    """Word vectors from all texts; the network from a bounded sample of ``labels`` (ids of crc32 mod 3 = 1 are held out), the only part that isn't over all rows."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels.where(learnable()), label, rows, size)
    memo = Codes()
    return fit_network([codes_of(t, memo) for t, _ in sample], np.array([float(y > 0) for _, y in sample]), word_vectors(context_sums(docs)))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Adds ``score`` to every row: one pass, no shuffle; the network is broadcast (about 6 MB, whatever the corpus)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, Codes()
        for b in batches:
            if b.num_rows:
                x = np.stack([pooled(*codes_of(t, memo), model.vectors) for t in bytes_column(b, "text")])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x.astype(np.float64)))], names)

    return arrow_map(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each row of ``docs``.

    The score is a function of the text alone. Null and empty texts have zero features and get the
    network's score for them; without usable labels every score is one half; a null id is not held
    out; repeated rows score alike; other columns are ignored.
    """
    out = score(docs.select("doc_id", "text"), fit(docs, labels, label))
    return out.select(
        "doc_id",
        F.coalesce(~learnable(), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Rows whose score is at least one half, with the columns of ``docs``."""
    renamed, back = aside(docs, "score")
    return score(renamed, fit(docs, labels, label)).where(F.col("score") >= 0.5).select(back)
