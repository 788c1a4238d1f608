"""Soft-membership mixing: domain posteriors from a labelled table, then nonnegative document rates that meet token targets."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import arrow_map, aside, bytes_column, materialize, small_batches, words_of
from webloom.llm.quality import labelled_sample

#: Bound of the labelled sample that the classifier is fitted on.
FIT_ROWS, FIT_BYTES = 6000, 48 << 20
#: Words that enter the classifier as present or not.
TERMS = 400
EPOCHS, RATE, DECAY = 300, 0.05, 1e-3
#: Posteriors are kept to this many steps, so that sums over documents are exact integers.
STEPS = 1000
#: Rounds of the projected gradient at most, and the residual (of the targets' length) and the gain of a round at which it ends.
ROUNDS, TOLERANCE, GAIN = 40, 1e-6, 1e-4


@dataclass
class Domains:
    """Multinomial logistic regression on the presence of chosen words."""

    names: list[str]
    terms: dict[bytes, int]
    weight: np.ndarray
    bias: np.ndarray

    def posterior(self, words: list[bytes]) -> np.ndarray:
        at = [i for i in map(self.terms.get, set(words)) if i is not None]
        z = self.bias + self.weight[at].sum(axis=0)
        z = np.exp(z - z.max())
        return z / z.sum()


def fit_domains(rows: list[tuple[bytes | None, str]], terms: int = TERMS) -> Domains:
    """Words by their chi-square against the domains (ties by the word's hash), then full-batch Adam. Domains in order of name.

    Words are counted by their hashes, 8 bytes each, so the driver holds a few times the sample's size at most.
    """
    names = sorted({y for _, y in rows}) or ["all"]
    y = np.array([names.index(d) for _, d in rows], np.int64)
    sets = [np.array([xxhash.xxh64_intdigest(w) for w in set(words_of(t))], np.uint64) for t, _ in rows]
    total = np.bincount(y, minlength=len(names)).astype(float)
    held, at = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
    counts = np.bincount(at * len(names) + np.repeat(y, [len(s) for s in sets]), minlength=len(held) * len(names)).reshape(-1, len(names)).astype(float)
    del at
    n, share = counts.sum(axis=1, keepdims=True), total / max(total.sum(), 1)
    chi = np.where(n[:, 0] >= 3, ((counts - n * share) ** 2 / np.maximum(n * share, 1e-9)).sum(axis=1), -1.0) if len(names) > 1 else np.full(len(held), -1.0)
    best = np.lexsort((held, -chi))[:terms]
    best = np.sort(held[best[chi[best] >= 0]])
    wanted = set(best.tolist())
    word_of = {h: w for t, _ in rows for w in set(words_of(t)) if (h := xxhash.xxh64_intdigest(w)) in wanted} if wanted else {}
    chosen = {word_of[int(h)]: i for i, h in enumerate(best)}
    x = np.zeros((len(rows), len(chosen)))
    for r, s in enumerate(sets):
        found = np.searchsorted(best, s)
        found[found == len(best)] = 0
        x[r, found[best[found] == s] if len(best) else []] = 1
    del sets, held, counts
    weight, bias = np.zeros((len(chosen), len(names))), np.log((total + 1) / (total.sum() + len(names))) if len(rows) else np.zeros(1)
    if len(names) > 1 and len(chosen):
        hot = np.eye(len(names))[y]
        m, v = [0.0, 0.0], [0.0, 0.0]
        for t in range(1, EPOCHS + 1):
            z = x @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - hot) / len(rows)
            steps = []
            for i, d in enumerate((x.T @ g + DECAY * weight, g.sum(axis=0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                steps.append(RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8))
            weight, bias = weight - steps[0], bias - steps[1]
    return Domains(names, chosen, weight, bias)


def _quantised(p: np.ndarray) -> np.ndarray:
    """Whole steps that sum to STEPS; the largest remainders get what is left, the first of equals first."""
    q = np.floor(p * STEPS).astype(np.int64)
    rest = p * STEPS - q
    q[np.argsort(-rest, kind="stable")[: STEPS - int(q.sum())]] += 1
    return q


def memberships(docs: DataFrame, model: Domains, keep_text: bool = False) -> DataFrame:
    """Adds ``__tokens`` (words) and ``__p`` (posteriors in STEPS, array by domain): one pass, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            sizes, ps = [], []
            for t in bytes_column(b, "text"):
                words = words_of(t)
                sizes.append(len(words))
                ps.append(_quantised(m.posterior(words)).tolist())
            keep = [i for i, n in enumerate(b.schema.names) if keep_text or n != "text"]
            cols = [b.column(i) for i in keep] + [pa.array(sizes, pa.int64()), pa.array(ps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [b.schema.names[i] for i in keep] + ["__tokens", "__p"])

    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = T.StructType([*fields, T.StructField("__tokens", T.LongType()), T.StructField("__p", T.ArrayType(T.LongType()))])
    return arrow_map(docs, run, schema)


def _rate(steps: list[np.ndarray], floor: float) -> Column:
    """The rate after all steps: from 1, add p . step and clip below at ``floor``, in order."""
    r = F.lit(1.0)
    for d in steps:
        move = sum(((F.col("__p")[k] / F.lit(float(STEPS))) * F.lit(float(x)) for k, x in enumerate(d)), F.lit(0.0))
        r = F.greatest(F.lit(float(floor)), r + move)
    return r


def fit_rates(table: DataFrame, domains: list[str], targets: dict[str, float], floor: float = 0.0, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Scaled projected gradient on ``min |sum_d r_d n_d p_d - T|^2, r >= floor`` from r = 1.

    Documents with the same posterior have the same rate, so the table is summed to one row for
    each posterior met (at most the grid of STEPS, whatever the corpus) and a round is one sum over
    it: domain totals and, over the rows that the clip leaves free, the second moments that scale
    the step. The driver sees K + K*K numbers a round. Where the scaled step lessens the residual by
    less than a tenth, the plain gradient step (one over the greatest curvature) is taken, which
    always descends, and twice as long after each success; so targets that cannot be met end at the
    least squares. Rounds end when the residual is small or three rounds gain little; the limit of
    rounds, if it comes first, gives a warning.
    """
    k = len(domains)
    goal = np.array([float(targets.get(d, 0.0)) for d in domains])
    cells = materialize(table.groupBy("__p").agg(F.sum("__tokens").alias("__n")), "mixing-cells")
    p = [F.col("__p")[i] / F.lit(float(STEPS)) for i in range(k)]

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        r = cells.withColumn("__r", _rate(steps, floor))
        free = F.when(F.col("__r") > floor, F.col("__n")).otherwise(F.lit(0))
        sums = [F.sum(F.col("__r") * F.col("__n") * x) for x in p]
        moments = [F.sum(free * p[i] * p[j]) for i in range(k) for j in range(k)]
        got = [float(x or 0.0) for x in r.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums + moments)]).first()]
        return np.array(got[:k]), np.array(got[k:]).reshape(k, k)

    steps: list[np.ndarray] = []
    now, moment = totals(steps)
    plain, longer, still = 1 / max(float(np.linalg.eigvalsh(moment)[-1]), 1e-12), 1.0, 0
    for _ in range(rounds):
        left = goal - now
        size = np.linalg.norm(left)
        if size <= TOLERANCE * max(1.0, np.linalg.norm(goal)) or still == 3:
            break
        ridge = np.eye(k) * max(1e-9 * np.trace(moment), 1e-12)
        step = np.linalg.lstsq(moment + ridge, left, rcond=None)[0]
        then, moved = totals([*steps, step]) if longer == 1 else (now, moment)
        if np.linalg.norm(goal - then) > 0.9 * size:
            step = left * plain * longer
            then, moved = totals([*steps, step])
            if np.linalg.norm(goal - then) >= size:
                if longer == 1:
                    break
                longer = max(1.0, longer / 8)
                continue
            longer *= 2
        still = still + 1 if np.linalg.norm(goal - then) > size * (1 - GAIN) else 0
        steps.append(step)
        now, moment = then, moved
    else:
        warnings.warn(f"rates after {rounds} rounds are {np.linalg.norm(goal - now):.3g} words off their targets and still moving", stacklevel=2)
    return steps


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` of a labels table: toxic, else good or poor by quality."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").when(F.col("quality") <= 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def fit_mixture(docs: DataFrame, labelled: DataFrame) -> Domains:
    """Classifier on a bounded sample of ``labelled(doc_id, domain)``."""
    return fit_domains(labelled_sample(docs.select("doc_id", "text"), labelled, "domain", FIT_ROWS, FIT_BYTES))


def mixture(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0, floor: float = 0.0) -> DataFrame:
    """``(doc_id, n_tokens, p_<domain>..., rate, copies)``, one row for each row of ``docs``.

    Targets: ``budget`` times the corpus's words, shared out by ``weights`` (domains left out get
    none; domains nobody labels are ignored and the rest scaled up). ``copies`` is the rate rounded
    up or down by a hash of the id, so that its mean is the rate. Null and empty texts have no
    words and the prior's posterior; without labels there is one domain ``all`` with rate
    ``budget``; repeated rows are treated alike; other columns are ignored.
    """
    model = fit_mixture(docs, labelled)
    table = materialize(memberships(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model), "mixing")
    steps = _fit(table, model, weights, budget, floor)
    out = table.withColumn("rate", _rate(steps, floor))
    return out.select(
        "doc_id",
        F.col("__tokens").alias("n_tokens"),
        *[(F.col("__p")[i] / F.lit(float(STEPS))).alias(f"p_{d}") for i, d in enumerate(model.names)],
        "rate",
        _copies(F.col("rate")).alias("copies"),
    )


def _fit(table: DataFrame, model: Domains, weights: dict[str, float], budget: float, floor: float) -> list[np.ndarray]:
    """Steps that take ``table(__tokens, __p)`` to ``budget`` times its words, shared out by ``weights``."""
    total = float(table.agg(F.sum("__tokens")).first()[0] or 0)
    known = {d: weights.get(d, 0.0) for d in model.names}
    scale = sum(known.values())
    targets = {d: budget * total * (w / scale if scale else 1 / len(known)) for d, w in known.items()}
    return fit_rates(table, model.names, targets, floor)


def _copies(rate: Column) -> Column:
    """The rate rounded up or down by a hash of the id."""
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + spread).cast("int")


def resample(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float, floor: float) -> DataFrame:
    """``docs`` with each row repeated ``copies`` times: the mixture put into effect, with the columns of ``docs``.

    Posteriors are worked out twice, once for the fit and once beside the texts, so that no text is
    shuffled to meet its rate. Rows without an id take part like any other; null and empty texts
    have the prior's posterior; repeated rows are copied alike; without labels there is one domain
    with rate ``budget``; an empty table stays empty; other columns pass, whatever their names.
    """
    model = fit_mixture(docs, labelled)
    table = materialize(memberships(docs.select("text"), model), "mixing")
    steps = _fit(table, model, weights, budget, floor)
    renamed, back = aside(docs, "__tokens", "__p", "__copies", "__copy")
    out = memberships(renamed, model, keep_text=True).withColumn("__copies", _copies(_rate(steps, floor))).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(back)
