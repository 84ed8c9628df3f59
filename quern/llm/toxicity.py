"""Operator 10: toxicity by cumulative-link ordinal regression.

Grades are ordered: 0 harmless, 1 toxic, 2 toxic and of low quality. One weight vector serves all
thresholds: P(grade > k) = sigmoid(w.x - threshold[k]), so a feature shifts a document along one scale of
severity. Features are the presence of words and of word beginnings. The result is the expected
severity, the sum of P(grade > k).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import steps, texts_of, written

#: Labelled documents, as expected, on which the model is fitted; the one bound here.
SAMPLE_DOCS = 6000
#: Features in the model, chosen by their association with the grades.
FEATURES = 2000
#: Labelled documents that a feature must occur in.
LEAST_DOCS = 4
#: Lengths of the word beginnings among the features.
BEGINNINGS = (4, 5, 6, 7)
GRADES = 3
WORD = re.compile(r"\w+")


def features_of(text: str) -> set[str]:
    """The features present in a whole text: its words in lower case, and their beginnings with a star."""
    words = {*WORD.findall(text.lower())}
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) >= n])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_cumulative_link(x: np.ndarray, grade: np.ndarray, grades: int = GRADES, l1: float = 2e-4, l2: float = 2e-5, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that maximise the penalised likelihood, by accelerated proximal gradient steps.

    P(grade = k) is the difference of neighbouring sigmoids. With one grade only, the weights are zero.
    """
    n, m = x.shape
    w = np.zeros(m)
    above = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(grades - 1))
    if n == 0 or m == 0:
        return w, theta
    row, column = np.nonzero(x)
    value = x[row, column].astype(np.float64)

    def scores(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * v[column], n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(column, value * r[row], m)

    u = np.ones(m) / np.sqrt(m)
    for _ in range(30):  # the largest eigenvalue of x'x / n bounds the curvature
        top = back(scores(u)) / n
        size = float(np.linalg.norm(top))
        u = top / max(size, 1e-12)
    step = 4.0 / (0.55 * size + 1.0)
    v, tau, t = w, theta, 1.0
    for _ in range(rounds):
        z = scores(v)
        cum = np.concatenate([np.zeros((n, 1)), _sigmoid(tau - z[:, None]), np.ones((n, 1))], axis=1)  # P(grade <= k - 1)
        slope = cum * (1 - cum)
        rows = np.arange(n)
        hi, lo = cum[rows, grade + 1], cum[rows, grade]
        p = np.maximum(hi - lo, 1e-9)
        up, low = slope[rows, grade + 1] / p, slope[rows, grade] / p
        g_w = back(up - low) / n + l2 * v
        g_t = np.array([(-(up * (grade == k)) + low * (grade == k + 1)).mean() for k in range(grades - 1)])
        new = v - step * g_w
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_t = np.maximum.accumulate(tau - min(step, 4.0) * g_t + 1e-6 * np.arange(grades - 1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, tau = new + (t - 1) / t2 * (new - w), np.maximum.accumulate(new_t + (t - 1) / t2 * (new_t - theta))
        w, theta, t = new, new_t, t2
    return w, theta


@dataclass
class ToxicityModel:
    """A fitted model; ``weights`` holds features with weights other than zero."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (0.0,) * (GRADES - 1)

    def exceed(self, text: str) -> np.ndarray:
        """P(grade > k) for each k."""
        z = sum(self.weights[f] for f in sorted(self.weights.keys() & features_of(text)))
        return _sigmoid(z - np.asarray(self.thresholds))


def grade_of(toxic, quality):
    """The grade that labels state: 0 unless toxic, then 1, or 2 if quality is 0."""
    return F.when(toxic == 0, 0).when(quality == 0, 2).otherwise(1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text") -> ToxicityModel:
    """A model fitted on about ``sample_docs`` labelled documents, drawn by a hash of the id from all labels.

    Rows of ``labels`` (doc_id, quality, toxic) without toxic or id are left out; the highest grade counts
    for an id with several; of the texts of an id that repeats in ``docs`` the one with the least hash counts. The
    drawn ids, at most a small multiple of ``sample_docs``, are broadcast to the scan of the texts, which are written
    once, one for each id; FEATURES counts and one short row for each drawn id reach the driver. No labels give a
    model without features, and neither do labels of one grade only.
    """
    graded = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(grade_of(F.col("toxic"), F.col("quality"))).alias("grade"))
    n = graded.count()
    if not n:
        return ToxicityModel()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / (1 << 30)
    drawn = graded.where(draw < min(1.0, sample_docs / n))
    found = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")
    sample = written(found.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text")).select("grade", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(GRADES)]
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(seen):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(c), pa.int32()), pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], names=["grade", "feature", "n"])
                    c.clear()

        for b in steps(batches):
            for k, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                f = features_of(t)
                seen[k].update(f)
                size += len(f)
            if size > 1_000_000:
                size = 0
                yield from told()
        yield from told()

    counts = sample.mapInArrow(count, "grade int, feature string, n long").groupBy("feature").agg(F.sum("n").alias("all"), *(F.sum(F.when(F.col("grade") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(GRADES))).where(F.col("all") >= LEAST_DOCS)
    sizes = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return ToxicityModel()
    # log-likelihood ratio of the counts by grade against equal shares
    gain = sum((F.when(F.col(f"n{k}") > 0, F.col(f"n{k}") * F.log(F.col(f"n{k}") * total / (F.col("all") * m))).otherwise(0.0) for k, m in sizes.items()), F.lit(0.0))
    chosen = [r["feature"] for r in counts.withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()]
    place = {f: i for i, f in enumerate(sorted(chosen))}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found = [sorted(place[f] for f in place.keys() & features_of(t)) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["grade", "at"])

    got = sample.mapInArrow(rows, "grade int, at array<int>").toArrow()
    grades = got.column("grade").to_numpy().astype(np.int64)
    x = np.zeros((len(grades), len(place)), np.float32)
    at = got.column("at").combine_chunks()
    lengths = pa.compute.list_value_length(at).to_numpy()
    x[np.repeat(np.arange(len(grades)), lengths), at.flatten().to_numpy()] = 1
    _, rank = np.unique(np.packbits(x > 0, axis=1), axis=0, return_inverse=True)
    order = np.lexsort((rank.ravel(), grades))  # the rows arrive in any order
    w, theta = fit_cumulative_link(x[order], grades[order])
    return ToxicityModel({f: round(float(w[i]), 6) for f, i in place.items() if abs(w[i]) > 1e-6}, tuple(round(float(x), 6) for x in theta))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with ``severity`` (expected grade, 0 to GRADES - 1), ``grade`` (the
    highest that is exceeded with probability one half or more) and ``toxic`` (grade above 0); these
    replace columns of the same names. Null texts count as empty; texts of any length are scored whole; rows that
    repeat are scored alike, and an empty table stays empty."""
    held = docs.drop("severity", "grade", "toxic")
    schema = T.StructType([*held.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.LongType())])
    picked = held.withColumn("__text", F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "__text"):
            got = [model.exceed(t) for t in texts_of(b, "__text")]
            severity = [float(p.sum()) for p in got]
            grade = [int((p >= 0.5).sum()) for p in got]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(severity, pa.float64()), pa.array(grade, pa.int64())], names=schema.names)

    return picked.mapInArrow(run, schema).withColumn("toxic", F.col("grade") > 0)
