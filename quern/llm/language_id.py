"""Operator 6: language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, word boundaries
included) in order of frequency. A document gets a profile of its own from its whole text, and the
language whose profile is nearest by out-of-place distance: the sum over the document's n-grams of
how many places they stand apart, PROFILE for those that the language's profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import released, steps, texts_of

#: N-grams in a profile.
PROFILE = 300
#: Labelled documents of each language, as expected, from which its profile is learned; see ``learn_profiles``.
SAMPLE_DOCS = 3000
#: Prediction for a text without a letter.
UNKNOWN = "und"
SPACE = 32


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as packed code points (21 bits each), and their counts.

    Ordered by length, then code points. Letters are lower-cased; every run of other characters is a
    word boundary, which n-grams hold at their ends only.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.full(len(points) + 2, SPACE, np.int64)
    x[1:-1] = np.where(_letters()[points], points, SPACE)
    gap = x == SPACE
    x = x[~(gap & np.append(False, gap[:-1]))]
    if len(x) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    present = np.flatnonzero(np.bincount(x))
    number = np.zeros(int(present[-1]) + 1, np.int64)
    number[present] = np.arange(len(present))  # the boundary comes first: it is less than any letter
    y, size = number[x], len(present)
    keys, counts = [], []
    inner = y[1:-1] > 0
    for n, codes in ((1, y[y > 0]), (2, y[:-1] * size + y[1:]), (3, ((y[:-2] * size + y[1:-1]) * size + y[2:])[inner])):
        if size**n <= 65536 + 4 * len(codes):
            found = np.bincount(codes, minlength=1)
            code = np.flatnonzero(found)
            count = found[code]
        else:
            code, count = np.unique(codes, return_counts=True)
        key = np.zeros(len(code), np.int64)
        for k in range(n):
            key |= present[code // size**k % size] << 21 * k
        keys.append(key)
        counts.append(count)
    return np.concatenate(keys), np.concatenate(counts)


def top_grams(keys: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent n-grams, most frequent first, ties in the order given."""
    if len(counts) > n:
        ok = counts >= np.partition(counts, len(counts) - n)[len(counts) - n]
        keys, counts = keys[ok], counts[ok]
    return keys[np.argsort(-counts, kind="stable")[:n]]


@dataclass
class Profiles:
    """The learned model: languages, and for each n-gram of any profile its place in each of them."""

    languages: list[str]
    keys: np.ndarray
    places: np.ndarray

    def predict(self, text: str) -> tuple[str, float]:
        """Language and score: 1 less the distance as a share of the largest possible. Ties go to the first language by name."""
        keys, counts = gram_counts(text)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        mine = top_grams(keys, counts)
        at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        known = self.keys[at] == mine
        rank = np.arange(len(mine))[:, None]
        apart = np.where(known[:, None] & (self.places[at] < PROFILE), np.abs(self.places[at] - rank), PROFILE)
        total = apart.sum(axis=0)
        best = int(total.argmin())
        return self.languages[best], float(1 - total[best] / (PROFILE * len(mine)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn_profiles(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Profiles:
    """Profiles of all languages in ``docs``, which holds the rows to learn from.

    A language with more than ``sample_docs`` labelled documents is sampled: a row is taken if a hash of
    its id falls below sample_docs / documents of that language, so about ``sample_docs`` are, from
    the whole table. This is the one bound here; the sampled texts count whole. N-grams are counted in
    the tasks and summed by key; a count and PROFILE rows a language reach the driver, so the languages have to be
    a bounded set, as they are as names of languages. Null languages and texts teach nothing.
    """
    labelled = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0), np.int64))
    share = F.create_map(*(x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 30)) / (1 << 30)
    sample = labelled.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            of: dict[str, list] = {}
            for k, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                of.setdefault(k, []).append(gram_counts(t))
            for k, parts in of.items():
                keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(keys), pa.string()), pa.array(keys), pa.array(total)], names=["lang", "gram", "n"])

    total = sample.mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = total.withColumn("place", place).where(F.col("place") <= PROFILE).collect()
    languages = sorted({r["lang"] for r in rows})
    keys = np.array(sorted({r["gram"] for r in rows}), np.int64)
    places = np.full((len(keys), len(languages)), PROFILE, np.int64)
    column = {k: i for i, k in enumerate(languages)}
    for r in rows:
        places[np.searchsorted(keys, r["gram"]), column[r["lang"]]] = r["place"] - 1
    return Profiles(languages, keys, places)


def identify_language(docs: DataFrame, profiles: Profiles, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows and columns of ``docs`` with the predicted language and its score, which replace columns of these names.

    Null texts and texts without a letter get UNKNOWN and score 0. Only the text is looked at.
    """
    held = docs.drop(*names)
    schema = T.StructType([*held.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    picked = held.withColumn("__text", F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "__text"):
            got = [profiles.predict(t) for t in texts_of(b, "__text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=schema.names)

    return picked.mapInArrow(released(run), schema)
