"""Operator 4: SimHash fingerprints and near-duplicate classes by anchor-point covering.

The anchors are a covering code. The 64 bits of a fingerprint are two halves; each half is made of blocks of
23 bits (perfect Golay code, covering radius 3), blocks of 7 bits (perfect Hamming code, covering radius 1) and bits kept
as they are. Two fingerprints that differ in at most t bits differ in at most t // 2 bits in one of the halves.
There, the second one lies within t // 2 more than the covering radius of the first one's nearest anchor. So each distinct
fingerprint goes to its nearest anchor of either half as a resident, and to every anchor within covering radius plus
t // 2 as a visitor; residents are compared with the visitors of their anchor, and no link is missed.

What an anchor compares grows with the fingerprints of the corpus, so their number decides between three layouts, all of them
complete. At t = 4 a fingerprint visits about 54 of 2**18 anchors of a half, 100 of 2**21, or 529 of 2**32, where every
value of a half is an anchor of its own.

What an anchor finds leaves it as spanning links, at most one for each fingerprint, so a large
group of near copies makes a line of links for each member and not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import drop_written, released, steps, texts_of, written

#: Perfect codes as (length, generator polynomial, covering radius); fixed values.
GOLAY = (23, 0b101011100011, 3)
HAMMING = (7, 0b1011, 1)
#: Parts of a fingerprint, each (lowest bit, bits in a Golay code, bits in a Hamming code, bits kept as they are).
HAMMING_HALVES = ((0, 23, 7, 2), (32, 23, 7, 2))
HALVES = ((0, 23, 0, 9), (32, 23, 0, 9))
EXACT_HALVES = ((0, 0, 0, 32), (32, 0, 0, 32))
THIRDS = ((0, 21, 0, 0), (21, 21, 0, 0), (42, 22, 0, 0))
#: Layouts by the number of distinct fingerprints up to which each is used.
LAYOUTS = ((1 << 24, HAMMING_HALVES), (1 << 30, HALVES), (1 << 64, EXACT_HALVES))
#: Seed of the XXH64 values.
SEED = 42
#: Pairs compared in one vectorised step.
PAIRS = 2_000_000
#: Residents of an anchor beyond which they are dealt to several tasks.
RESIDENTS = 20_000
#: Rows that a task gathers before it compares the anchors among them.
HELD = 200_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 values (rows of 8 bytes, highest first) of a text's shingles, repeats included.

    A-Z become lower case; words are runs without space, tab, line feed, vertical tab, form feed and carriage
    return; shingles are ``words`` words joined by a space; a text with fewer words is one shingle, one without has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty((0, 8), np.uint8)
    flat = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: max(1, len(found) - words + 1)].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(flat[a:b], SEED) for a, b in zip(first, last, strict=True)]), np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the values; of none, zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        counts += np.unpackbits(hashes[at : at + 16384], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit SimHash of a whole text: a bit is 1 if it is set in over half of the values of its shingles,
    which count as often as they occur (see ``shingle_hashes``). A text without words gives zero."""
    return majority(shingle_hashes(text, words))


def simhash_fingerprints(docs: DataFrame, words: int = 4, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``fp`` (the fingerprint as a signed long).

    Null, empty and blank texts give zero. Nothing is shuffled; one document is in memory at a time.
    """
    picked = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*picked.drop("__text").schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "__text"):
            got = np.array([fingerprint(t, words) for t in texts_of(b, "__text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got.view(np.int64))], names=schema.names)

    return picked.mapInArrow(released(run), schema)


class Patterns:
    """For each syndrome of a perfect code, the error patterns that lead to a codeword, by excess.

    The excess of a pattern is its weight beyond the covering radius.
    """

    def __init__(self, code: tuple[int, int, int], excess: int):
        self.length, poly, radius = code
        self.check = poly.bit_length() - 1
        column = []
        for i in range(self.length):
            x = 1 << i
            while x.bit_length() > self.check:
                x ^= poly << (x.bit_length() - 1 - self.check)
            column.append(x)
        self.parts = []
        for low in range(0, self.length, 8):
            table = np.zeros(256, np.int64)
            for v in range(256):
                for j in range(8):
                    if v >> j & 1 and low + j < self.length:
                        table[v] ^= column[low + j]
            self.parts.append((low, table))
        found = [(sum(1 << i for i in c), max(0, w - radius)) for w in range(min(self.length, radius + excess) + 1) for c in combinations(range(self.length), w)]
        pattern, over = np.array(found, np.int64).T
        order = np.lexsort((pattern, over, self.syndrome(pattern)))
        self.pattern, self.over = pattern[order], over[order]
        self.begin = np.searchsorted(self.syndrome(self.pattern), np.arange((1 << self.check) + 1))

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.int64)
        for low, table in self.parts:
            out ^= table[x >> low & 255]
        return out


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and positions lo[i] .. lo[i] + n[i] - 1, row by row."""
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


@lru_cache(maxsize=4)
def _codes(budget: int) -> tuple[Patterns, Patterns]:
    return Patterns(GOLAY, budget), Patterns(HAMMING, budget)


def anchors_of(prints: np.ndarray, threshold: int, parts: tuple = HALVES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether it is the nearest one, for all anchors that each fingerprint goes to."""
    budget = threshold // len(parts)
    golay, hamming = _codes(budget)
    prints = prints.view(np.uint64)
    out = []
    for n, (low, g_bits, h_bits, f_bits) in enumerate(parts):
        bits = (prints >> np.uint64(low)).astype(np.uint64).view(np.int64)
        g, h, f = bits & (1 << g_bits) - 1, bits >> g_bits & (1 << h_bits) - 1, bits >> (g_bits + h_bits) & (1 << f_bits) - 1
        row, word, over = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64)
        for code, block, used in ((golay, g, g_bits), (hamming, h, h_bits)):
            if used:
                s = code.syndrome(block)[row]
                k, at = _expand(code.begin[s], code.begin[s + 1] - code.begin[s])
                over = over[k] + code.over[at]
                ok = over <= budget
                k, at, over = k[ok], at[ok], over[ok]
                row = row[k]
                word = word[k] << (code.length - code.check) | (block[row] ^ code.pattern[at]) >> code.check
        for weight in range(budget + 1):
            ok = over + weight <= budget
            near, rest, first = row[ok], (n << 60 | word[ok] << f_bits | f[row[ok]]), over[ok] + weight == 0
            for bits_ in combinations(range(f_bits), weight):
                out.append((near, rest ^ sum(1 << i for i in bits_), first))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same values as the links (u, v), at most one a value: each to the smallest of its component."""
    values, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def _compare(group: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links between residents and visitors of whole anchors (rows sorted by the number of their group)."""
    res = np.flatnonzero(home)
    lo, hi = (np.searchsorted(group, group[res], side) for side in ("left", "right"))
    n = hi - lo
    upto = np.cumsum(n)
    start = 0
    while start < len(res):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        k, other = _expand(lo[start:stop], n[start:stop])
        apart = np.bitwise_count(fp[res[start:stop]][k] ^ fp[other])
        hit = np.flatnonzero((apart <= threshold) & (apart > 0))
        if len(hit):
            yield spanning(fp[res[start:stop][k[hit]]].view(np.int64), fp[other[hit]].view(np.int64))
        start = stop


def simhash_links(prints: DataFrame, threshold: int = 4, parts: tuple | None = None) -> DataFrame:
    """Links (``u``, ``v``) between distinct fingerprints ``fp`` at ``threshold`` or fewer differing bits, enough
    of them to connect all that are linked. ``parts`` says where the anchors lie; by default LAYOUTS does."""
    distinct = prints.where("fp is not null").select("fp").distinct()
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts is None:
        found = distinct.count()
        parts = next(layout for upto, layout in LAYOUTS if found <= upto)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 2048):
                row, anchor, home = anchors_of(fp[at : at + 2048], threshold, parts)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[at + row]), pa.array(home)], names=["anchor", "fp", "home"])

    def residents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, anchor, _ = anchors_of(b.column(0).to_numpy(), 0, parts)
            yield pa.RecordBatch.from_arrays([pa.array(anchor)], names=["anchor"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            group, fp, home = rows
            for u, v in _compare(group, fp.view(np.uint64), home, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        def numbered(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            """Rows of one anchor and share follow each other; each such group gets a number."""
            anchor, share, fp, home = rows
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (share[1:] != share[:-1]))
            return np.cumsum(new), fp, home

        for b in batches:
            if not b.num_rows:
                continue
            held.append((*(b.column(k).to_numpy() for k in (0, 1, 2)), b.column(3).to_numpy(zero_copy_only=False)))
            size += b.num_rows
            if size >= HELD:
                rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                group, fp, home = numbered(rows)
                last = int(np.searchsorted(group, group[-1]))  # the last anchor may go on
                if last:
                    yield from flush((group[:last], fp[:last], home[:last]))
                    rows = tuple(x[last:] for x in rows)
                elif not home.all():  # residents come first: these have met their first visitors, and wait for more
                    yield from flush((group, fp, home))
                    rows = tuple(x[home] for x in rows)
                held, size = [rows], len(rows[0])
        if held:
            yield from flush(numbered(tuple(np.concatenate(x) for x in zip(*held, strict=True))))

    # so few and small rows would else be replicated by very few tasks
    sent = distinct.repartition(n).mapInArrow(released(replicate), "anchor long, fp long, home boolean")
    homes = distinct.mapInArrow(released(residents), "anchor long").groupBy("anchor").count().where(F.col("count") > RESIDENTS)
    crowded = written(homes.select("anchor", F.ceil(F.col("count") / RESIDENTS).cast("int").alias("shares")))
    if crowded.isEmpty():
        dealt = sent.select("anchor", F.lit(0).alias("share"), "fp", "home")
    else:  # residents and visitors of a crowded anchor are dealt to shares; every share of the ones meets every share of the others
        own, each = F.pmod(F.hash("fp"), F.col("shares")), F.sequence(F.lit(0), F.col("shares") - 1)
        all_of = sent.join(crowded, "anchor", "left").fillna(1, "shares")
        home = all_of.where("home").select("anchor", "fp", (own * F.col("shares")).alias("row"), F.explode(each).alias("k")).select("anchor", (F.col("row") + F.col("k")).alias("share"), "fp", F.lit(True).alias("home"))
        away = all_of.select("anchor", "fp", "shares", own.alias("own"), F.explode(each).alias("k")).select("anchor", (F.col("k") * F.col("shares") + F.col("own")).alias("share"), "fp", F.lit(False).alias("home"))
        dealt = home.unionByName(away)
    return dealt.repartition(n, "anchor", "share").sortWithinPartitions("anchor", "share", F.desc("home")).mapInArrow(released(compare), "u long, v long")


def simhash_classes(docs: DataFrame, words: int = 4, threshold: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp and component_id.

    Fingerprints at ``threshold`` or fewer differing bits are linked, and component_id is the smallest doc_id
    reachable over links, the document itself included. Copies share one fingerprint and meet only in an aggregation. Blank texts share fingerprint zero. Null ids get a row and count for no
    minimum; repeated rows are kept; other columns are not read. An empty table gives no row; texts of any length
    are read whole. Aggregates are written before they are joined, so that a very frequent fingerprint or a
    very large component can be split among tasks.
    """
    prints = written(simhash_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words))
    smallest = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = simhash_links(prints, threshold)
    roots = connected_components(links)
    joined = written(smallest.join(roots, smallest.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    drop_written(docs.sparkSession, smallest, roots)
    least = written(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = written(joined.join(least, "root").select("fp", "component_id"))
    drop_written(docs.sparkSession, joined, least)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
