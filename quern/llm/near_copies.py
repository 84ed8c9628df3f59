"""Near copies by SimHash prints and the exact similarity of their shingles, for the pipeline's near-dedup stage.

Two texts are near copies if the sets of their shingles have a Jaccard similarity of ``least`` or more; classes
are the components of that relation. Candidates come from two sides. SimHash prints that differ in at most
PRINT_BITS bits are linked by anchor-point covering (``simhash_links``). At 0.8, prints of 64 bits differ in about
10 bits, with a spread of 3: a threshold that catches those pairs also catches unrelated ones by chance in any large
corpus. So the pairs that lie further apart come from minima of the same hash values (MinHash): BANDS bands of ROWS minima
each, and texts that agree in a whole band are linked to the smallest one of that band. Two texts of similarity s share
no band with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8.

The components of all these links only say where to look; inside each, the similarities decide. One text after another is
a pivot, compared with all that are open. The Jaccard distance is a metric, so two texts whose distances from a pivot
differ by more than the bound are no near copies. A text is closed once all others that it could be linked to are
linked to the same pivot; a tight group needs few pivots. Components of up to HELD_SHINGLES shingles are done in one task.
Larger ones are dealt to many: each round, every share of a component meets the same few pivots, and what stays open goes
on, until it fits into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import drop_written, released, steps, texts_of, written
from .simhash import SEED, majority, shingle_hashes, simhash_links

BANDS, ROWS = 32, 5
#: Bits in which SimHash prints of candidates differ at most.
PRINT_BITS = 4
#: Shingles of a component up to which one task handles it whole; larger ones are dealt to shares of that size.
HELD_SHINGLES = 2_000_000
#: Pivots of a component that a round compares its texts with, at most.
PIVOTS = 64
#: Steps from 0 to 1 in which the distances of a component's other texts from its pivot are told.
DISTANCES = 100
#: Seed of the numbers that deal the hash values anew for each minimum.
DEAL_SEED = 2024
MIXED, FACTOR = np.random.default_rng(DEAL_SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64) | np.array([[[0]], [[1]]], np.uint64)
#: Hash values handled in one vectorised step.
STEP = 4096


def words_of(text: str | None) -> bytes:
    """A-Z as lower case, words (runs without ASCII white space) joined by a space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 values of the shingles of ``words`` words; fewer words are one shingle, none give none."""
    return np.unique(shingle_hashes(text, words).view(">u8").astype(np.uint64).ravel())


def bands(values: np.ndarray) -> list[int]:
    """One signed number for each band of minima; a text without words has none."""
    if not len(values):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(values), STEP):
        least = np.minimum(least, ((values[None, at : at + STEP] ^ MIXED) * FACTOR).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(rows)]


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def classes(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the number of the first set of its class: the components of the pairs of similarity ``least`` or more."""
    n = len(sets)
    label, size = np.arange(n), np.array([len(s) for s in sets], np.int64)
    open_, pivot = np.ones(n, bool), np.zeros(n, bool)
    reach = 1 - least
    here = np.arange(n)
    flat, owner = np.concatenate(sets), np.repeat(here, size)
    while open_.any():
        left = np.flatnonzero(open_)
        if 2 * len(left) < len(here):  # closed ones need no comparison any more
            keep = open_[owner]
            here, flat, owner = left, flat[keep], owner[keep]
        members = np.bincount(label, minlength=n)[label[left]]
        a = left[np.argmin(members)]
        mine = sets[a]
        at = np.searchsorted(mine, flat)
        same = mine[np.minimum(at, len(mine) - 1)] == flat
        common = np.bincount(owner[same], minlength=n)[here]
        likeness = common / (size[here] + size[a] - common)
        linked = np.unique(label[here[likeness >= least]])
        label[np.isin(label, linked)] = linked.min()
        pivot[a], open_[a] = True, False
        apart = np.full(n, np.nan)
        apart[here] = 1 - likeness
        # texts of the pivot's class that lie far enough from all open texts of other classes
        own = np.flatnonzero(open_ & (label == label[a]))
        others = np.sort(apart[open_ & (label != label[a])])
        if len(own):
            lo = np.searchsorted(others, apart[own] - reach - 1e-9)
            hi = np.searchsorted(others, apart[own] + reach + 1e-9, "right")
            open_[own[lo == hi]] = False
    return label


def _links(signed: DataFrame) -> DataFrame:
    """Candidate links (u, v) between texts ``k``: prints within PRINT_BITS bits, and equal bands."""
    distinct = written(signed.dropDuplicates(["k"]).select("k", "fp", "bands"))
    heads = written(distinct.groupBy("fp").agg(F.min("k").alias("head")))
    same = distinct.join(heads, "fp").where("k <> head").select(F.col("k").alias("u"), F.col("head").alias("v"))
    near = simhash_links(heads.select("fp"), PRINT_BITS)
    u, v = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}")) for c in "uv")
    printed = near.join(u, "u").join(v, "v").select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    each = distinct.select("k", F.explode("bands").alias("band"))
    firsts = written(each.groupBy("band").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least < most").select("band", "least"))
    banded = each.join(firsts, "band").where("k <> least").select(F.col("k").alias("u"), F.col("least").alias("v"))
    return same.unionAll(printed).unionAll(banded)


def _in_tasks(texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links (node, class) inside components (root, k, text) that each fit into one task."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets = None, [], []

        def done() -> pa.RecordBatch:
            found = classes(sets, least).tolist()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([keys[x] for x in found], pa.int64())], names=["node", "class"])

        for b in batches:
            for root, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b), strict=True):
                if root != now and keys:
                    yield done()
                    keys, sets = [], []
                now = root
                if not keys or keys[-1] != k:
                    keys.append(k)
                    sets.append(shingles(t, words))
        if keys:
            yield done()

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.select("root", "k", "text").repartition(n, "root").sortWithinPartitions("root", "k").mapInArrow(released(confirm), "node long, class long")


def _round(now: DataFrame, large: DataFrame, words: int, least: float) -> DataFrame:
    """(root, k, size, text, chosen, pivots, aparts): the texts of large components, whether they are pivots themselves, and their
    distances from the other pivots of the component.

    ``large`` has root, shares, draw (how many texts a pivot is drawn from) and first (a text that is a pivot in any case). The
    pivots go to every share of their component, the texts to one.
    """
    n = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = (F.col("k") == F.col("first")) | (F.pmod(F.xxhash64("k", "first"), F.col("draw")) == 0)
    placed = now.join(large, "root").withColumn("chosen", chosen)
    columns = ("root", "share", "o", "k", "size", "text", "chosen")
    pivots = placed.where("chosen").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("o", F.lit(0))
    texts = placed.withColumn("share", F.pmod(F.hash("k"), F.col("shares"))).withColumn("o", F.lit(1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        place, last = None, None
        for b in steps(batches):
            root, share, o, k = (b.column(b.schema.get_field_index(c)).to_pylist() for c in columns[:4])
            rows, keys, aparts = [], [], []
            for i, t in enumerate(texts_of(b)):
                if place != (root[i], share[i]):
                    place, last, held = (root[i], share[i]), None, {}
                if o[i] == 0:
                    held[k[i]] = shingles(t, words)
                elif k[i] != last:  # rows that repeat id and text
                    last, mine = k[i], shingles(t, words)
                    found = {p: 1 - similarity(theirs, mine) for p, theirs in held.items() if p != last}
                    rows.append(i)
                    keys.append(list(found))
                    aparts.append(list(found.values()))
            if rows:
                kept = b.select(["root", "k", "size", "text", "chosen"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(keys, pa.list_(pa.int64())), pa.array(aparts, pa.list_(pa.float64()))], names=["root", "k", "size", "text", "chosen", "pivots", "aparts"])

    dealt = pivots.select(*columns).unionByName(texts.select(*columns)).repartition(n, "root", "share").sortWithinPartitions("root", "share", "o", "k")
    return dealt.mapInArrow(released(measure), "root long, k long, size long, text string, chosen boolean, pivots array<long>, aparts array<double>")


def _states(texts: DataFrame) -> DataFrame:
    """(root, total, n, first): shingles and texts of each component, and its least text."""
    return written(texts.groupBy("root").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.min("k").alias("first")))


def confirmed(sizes: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links (node, class) that join exactly the texts of a component that near-copy pairs join. ``sizes`` has root, k and size
    (distinct shingles), ``texts`` root, k, size and text.

    A round closes a component's pivots, and the texts linked to one of them unless some other text lies where it could be
    near to them. The first round has one pivot, as one is enough for a tight group; each further round has four times as many, up to
    PIVOTS. Components that fit into one task leave the rounds.
    """
    parts: list[DataFrame] = []
    now, state, ended, pivots = texts, _states(sizes), F.col("total") <= HELD_SHINGLES, 1
    reach = 1 - least + 1e-9
    while not (over := state.where(~ended)).isEmpty():
        parts.append(written(_in_tasks(now.join(state.where(ended).select("root"), "root", "left_semi"), words, least)))
        # so many pivots that their shingles fit into a task as well
        some = F.greatest(F.lit(1), F.least(F.lit(pivots), F.floor(F.col("n") * HELD_SHINGLES / F.col("total"))))
        large = over.select("root", "first", F.ceil(F.col("n") / some).alias("draw"), F.ceil(F.col("total") / HELD_SHINGLES).cast("int").alias("shares"))
        measured = written(_round(now, large, words, least))
        each = F.arrays_zip("pivots", "aparts")
        near = measured.select("k", F.explode(F.filter(each, lambda x: x["aparts"] <= reach)).alias("x"))
        parts.append(near.select(F.col("k").alias("node"), F.col("x.pivots").alias("class")))
        far = measured.where("not chosen").select("root", F.explode(F.filter(each, lambda x: x["aparts"] > reach)).alias("x"))
        bins = far.groupBy("root", F.col("x.pivots").alias("pivot")).agg(F.collect_set(F.floor(F.col("x.aparts") * DISTANCES)).alias("bins"))
        told = written(bins.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("pivot", "bins"))).alias("told")))

        def alone(x: Column) -> Column:
            """No open text that is not linked to the pivot lies within reach of this distance from it."""
            beside = lambda y: (y <= (x["aparts"] + reach) * DISTANCES) & (y + 1 >= (x["aparts"] - reach) * DISTANCES)
            return (x["aparts"] <= reach) & ~F.coalesce(F.exists(F.try_element_at("told", x["pivots"]), beside), F.lit(False))

        open_ = measured.join(told, "root", "left").where(~F.col("chosen") & ~F.exists(each, alone))
        now = open_.select("root", "k", "size", "text")
        state = _states(now)
        pivots = min(4 * pivots, PIVOTS)
    links = _in_tasks(now, words, least)
    if not parts:
        return links
    for p in parts:
        links = links.unionByName(p)
    joined = connected_components(links.select(F.col("node").alias("u"), F.col("class").alias("v")))
    return joined.select("node", F.col("root").alias("class"))


def near_classes(docs: DataFrame, words: int = 5, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs`` with an id: doc_id, h (a hash of the text that tells rows with one id apart), and
    class, a number that near copies share.

    Texts without words are one class, equal texts count once, an empty table gives no row, and columns other than id and
    text are not read. No task holds more than about twice HELD_SHINGLES shingles and two texts of any length.
    """
    picked = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            keys, sizes, prints, all_bands = [], [], [], []
            for t in texts_of(b):
                hashes = shingle_hashes(t, words)
                values = np.unique(hashes.view(">u8").astype(np.uint64).ravel())
                keys.append(_signed(xxhash.xxh64_intdigest(words_of(t), SEED)))
                sizes.append(len(values))
                prints.append(_signed(majority(hashes)))
                all_bands.append(bands(values))
            made = [pa.array(x, pa.int64()) for x in (keys, sizes, prints)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, pa.array(all_bands, pa.list_(pa.int64()))], names=["doc_id", "h", "k", "size", "fp", "bands"])

    signed = written(picked.mapInArrow(released(sign), f"doc_id {kind}, h long, k long, size long, fp long, bands array<long>"))
    roots = written(connected_components(_links(signed)))
    one = written(signed.groupBy("k").agg(F.min(F.struct("doc_id", "h", "size")).alias("s")).join(roots, F.col("k") == F.col("node")).select("k", "root", F.col("s.size").alias("size"), F.col("s.doc_id").alias("d"), F.col("s.h").alias("t")))
    texts = picked.join(one, (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("t"))).select("root", "k", "size", "text")
    sure = written(confirmed(one, texts, words, least))
    drop_written(docs.sparkSession, roots, one)
    return signed.select("doc_id", "h", "k").join(sure, F.col("k") == F.col("node"), "left").select("doc_id", "h", F.coalesce("class", "k").alias("class"))
