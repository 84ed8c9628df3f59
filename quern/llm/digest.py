"""Operator 3: canonical exact digests of documents.

The canonical form of a text is its NFKC normal form with case folded and white space runs folded to
one space. Its 128-bit xxhash is the fingerprint. Documents are grouped by fingerprint; inside a
bucket with several rows their canonical bytes are compared, so a hash collision never makes two
different texts one class.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_written, steps, texts_of, written


#: Ids of copies up to which they are broadcast to the scan of the texts; beyond, that join is a shuffled one.
BROADCAST_IDS = 1_000_000


def canonical(text: str | None) -> str:
    """NFKC, case folded, normalised again, white space runs as one space, none at the ends; null as empty."""
    text = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(unicodedata.normalize("NFKC", text).split())


def fingerprint_of(canonical_text: str) -> str:
    """32 hexadecimal digits: XXH3-128 of the UTF-8 bytes."""
    return xxhash.xxh3_128_hexdigest(canonical_text.encode("utf-8", "surrogatepass"))


def tie_of(text: Column) -> Column:
    """A hash of the text as it is, which tells rows with one id apart."""
    return F.xxhash64(text)


def exact_digests(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``fingerprint`` and ``canonical`` for each row of ``docs``; nothing is shuffled."""
    picked = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*picked.drop("__text").schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("canonical", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "__text"):
            texts = [canonical(t) for t in texts_of(b, "__text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([fingerprint_of(t) for t in texts], pa.string()), pa.array(texts, pa.string())], names=schema.names)

    return picked.mapInArrow(run, schema)


def exact_classes(docs: DataFrame, prints: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows and columns of ``prints`` (doc_id, fingerprint, tie and any others) with class_id and n_copies, which
    replace columns of these names.

    ``prints`` are written fingerprints of ``docs``; ``tie`` is ``tie_of`` the text and tells rows with one id apart.
    class_id is the smallest id whose canonical text has the same bytes; null ids belong to a class and never name one,
    unless it has no other (class_id null). Counts come from an aggregation with map-side sums; only rows of buckets
    with several rows fetch their text again, null ids too, and each bucket's rows meet one text of the bucket, not each
    other. Rows whose bytes differ from it (a collision of the hash) are classed among themselves by their bytes.
    Every row of ``prints`` gives one row, repeated ones too; an empty table gives none. Texts of any length are
    compared whole; columns of ``docs`` other than id and text are not read.
    """
    prints = prints.drop("class_id", "n_copies")
    # written, so that the joins below are joins of plain exchanges, which adaptive execution splits at a large bucket
    least = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("__least"), F.count("*").alias("__n")))
    several = least.where("__n > 1").select("fingerprint", F.col("__least").alias("least"))
    wanted = written(prints.join(several, "fingerprint").select(F.col("doc_id").alias("__d"), F.col("tie").alias("__t")).distinct())
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), tie_of(F.col(text)).alias("tie"))
    found = source.join(few, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("tie") == F.col("__t")), "left_semi")
    shared = exact_digests(found, keep=("doc_id", "tie")).join(several, "fingerprint")
    head = written(shared.where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("fingerprint").agg(F.min("canonical").alias("head")))
    differs = written(shared.join(head, "fingerprint").where("canonical <> head").select("doc_id", "tie", "fingerprint", "canonical"))  # as good as always empty
    drop_written(prints.sparkSession, wanted, head)
    if differs.isEmpty():
        return prints.join(least, "fingerprint").select(*prints.columns, F.col("__least").alias("class_id"), F.col("__n").alias("n_copies"))
    apart = differs.groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("__own"), F.count("*").alias("__m"))
    odd = written(differs.join(apart, ["fingerprint", "canonical"]).select(F.col("doc_id").alias("__d"), F.col("tie").alias("__t"), F.col("fingerprint").alias("__f"), "__own", "__m").distinct())
    lost = differs.groupBy("fingerprint").agg(F.count("*").alias("__lost"))
    base = prints.join(least, "fingerprint").join(lost, "fingerprint", "left")
    both = base.join(odd, base.doc_id.eqNullSafe(odd["__d"]) & (base.tie == odd["__t"]) & (base.fingerprint == odd["__f"]), "left")
    own = F.col("__f").isNotNull()
    return both.select(*(base[c] for c in prints.columns), F.when(own, F.col("__own")).otherwise(F.col("__least")).alias("class_id"), F.when(own, F.col("__m")).otherwise(F.col("__n") - F.coalesce("__lost", F.lit(0))).alias("n_copies"))


def edited_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_parts: int | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, tie.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document in descending order of doc_id; the last one's next is the first. Likeness is 1
    if the canonical bytes are equal and 0 if not. Nulls count as empty texts; null ids come last; rows
    with one id follow each other in the order of ``tie``, a hash of the text. An only document is its own next.
    An empty table gives no row; texts of any length are edited whole; columns other than id and text are not read.

    Ids are sorted first, without texts. Their ranges (one row for each reaches the driver) deal the texts out
    by range, and the first document of each range goes to the range before it as well: every task finds
    the next document among its own rows, and texts are shuffled once.
    """
    spark = docs.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("rank", F.when(F.col("doc_id").isNull(), F.lit(-(2**63))).otherwise(F.col("doc_id"))).withColumn("tie", tie_of(F.col("text")))
    keys = rows.select("rank", "tie").repartitionByRange(n, F.desc("rank"), F.desc("tie")).sortWithinPartitions(F.desc("rank"), F.desc("tie"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for b in batches:
            if b.num_rows and first is None:
                first = (b.column(0)[0].as_py(), b.column(1)[0].as_py())
        if first:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "rank": [first[0]], "tie": [first[1]]})

    heads = [(r["rank"], r["tie"]) for r in keys.mapInArrow(ends, "part long, rank long, tie long").orderBy("part").collect()]
    rank0, tie0 = (np.array([h[k] for h in heads], np.int64) for k in (0, 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = list(zip((-rank0.astype(object)).tolist(), (-tie0.astype(object)).tolist(), strict=True))
        from bisect import bisect_right

        for b in steps(batches):
            rank, tie = b.column(2).to_pylist(), b.column(3).to_pylist()
            bucket = [bisect_right(order, (-r, -t)) - 1 for r, t in zip(rank, tie, strict=True)]
            again = [i for i, (k, r, t) in enumerate(zip(bucket, rank, tie, strict=True)) if order[k] == (-r, -t)]
            take = pa.array([*range(b.num_rows), *again])
            home = [*bucket, *((bucket[i] - 1) % len(order) for i in again)]
            guest = [False] * b.num_rows + [True] * len(again)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), pa.array(guest), *(c.take(take) for c in b.columns)], names=["bucket", "guest", *b.schema.names])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, canonical, fingerprint, tie) of the row before
        out: list[tuple] = []

        def pair(a: tuple, b: tuple) -> tuple:
            half = len(a[2]) // 2
            edited = a[2][: len(a[2]) - half] + b[2][:half]
            folded = canonical(edited)
            return (a[1], len(a[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a[4], fingerprint_of(folded), float(folded == a[3]), float(a[3] == b[3]), a[5])

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=RESULT.names)

        for b in steps(batches):
            cols = {k: b.column(b.schema.get_field_index(k)).to_pylist() for k in ("bucket", "guest", "doc_id", "tie")}
            for bucket, guest, i, tie, t in zip(cols["bucket"], cols["guest"], cols["doc_id"], cols["tie"], texts_of(b), strict=True):
                folded = canonical(t)
                row = (bucket, i, t, folded, fingerprint_of(folded), tie)
                if held is not None and held[0] == bucket:
                    out.append(pair(held, row))
                held = None if guest else row
            if out:
                yield told()
                out = []

    if not heads:
        return spark.createDataFrame([], RESULT)
    dealt = rows.mapInArrow(deal, T.StructType([T.StructField("bucket", T.LongType()), T.StructField("guest", T.BooleanType()), *rows.schema.fields]))
    # one task may hold several buckets; guests come after a bucket's own rows
    placed = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.desc("rank"), F.desc("tie"))
    return placed.mapInArrow(edit, RESULT)


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), *(T.StructField(k, T.StringType()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(T.StructField(k, T.DoubleType()) for k in ("near_edited", "near_next")), T.StructField("tie", T.LongType())])
