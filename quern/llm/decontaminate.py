"""Operator 7: benchmark decontamination over a distributed positional inverted index.

Only DataFrame functions. The terms of the benchmark are counted over the whole corpus. Each window
of a benchmark item is represented by its rarest term, so every occurrence of the window contains an
occurrence of that term. The postings of these terms alone are stored: term, document, position, and
the terms around the position as far as a window can reach. A posting minus the term's offset in an
item is an alignment of the item with the document; the lists are intersected there by extending the
agreement to the left and right. Where it spans a whole window, the match is exact. A window whose
terms all stand around the posting in another order or with a few words between is a proximity match.

Equal alignments of one posting stay in one row as an array, so a passage that very many documents
share costs a few rows a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: What separates words once A-Z count as word characters: every other ASCII character but digits and a-z (fixed pattern).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the table of rarest terms up to which it is broadcast; beyond, the join is a shuffled one.
BROADCAST_TERMS = 50_000
#: Words that one row carries while positions are listed; with a window's reach on either side every posting sees its context.
BLOCK = 256


def _raw_words(text: Column) -> Column:
    """Words as written, without the empty strings before and after separators; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def _fold(word: Column) -> Column:
    """A-Z as a-z and nothing else."""
    return F.translate(word, UPPER, LOWER)


def _folded(words: Column) -> Column:
    return F.transform(words, _fold)


def _agreement(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(pairs, False)
    return F.when(at == 0, F.size(pairs)).otherwise(at - 1).cast("int")


def rarest_terms(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """One row for each term that is the rarest of some window: ``term`` and ``refs``, an array of
    (item_id, offset, n, left, right): the item's length in words and its words before the offset, nearest
    first, and after it, no further than a window reaches."""
    words = items.select("item_id", _folded(_raw_words(F.col("text"))).alias("words")).where(F.size("words") > 0)
    words = written(words.groupBy("item_id", "words").count().select(F.xxhash64("item_id", "words").alias("k"), "item_id", "words", F.size("words").alias("n")))
    placed = words.select("k", "n", F.posexplode("words").alias("offset", "term"))
    vocabulary = placed.select("term").distinct()
    every = docs.select(F.explode(F.split("text", SEPARATORS)).alias("raw")).select(_fold(F.col("raw")).alias("term"))
    counts = every.join(_sized(vocabulary), "term", "left_semi").groupBy("term").count()
    starts = words.select("k", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))).alias("start"))
    places = starts.select("k", "start", F.explode(F.sequence("start", F.least(F.col("start") + window, F.col("n")) - 1)).alias("offset"))
    rated = places.join(placed, ["k", "offset"]).join(counts, "term", "left").select("k", "start", "term", "offset", F.coalesce("count", F.lit(0)).alias("count"))
    chosen = rated.groupBy("k", "start").agg(F.min(F.struct("count", "term", "offset")).alias("best")).select("k", F.col("best.term").alias("term"), F.col("best.offset").alias("offset"), F.col("best.count").alias("count")).where("count > 0").distinct()
    around = chosen.join(words, "k").select(
        "term",
        F.struct(
            "item_id",
            "offset",
            "n",
            F.reverse(F.slice("words", F.greatest(F.col("offset") - window + 2, F.lit(1)), F.least(F.col("offset"), F.lit(window - 1)))).alias("left"),
            F.slice("words", F.col("offset") + 2, F.lit(window - 1)).alias("right"),
        ).alias("ref"),
    )
    return written(around.groupBy("term").agg(F.collect_list("ref").alias("refs")))


def _sized(terms: DataFrame) -> DataFrame:
    """Marked for broadcast if it is small, counted here; else as it is."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def phrase_postings(docs: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """The stored postings: (doc_id, h, term, pos, left, right) for each occurrence of a rarest term.

    ``h`` is a hash of the text that tells rows with one id apart; equal rows have equal postings. A text is cut into
    blocks of BLOCK words and positions are listed by block, so that what a row holds does not grow with the text.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), F.split("text", SEPARATORS).alias("words")).where("words is not null")

    def block(k: Column) -> Column:
        lead = F.least(k * BLOCK, F.lit(window - 1))
        return F.struct((k * BLOCK - lead).alias("start"), lead.alias("lead"), F.slice("words", k * BLOCK - lead + 1, lead + BLOCK + window - 1).alias("words"))

    numbers = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / BLOCK).cast("int"))
    blocks = words.select("doc_id", "h", F.explode(F.transform(numbers, block)).alias("b")).select("doc_id", "h", "b.*")
    each = blocks.select("doc_id", "h", "start", "lead", "words", F.posexplode("words").alias("at", "raw"))
    own = each.where((F.col("at") >= F.col("lead")) & (F.col("at") < F.col("lead") + BLOCK)).withColumn("term", _fold(F.col("raw")))
    return own.join(_sized(terms.select("term")), "term").select(
        "doc_id",
        "h",
        "term",
        (F.col("start") + F.col("at")).alias("pos"),
        F.reverse(_folded(F.slice("words", F.greatest(F.col("at") - window + 2, F.lit(1)), F.least(F.col("at"), F.lit(window - 1))))).alias("left"),
        _folded(F.slice("words", F.col("at") + 2, F.lit(window - 1))).alias("right"),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, h, n_words, n_hit, items (the item_ids with exact windows,
    sorted as strings), near_items (those with proximity matches), spans (hit word ranges, end exclusive).

    A-Z become lower case; words are runs of digits, a-z and non-ASCII characters. A window is
    ``window`` consecutive words of an item, or a whole shorter item. A word of a document is hit if it
    lies inside an occurrence of a window. Null and empty texts have no words and hit nothing, items
    without words match nothing; null ids and repeated rows are kept; an empty benchmark hits nothing, and an
    empty table gives no row; columns other than id and text are not read. An item_id with several texts is hit
    by any of them. Texts of any length are searched whole: what is held for one grows in proportion to its hits.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    terms = rarest_terms(docs, items.select("item_id", "text"), window)
    postings = written(phrase_postings(docs, terms, window))
    joined = postings.join(_sized(terms), "term")

    def aligned(r: Column) -> Column:
        before, after = _agreement(r["left"], F.col("left")), _agreement(r["right"], F.col("right"))
        term = F.array("term")
        context = F.concat("left", term, "right")
        wanted = F.array_distinct(F.concat(r["left"], term, r["right"]))
        close = F.size(F.array_intersect(wanted, context)) >= F.least(r["n"], F.lit(window))
        exact = before + after + 1 >= F.least(r["n"], F.lit(window))
        first, last = (F.col("pos") - before).cast("long"), (F.col("pos") + after + 1).cast("long")
        return F.struct(r["item_id"].alias("item_id"), exact.alias("exact"), close.alias("near"), (F.shiftleft(first, 32) + last).alias("span"))

    found = joined.select("doc_id", "h", F.filter(F.transform("refs", aligned), lambda m: m["exact"] | m["near"]).alias("m")).where(F.size("m") > 0)
    rows = found.select(
        "doc_id",
        "h",
        F.array_distinct(F.transform(F.filter("m", lambda m: m["exact"]), lambda m: m["span"])).alias("spans"),
        F.array_distinct(F.transform(F.filter("m", lambda m: m["exact"]), lambda m: m["item_id"])).alias("items"),
        F.array_distinct(F.transform(F.filter("m", lambda m: m["near"]), lambda m: m["item_id"])).alias("near_items"),
    )
    # spans are longs (first word above, end below), which are told apart and sorted without comparing pairs
    whole = rows.groupBy("doc_id", "h").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "items", "near_items")))
    taken = F.transform(F.array_sort("spans"), lambda s: F.struct(F.shiftright(s, 32).cast("int").alias("first"), s.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("last")))
    start = F.struct(F.lit(-1).alias("upto"), F.lit(0).alias("hit"))

    def cover(acc: Column, s: Column) -> Column:
        return F.struct(F.greatest(acc["upto"], s["last"]).alias("upto"), (acc["hit"] + F.greatest(s["last"] - F.greatest(s["first"], acc["upto"]), F.lit(0))).alias("hit"))

    merged = whole.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), "items", "near_items", taken.alias("spans"))
    hits = merged.withColumn("n_hit", F.aggregate("spans", start, cover, lambda a: a["hit"]))

    def number(parts: Column) -> Column:
        return F.size(parts) - (parts[0] == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")

    n = F.transform(F.array(F.split("text", SEPARATORS)), number)[0]  # splits once
    counted = docs.select("doc_id", F.xxhash64("text").alias("h"), F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_words"))
    joined = counted.join(hits, counted.doc_id.eqNullSafe(F.col("__d")) & (counted.h == F.col("__h")), "left")
    none = F.array().cast(f"array<{items.schema['item_id'].dataType.simpleString()}>")
    return joined.select(
        "doc_id",
        "h",
        "n_words",
        F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        *(F.array_sort(F.coalesce(F.col(c), none), lambda a, b: F.when(a.cast("string") < b.cast("string"), -1).when(a.cast("string") > b.cast("string"), 1).otherwise(0)).alias(c) for c in ("items", "near_items")),
        "spans",
    )
