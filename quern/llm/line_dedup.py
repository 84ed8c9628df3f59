"""Operator 8: line deduplication by winnowing over line hashes.

Only DataFrame functions. Line hashes are computed once and stored as arrays. A line is a physical line or, inside one, a sentence: text is cut after
each line break and after each full stop, exclamation or question mark with white space behind it.
Of every WINDOW consecutive line hashes the smallest is selected as a fingerprint, and so is every
long line by itself. A run of lines that occurs twice and has WINDOW lines or a long line is long
enough, and has a fingerprint in common, at the same place of the run. Each fingerprint's positions are joined
to its first one, in the order of (doc_id, hash of the text, position), and the match is extended
both ways over the neighbouring hashes that travel with it. Fingerprints inside a run are at most
WINDOW lines apart, so neighbours up to that distance close every gap. That first one may stand among
other lines than a later pair has in common, so the windows that a fingerprint was selected from (and the shorter pieces
that begin or end with it, if it is a long line) are joined once more where the match leaves them out, each to the
first place of the same lines. Runs that are long enough are deleted where they repeat; their first occurrence always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written

#: Lines in a window of fingerprint selection; also the lines that make a run long enough.
WINDOW = 4
#: Characters from which a line is a fingerprint by itself.
LONG_CHARS = 100
#: What ends a line, if a character other than white space follows.
LINE_END = r"([.!?][ \t]|\n)(?=\S)"
#: A character that marks the ends; texts that hold it are cut by a slower expression with the same result.
MARK = "\x01"


def lines_of(text: Column) -> Column:
    """The lines of a text with their trailing white space; joined they give the text."""
    text = F.coalesce(text, F.lit(""))
    marked = F.split(F.regexp_replace(text, LINE_END, "$1" + MARK), MARK)
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, r"(?<=[.!?][ \t]|\n)(?=\S)")).otherwise(marked)


def _numbers(text: Column) -> Column:
    """A hash for each line without its outer white space; the last bit tells whether the line is long."""
    return F.transform(lines_of(text), lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r\n"))).bitwiseAND(F.lit(-2)) + (F.length(x) >= LONG_CHARS).cast("long"))


def _short(x: Column) -> Column:
    return x.bitwiseAND(F.lit(2**31 - 1)).cast("int")


def _fingerprints(hashed: DataFrame) -> DataFrame:
    """(ord, th, pos, hash, around, before, after): the selected positions of each document, with the hashes of the
    neighbours up to WINDOW lines away, shortened to 31 bits.

    ``before`` lines next to a position on the left are not smaller, and ``after`` ones on the right are greater (fewer than
    WINDOW each). So it is selected from the windows that begin up to ``before`` lines before it and end up to
    ``after`` lines behind it; every window has exactly one selected position."""
    each = hashed.select("ord", "th", "hashes", F.posexplode("hashes").alias("pos", "hash"))

    def free(step: int) -> Column:
        out = F
        for k in range(1, WINDOW):
            x = F.get("hashes", F.col("pos") + step * k)
            out = out.when(~F.coalesce(x > F.col("hash") if step > 0 else x >= F.col("hash"), F.lit(False)), k - 1)
        return out.otherwise(WINDOW - 1)

    alone = (F.size("hashes") < WINDOW) & (F.col("hash") == F.array_min("hashes"))
    chosen = each.where((F.col("hash") % 2 != 0) | (free(-1) + free(1) >= WINDOW - 1) | alone)
    around = F.slice("hashes", F.greatest(F.col("pos") - WINDOW + 1, F.lit(1)), F.least(F.col("pos"), F.lit(WINDOW)) + WINDOW + 1)
    return chosen.select("ord", "th", "pos", "hash", F.transform(around, _short).alias("around"), free(-1).alias("before"), free(1).alias("after"))


def _agreement(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(pairs, False)
    return F.when(at == 0, F.size(pairs)).otherwise(at - 1).cast("int")


def repeated_runs(hashed: DataFrame) -> DataFrame:
    """(ord, th, runs): for each document with any, the disjoint line ranges (first, last, end exclusive)
    made of runs that occur earlier and have WINDOW lines or a long one. ``hashed`` has ord, th and hashes."""
    prints = _fingerprints(hashed)
    # Aggregates are written before their joins: a join of two plain exchanges can split a very frequent hash.
    counted = written(prints.groupBy("hash").agg(F.count("*").alias("n"), F.min("ord").alias("least")).where("n > 1").select("hash", "least"))
    shared = written(prints.join(counted, "hash"))
    first = written(shared.where("ord = least").groupBy("hash").agg(F.min(F.struct("th", "pos", "around")).alias("f")))
    pairs = shared.join(first, "hash").where((F.col("ord") != F.col("least")) | (F.col("th") != F.col("f.th")) | (F.col("pos") != F.col("f.pos")))

    def before(pos: Column, around: Column) -> Column:
        return F.reverse(F.slice(around, F.lit(1), F.least(pos, F.lit(WINDOW))))

    def after(pos: Column, around: Column) -> Column:
        return F.slice(around, F.least(pos, F.lit(WINDOW)) + 2, F.lit(WINDOW))

    mine, other = (F.col("pos"), F.col("around")), (F.col("f.pos"), F.col("f.around"))
    matched = pairs.select("ord", "th", "pos", "hash", "around", "before", "after", F.least(F.col("pos"), F.lit(WINDOW)).alias("at"), _agreement(before(*mine), before(*other)).alias("back"), _agreement(after(*mine), after(*other)).alias("on"))
    inside = F.slice("around", F.col("at") + 1 - F.col("back"), F.col("back") + 1 + F.col("on"))
    enough = (F.col("back") + 1 + F.col("on") >= WINDOW) | F.exists(inside, lambda x: x % 2 != 0)

    def run(first: Column, last: Column, piece: Column) -> Column:
        return F.struct(first.alias("first"), last.alias("last"), piece.alias("piece"))

    def left_out(size: int, lead: int) -> Column:
        """The ``size`` lines from ``lead`` before the fingerprint, if they are there and go beyond the match."""
        ok = (F.col("at") >= lead) & (F.col("at") - lead + size <= F.size("around")) & ((F.col("back") < lead) | (F.col("on") < size - 1 - lead))
        ok = ok & (F.col("before") >= lead) & (F.col("after") >= WINDOW - 1 - lead) if size == WINDOW else ok & (F.col("hash") % 2 != 0)
        start = F.col("pos") - lead
        return F.when(ok, run(start, start + size, F.xxhash64(F.lit(size), F.slice("around", F.col("at") - lead + 1, F.lit(size)))))

    pieces = [left_out(WINDOW, lead) for lead in range(WINDOW)] + [left_out(size, lead) for size in range(2, WINDOW) for lead in (0, size - 1)]
    whole = F.when(enough, run(F.col("pos") - F.col("back"), F.col("pos") + 1 + F.col("on"), F.lit(None).cast("long")))
    each = written(matched.select("ord", "th", F.explode(F.array_compact(F.array(whole, *pieces))).alias("r")).select("ord", "th", "r.*"))
    drop_written(hashed.sparkSession, counted, shared, first)
    place = F.struct("ord", "th", "first")
    again = each.where("piece is not null")
    firsts = written(again.groupBy("piece").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("piece", "f"))
    later = again.join(firsts, "piece").where(place != F.col("f"))
    found = each.where("piece is null").unionByName(later.select(each.columns)).select("ord", "th", F.struct("first", "last").alias("r"))
    listed = found.groupBy("ord", "th").agg(F.array_sort(F.collect_set("r")).alias("ranges"))

    def merge(done: Column, r: Column) -> Column:
        top = F.element_at(done, -1)
        joined = F.struct(top["first"].alias("first"), F.greatest(top["last"], r["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["last"] >= r["first"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    start = F.array().cast("array<struct<first:int,last:int>>")
    return listed.select("ord", "th", F.aggregate("ranges", start, merge).alias("runs"))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows and columns of ``docs`` with repeated runs of lines cut out of the text, and the numbers of
    lines before and of lines removed, which replace columns of these ``names``.

    A run is cut if it has WINDOW lines or a line of LONG_CHARS, and stands earlier; the earliest
    occurrence of every line stays. A null text stays null, an empty one empty (one line). Rows that repeat both
    id and text count as one document and stay equal. Null ids come last in the order. A text may
    become empty; no row goes. Documents of any length are handled whole.
    """
    held = docs.drop(*names).withColumns({"__ord": F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)), "__th": F.xxhash64(text)})
    hashed = written(held.where(F.col(text).isNotNull()).select(F.col("__ord").alias("ord"), F.col("__th").alias("th"), _numbers(F.col(text)).alias("hashes")))
    runs = repeated_runs(hashed).withColumnsRenamed({"ord": "o", "th": "t"})
    sizes = hashed.groupBy("ord", "th").agg(F.max(F.size("hashes")).alias("__size"))
    known = sizes.join(runs, (F.col("ord") == F.col("o")) & (F.col("th") == F.col("t")), "left").select(F.col("ord").alias("__o"), F.col("th").alias("__t"), "__size", F.col("runs").alias("__cut")).hint("shuffle_hash")
    both = held.join(known, (F.col("__ord") == F.col("__o")) & (F.col("__th") == F.col("__t")) & F.col(text).isNotNull(), "left")
    changed = F.col("__cut").isNotNull()
    kept = F.filter(lines_of(F.col(text)), lambda x, i: ~F.exists("__cut", lambda r: (i >= r["first"]) & (i < r["last"])))
    removed = F.aggregate("__cut", F.lit(0), lambda n, r: n + r["last"] - r["first"])
    return both.select(
        *(F.when(changed, F.array_join(kept, "")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns if c not in names),
        F.coalesce("__size", F.lit(0)).cast("long").alias(names[0]),
        F.when(changed, removed).otherwise(0).cast("long").alias(names[1]),
    )
