"""Operator 5: secret scan with multipart credential linking.

Only DataFrame functions. Strong findings (assignments of long values, access keys, long hexadecimal
strings) are reported wherever they stand. Weak candidates - short assigned values, random-looking
tokens, user or client names, service endpoints - say little alone. They are joined by interval: all
parts of a document are put in order of position, and a range frame around each part (its scope)
holds the parts near it. A weak part is reported only where its complements co-occur in the scope:
a secret needs an identifier and an endpoint or a strong identifier, a name or an endpoint needs a
secret and the other one.

Texts never leave the scan: regular expressions turn each into an array of small parts, and only
parts are shuffled, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Code points on either side of a part that are its scope.
SCOPE = 200
#: Strong kinds in the order in which they are listed, with their patterns (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: Weak kinds: names, endpoints and tokens.
NAME = r"""(?i:user(?:name)?|login|client_?id|account|tenant)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@/-]{4,}|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{4,}"""
WEAK_TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "weak_secret", "name", "endpoint")
FOUND = "struct<kind:int,n:int,gap:int,size:int,good:boolean>"


def _found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """All leftmost matches of a pattern in order: their number, the characters since the match before, their size, and
    whether they pass the test ``keep``. Work and size are in proportion to the matches; texts without one are scanned once."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{FOUND}>")

    def told(hit: Column, between: Column, n: Column) -> Column:
        good = F.lit(True) if keep is None else keep(hit)
        return F.struct(F.lit(kind).alias("kind"), n.alias("n"), F.length(between).alias("gap"), F.length(hit).alias("size"), good.alias("good"))

    def listed(x: Column) -> Column:
        pairs = F.zip_with(x["hits"], F.slice(x["between"], F.lit(1), F.size(x["hits"])), lambda h, b: F.struct(h.alias("h"), b.alias("b")))
        return F.transform(pairs, lambda p, i: told(p["h"], p["b"], i))

    # an array of one element, so that both lists are made once
    once = F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, listed(F.struct(h.alias("hits"), F.split(text, pattern).alias("between")))).otherwise(none))
    return once[0].cast(f"array<{FOUND}>")


def _value(hit: Column) -> Column:
    return F.regexp_extract(hit, ASSIGN, 1)


def secret_parts(text: Column) -> Column:
    """All parts of a text, strong and weak, as an array of their lengths and distances by kind (see ``_found``). What one
    pattern finds for two kinds is listed under numbers of its own for each."""
    assigned = _found(text, ASSIGN, 0, lambda h: F.length(_value(h)) >= 8)
    short = _found(text, ASSIGN, 3, lambda h: F.length(_value(h)).between(4, 7))
    tokens = F.transform(_found(text, WEAK_TOKEN, 3), lambda x: x.withField("kind", F.lit(6)))
    return F.concat(assigned, short, _found(text, ACCESS, 1), _found(text, HEX, 2), tokens, _found(text, NAME, 4), _found(text, ENDPOINT, 5))


def secret_spans(docs: DataFrame, scope: int = SCOPE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id and ``spans``, an array of (first, kind, last, text-free) parts
    sorted by start, then kind as in KINDS; ``kind`` is an index into KINDS.

    Null and empty texts have no spans; an empty table gives no row. Null ids and repeated rows are kept as rows of
    their own; columns other than id and text are not read. A weak part that overlaps a strong one is not reported.
    The scope reaches ``scope`` code points from a part's start to the starts of its complements. Texts of any length
    are searched whole; the parts of one text are rows, sorted by position, and the work grows with their number.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), secret_parts(F.coalesce(F.col(text), F.lit(""))).alias("parts"))
    # dealt out by document once; all windows and the last aggregation keep that
    each = rows.select("doc_id", "row", F.explode_outer("parts").alias("p")).select("doc_id", "row", "p.*").repartition("row")
    upto = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    # matches that fail their test count for positions only: they have no kind from here on, but keep their document's row
    kind = F.when(F.col("good"), F.when(F.col("kind") == 6, 3).otherwise(F.col("kind")))
    placed = each.withColumn("last", upto).select("doc_id", "row", kind.alias("kind"), (F.col("last") - F.col("size")).alias("first"), "last")
    near = W.partitionBy("row").orderBy("first").rangeBetween(-scope, scope)

    def there(*kinds: int) -> Column:
        return F.max(F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).over(near)

    strong = F.col("kind") <= 2
    before = W.partitionBy("row").orderBy("first", "kind").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("row").orderBy(F.desc("first"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    over = (F.coalesce(F.max(F.when(strong, F.col("last"))).over(before), F.lit(0)) > F.col("first")) | (F.coalesce(F.min(F.when(strong, F.col("first"))).over(behind), F.lit(2**31 - 1)) < F.col("last"))
    seen = placed.select("*", there(1).alias("access"), there(4).alias("name"), there(5).alias("endpoint"), there(0, 2, 3).alias("secret"), over.alias("inside"))
    linked = (
        F.when(F.col("kind") <= 2, True)
        .when(F.col("kind").isNull() | F.col("inside"), False)
        .when(F.col("kind") == 3, F.col("access") | (F.col("name") & F.col("endpoint")))
        .when(F.col("kind") == 4, F.col("secret") & F.col("endpoint"))
        .otherwise(F.col("secret") & (F.col("name") | F.col("access")))
    )
    part = F.when(linked, F.struct("first", "kind", "last"))
    return seen.groupBy("row", "doc_id").agg(F.array_sort(F.collect_set(part)).alias("spans")).select("doc_id", "spans")


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ",")
