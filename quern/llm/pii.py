"""Operator 1: format-preserving Feistel pseudonyms.

Only DataFrame functions. Card numbers (Luhn), account numbers (IBAN, mod 97), social security
numbers, IPv4 addresses, phone numbers, calendar dates and e-mail addresses are found, validated, and
permuted within their format by a keyed Feistel network. The permutation is a bijection on the valid
values of a kind, so equal values get equal pseudonyms in all documents, different values different
ones, and each pseudonym is valid again. Separators and other layout stay.

A value becomes a vector of small numbers, each with a radix of its own (10 for a digit, 256 for a
byte, 26 for a letter). The vector is cut into two halves, and each round adds to every number of one
half a keyed hash of the other half, modulo its radix. Whatever the radices, every round can be undone,
so no walking through invalid values is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the Feistel network.
ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "card", "phone")
#: Countries by the length of their account numbers (IBAN registry).
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}
#: Account numbers end where their country's length does, if no letter or digit follows directly; those of unlisted
#: countries go as far as groups of four do, and words behind them are left off.
IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items()) + ")"
#: Candidates of each kind (fixed patterns); what follows a digit or letter directly is none. A card number may begin inside
#: a candidate that failed: those that follow other groups are tried at every place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}}){IBAN}",
    "iban_other": rf"(?<![A-Za-z0-9])(?!(?:{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[0-9])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "card_again": r"(?<=[0-9][ -])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?|\([0-9]{3}\) ?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9.-]*[0-9])",
}
#: Kinds that are searched for together, in this order. What fails its check in one search is part of the text for the next.
SEARCHES = (("email",), ("iban",), ("iban_other",), ("ip", "date", "ssn", "card"), ("card_again",), ("phone",))
#: What any candidate of a search holds: a plain test that spares most texts the search itself.
NEEDS = {"email": "@", "iban": "[A-Z]{2}[0-9]{2}", "iban_other": "[A-Z]{2}[0-9]{2}", "ip": "[0-9]", "card_again": PATTERNS["card_again"], "phone": r"[+(][0-9]|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"}
#: Stands, with a character for the search behind it, for what a search has found; in texts that hold it, it is written with ESCAPED behind it.
MARK, ESCAPED = "\ue000", "\ue001"
#: The 100 years whose dates stay among themselves, and the 400 years around them; days of both as products of two radices.
NEAR, FAR = ("1925-01-01", 75, 487), ("1825-01-01", 276, 397)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mark(n: int) -> str:
    return MARK + chr(ord(ESCAPED) + n)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """A keyed bijection on vectors with the given radices. A vector of one number is its own first half."""

    def halves(s: Column) -> Column:
        half = F.greatest(F.floor(F.size(s["v"]) / 2), F.lit(1)).cast("int")
        rest = F.greatest(F.size(s["v"]) - half, F.lit(0))
        return F.struct(*(part.alias(n) for n, part in (("a", F.slice(s["v"], 1, half)), ("ra", F.slice(s["r"], 1, half)), ("b", F.slice(s["v"], half + 1, rest)), ("rb", F.slice(s["r"], half + 1, rest)))))

    def mixed(part: Column, radix: Column, other: Column, r: Column) -> Column:
        def with_seen(seen: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), i.cast("string"), seen), 256)
                return F.pmod(x + F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.get(radix, i)).cast("long")

            return F.transform(part, one)

        return let(F.array_join(other.cast("array<string>"), ","), with_seen)

    def network(h: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            odd = F.struct(mixed(acc["a"], h["ra"], acc["b"], r).alias("a"), acc["b"].alias("b"))
            even = F.struct(acc["a"].alias("a"), mixed(acc["b"], h["rb"], acc["a"], r).alias("b"))
            return F.when(r % 2 == 1, odd).otherwise(even)

        start = F.struct(h["a"].alias("a"), h["b"].alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    return let(let(F.struct(values.alias("v"), radices.alias("r")), halves), network)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("long"))


def _refilled(layout: Column, chars: Column, slot: str) -> Column:
    """The layout with its characters that match ``slot`` replaced by ``chars`` in order."""

    def filled(new: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            here = c.rlike(slot)
            return F.struct((acc["i"] + here.cast("int")).alias("i"), F.concat(acc["out"], F.when(here, F.get(new, acc["i"])).otherwise(c)).alias("out"))

        return F.aggregate(_chars(layout), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda a: a["out"])

    return let(chars, filled)


def _tens(n: Column) -> Column:
    return F.transform(n, lambda _: F.lit(10).cast("long"))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second one from the right end, the last excluded, doubled."""
    n = F.size(digits)

    def worth(d: Column, i: Column) -> Column:
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(digits, worth), F.lit(0).cast("long"), lambda a, x: a + x)


def _card(hit: Column, key: str) -> Column:
    def shown(digits: Column) -> Column:
        body = F.slice(digits, 1, F.size(digits) - 1)

        def checked(new: Column) -> Column:
            check = F.pmod(-luhn_sum(F.concat(new, F.array(F.lit(0).cast("long")))), F.lit(10))
            return _refilled(hit, F.concat(new, F.array(check)).cast("array<string>"), "[0-9]")

        return F.when(luhn_sum(digits) % 10 == 0, let(feistel(body, _tens(body), key, "card"), checked))

    return let(_digits(hit), shown)


def _phone(hit: Column, key: str) -> Column:
    """The country code stays; a number of fewer than 7 or more than 15 digits is none."""
    code = F.regexp_extract(hit, r"^\+[0-9]{1,3}(?=[ .(-])", 0)

    def shown(rest: Column) -> Column:
        new = let(_digits(rest), lambda d: feistel(d, _tens(d), key, "phone"))
        return F.concat(code, _refilled(rest, new.cast("array<string>"), "[0-9]"))

    return F.when(F.length(F.regexp_replace(hit, "[^0-9]", "")).between(7, 15), let(F.substring(hit, F.length(code) + 1, F.length(hit)), shown))


def _ip(hit: Column, key: str) -> Column:
    def shown(parts: Column) -> Column:
        new = feistel(parts, F.transform(parts, lambda _: F.lit(256).cast("long")), key, "ip")
        return F.when(F.forall(parts, lambda p: p < 256), F.array_join(new.cast("array<string>"), "."))

    return let(F.split(hit, r"\.").cast("array<long>"), shown)


def _ssn(hit: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(hit, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = feistel(values, F.array(*(F.lit(x).cast("long") for x in (898, 99, 9999))), key, "ssn")
    shown = let(new, lambda v: F.concat_ws("-", F.lpad((F.when(v[0] >= 665, v[0] + 2).otherwise(v[0] + 1)).cast("string"), 3, "0"), F.lpad((v[1] + 1).cast("string"), 2, "0"), F.lpad((v[2] + 1).cast("string"), 4, "0")))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), shown)


def _date(hit: Column, key: str) -> Column:
    """Year-month-day, or day and month in either order before the year, told apart where only one is a date (day first if both are)."""
    layouts = (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", "dd/MM/yyyy"), (".", "MM.dd.yyyy"), ("/", "MM/dd/yyyy"))
    near0, far0 = (F.lit(x[0]).cast("date") for x in (NEAR, FAR))
    tries = F.array(*(F.struct(F.lit(layout).alias("layout"), F.when(F.substring(hit, 5 if sep == "-" else 3, 1) == sep, F.try_to_date(hit, layout)).alias("day")) for sep, layout in layouts))
    best = F.filter(tries, lambda t: t["day"].isNotNull())

    def shown(t: Column) -> Column:
        at = F.datediff(t["day"], near0).cast("long")
        inner, outer = F.datediff(t["day"], near0).between(0, NEAR[1] * NEAR[2] - 1), F.datediff(t["day"], far0).cast("long")
        gap = F.datediff(near0, far0)
        size = NEAR[1] * NEAR[2]
        rest = F.when(outer < gap, outer).otherwise(outer - size)

        def moved(n: Column, radix: int, rows: int, kind: str) -> Column:
            new = feistel(F.array(F.floor(n / radix).cast("long"), F.pmod(n, F.lit(radix)).cast("long")), F.array(F.lit(rows).cast("long"), F.lit(radix).cast("long")), key, kind)
            return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a * radix + x).cast("int")

        far = let(moved(rest, FAR[2], FAR[1], "date-far"), lambda n: F.date_add(far0, F.when(n < gap, n).otherwise(n + size)))
        day = F.when(inner, F.date_add(near0, moved(at, NEAR[2], NEAR[1], "date"))).when(outer.between(0, 146096), far)

        def written(d: Column) -> Column:
            return reduce(lambda acc, x: acc.when(t["layout"] == x[1], F.date_format(d, x[1])), layouts[1:], F.when(t["layout"] == layouts[0][1], F.date_format(d, layouts[0][1])))

        return let(day, written)

    return F.get(F.transform(F.slice(best, 1, 1), shown), F.lit(0))


def _worth(c: Column) -> Column:
    """Digits as they are, A to Z as 10 to 35."""
    return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)


def _mod97(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(0), lambda r, c: (r * F.when(_worth(c) > 9, 100).otherwise(10) + _worth(c)) % 97)


def _mixed(chars: Column, key: str, kind: str) -> Column:
    """Letters and digits permuted within their class; characters of other classes stay."""

    def classed(c: Column) -> Column:
        base = F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).when(c.rlike("[a-z]"), 97).otherwise(0)
        return F.struct(c.alias("c"), base.alias("base"))

    def moved(cs: Column) -> Column:
        radix = F.transform(cs, lambda x: F.when(x["base"] == 48, 10).when(x["base"] > 0, 26).otherwise(1).cast("long"))
        values = F.transform(cs, lambda x: F.when(x["base"] > 0, F.ascii(x["c"]) - x["base"]).otherwise(0).cast("long"))
        return F.zip_with(feistel(values, radix, key, kind), cs, lambda v, x: F.when(x["base"] > 0, F.char((v + x["base"]).cast("int"))).otherwise(x["c"]))

    return let(F.transform(chars, classed), moved)


def _iban(hit: Column, key: str) -> Column:
    """The country stays, the account is permuted, the check digits follow."""
    zero = F.array(F.lit("0"), F.lit("0"))

    def shown(chars: Column) -> Column:
        country, account = F.slice(chars, 1, 2), F.slice(chars, 5, F.greatest(F.size(chars) - 4, F.lit(0)))

        def whole(new: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(new, country, zero))).cast("string"), 2, "0")
            return _refilled(hit, F.concat(country, _chars(check), new), "[A-Z0-9]")

        return F.when(_mod97(F.concat(account, F.slice(chars, 1, 4))) == 1, let(_mixed(account, key, "iban"), whole))

    return let(_chars(F.replace(hit, F.lit(" "), F.lit(""))), shown)


def _account_in(hit: Column) -> Column:
    """The longest beginning of the hit, by whole groups, that is a valid account number; null if none is."""

    def valid(value: Column) -> Column:
        def checked(chars: Column) -> Column:
            return (_mod97(F.concat(F.slice(chars, 5, F.greatest(F.size(chars) - 4, F.lit(0))), F.slice(chars, 1, 4))) == 1) & F.size(chars).between(15, 34)

        return let(_chars(F.replace(value, F.lit(" "), F.lit(""))), checked)

    def shorter(groups: Column) -> Column:
        return F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))

    return F.get(F.filter(let(F.split(hit, " "), shorter), valid), F.lit(0))


def _email(hit: Column, key: str) -> Column:
    """The domain stays; the local part is permuted within letters and digits."""
    name = F.substring_index(hit, "@", 1)
    return F.concat(F.array_join(_mixed(_chars(name), key, "email"), ""), F.lit("@"), F.substring_index(hit, "@", -1))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with personal values in the text replaced, and ``pii``, a map from
    kind to number of values replaced (it takes the place of a column of that name).

    Null texts stay null, empty ones empty; an empty table stays empty. Candidates that fail validation stay as they
    are, but what stands inside them or beside them is still searched for the other kinds. Nothing is shuffled; repeated
    rows, null ids and other columns do not matter, and texts of any length are searched whole. The same key
    gives the same pseudonyms in every run and every document.
    """
    makers = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
    found = "array<struct<kind:string,new:string>>"

    def replaced(hit: Column, kinds: tuple[str, ...]) -> Column:
        """Kind, old and new value, and what of the hit is no part of the value; ``new`` is null where a check fails."""
        if kinds == ("iban_other",):
            tail = lambda a: F.coalesce(F.substring(hit, F.length(a) + 1, F.length(hit)), F.lit(""))
            return let(_account_in(hit), lambda a: F.struct(F.lit("iban").alias("kind"), hit.alias("old"), F.when(a.isNotNull(), _iban(a, key)).alias("new"), tail(a).alias("tail")))
        of = {k: hit.rlike(rf"^(?:{PATTERNS[k]})$") if len(kinds) > 1 else F.lit(True) for k in kinds}
        new = F.coalesce(*(F.when(of[k], makers[k](hit, key)) for k in kinds))
        return F.struct(F.coalesce(*(F.when(of[k], F.lit(k)) for k in kinds)).alias("kind"), hit.alias("old"), new.alias("new"), F.lit("").alias("tail"))

    def searched(body: Column, kinds: tuple[str, ...], n: int) -> Column:
        """The text with marks for what is found, and the finds in order; one search unless there are candidates."""
        if kinds != ("card_again",):
            return at(body, F.lit("|".join(PATTERNS[k] for k in kinds)), kinds, n)
        tried = F.array_distinct(F.regexp_extract_all(body, F.lit(f"(?=({PATTERNS['card_again']}))"), F.lit(1)))
        good = F.transform(F.filter(tried, lambda c: luhn_sum(_digits(c)) % 10 == 0), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E")))
        pattern = F.concat(F.lit("(?<![0-9])(?:"), F.when(F.size(good) > 0, F.array_join(good, "|")).otherwise("(?!)"), F.lit(")(?![0-9])"))
        return let(pattern, lambda p: at(body, p, ("card",), n))

    def at(body: Column, pattern: Column, kinds: tuple[str, ...], n: int) -> Column:
        def marked(hits: Column) -> Column:
            pairs = F.zip_with(F.split(body, pattern), hits, lambda p, h: F.array(p, F.when(h["new"].isNotNull(), F.concat(F.lit(_mark(n)), h["tail"])).otherwise(F.coalesce(h["old"], F.lit("")))))
            kept = F.transform(F.filter(hits, lambda h: h["new"].isNotNull()), lambda h: F.struct(h["kind"].alias("kind"), h["new"].alias("new")))
            return F.struct(F.array_join(F.flatten(pairs), "").alias("body"), kept.cast(found).alias("found"))

        def made(hits: Column) -> Column:
            return F.when(F.size(hits) > 0, let(F.transform(hits, lambda h: replaced(h, kinds)), marked)).otherwise(F.struct(body.alias("body"), F.array().cast(found).alias("found")))

        return let(F.regexp_extract_all(body, pattern, F.lit(0)), made)

    def put_back(body: Column, found: Column, n: int) -> Column:
        pairs = F.zip_with(F.split(body, _mark(n)), found, lambda p, f: F.array(p, F.coalesce(f["new"], F.lit(""))))
        return F.when(F.size(found) > 0, F.array_join(F.flatten(pairs), "")).otherwise(body)

    body = F.coalesce(F.col(text), F.lit(""))
    staged = docs.drop("pii").withColumn("__0", F.struct(F.when(F.contains(body, F.lit(MARK)), F.replace(body, F.lit(MARK), F.lit(MARK + ESCAPED))).otherwise(body).alias("body")))
    for n, kinds in enumerate(SEARCHES, 1):
        before = F.col(f"__{n - 1}.body")
        some = F.contains(before, F.lit("@")) if kinds == ("email",) else before.rlike(NEEDS[kinds[0]])
        staged = staged.withColumn(f"__{n}", F.when(some, searched(before, kinds, n)).otherwise(F.struct(before.alias("body"), F.array().cast(found).alias("found"))))
    steps = range(1, len(SEARCHES) + 1)
    hits = F.concat(*(F.col(f"__{n}.found") for n in steps))
    whole = reduce(lambda acc, n: put_back(acc, F.col(f"__{n}.found"), n), reversed(steps), F.col(f"__{len(SEARCHES)}.body"))
    clear = F.when(F.contains(body, F.lit(MARK)), F.replace(whole, F.lit(MARK + ESCAPED), F.lit(MARK))).otherwise(whole)
    kinds = F.transform(hits, lambda h: h["kind"])
    counted = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    return staged.select(*(F.when(F.size(hits) > 0, clear).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns if c != "pii"), counted.alias("pii"))
