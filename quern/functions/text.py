"""String functions: case styles, placeholders, wrapping, identifiers and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capitalize(s: Column) -> Column:
    """The first character in upper case, the others as they are (unlike initcap)."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def _rest(parts: Column) -> Column:
    """All elements but the first."""
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def snake_to_camel(s: Column) -> Column:
    """First part in lower case; of every other part only the first character changes."""
    parts = F.split(s, "_")
    rest = F.transform(_rest(parts), capitalize)
    return F.concat(F.lower(F.get(parts, F.lit(0))), F.array_join(rest, ""))


def to_kebab(s: Column) -> Column:
    """Lower case, with a dash before an upper-case letter that follows another kind or begins a word."""
    after_other = F.regexp_replace(s, r"(?<=[^A-Z\-])(?=[A-Z])", "-")
    return F.lower(F.regexp_replace(after_other, r"(?<=[A-Z])(?=[A-Z][a-z])", "-"))


def kebab_to_camel(s: Column) -> Column:
    """The parts between dashes, all but the first capitalised."""
    parts = F.split(s, "-")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(_rest(parts), capitalize), ""))


def without_prefix(s: Column, prefix: str) -> Column:
    """The string less a prefix it may have."""
    return F.when(F.startswith(s, F.lit(prefix)), F.substring(s, len(prefix) + 1, 2**31 - 1)).otherwise(s)


def normalise_placeholders(s: Column) -> Column:
    """%key% as <key>."""
    return F.regexp_replace(s, "%([a-z_]+)%", "<$1>")


def render(template: Column, values: dict[str, Column]) -> Column:
    """The template with each <key> replaced by its value; unknown keys stay."""
    for key, value in values.items():
        template = F.replace(template, F.lit(f"<{key}>"), value.cast("string"))
    return template


def segments(template: Column) -> Column:
    """The template cut into static and dynamic parts, an array of (dynamic, part) in order; empty parts are left out."""
    keys = F.regexp_extract_all(template, F.lit("<([a-z_]+)>"), F.lit(1))
    static = F.split(template, "<[a-z_]+>")
    pairs = F.arrays_zip(static.alias("s"), keys.alias("k"))
    flat = F.flatten(F.transform(pairs, lambda p: F.array(F.struct(F.lit(False).alias("dynamic"), p["s"].alias("part")), F.struct(F.lit(True).alias("dynamic"), p["k"].alias("part")))))
    return F.filter(flat, lambda x: x["part"].isNotNull() & (x["part"] != ""))


def wrap_words(s: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, as many words in each as fit; a longer word has a line of its own."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    start = F.array().cast("array<string>")

    def step(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.length(F.get(lines, F.size(lines) - 1)) + 1 + F.length(word) <= width)
        return F.when(fits, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, start, step)


def is_identifier(s: Column) -> Column:
    """``path`` or ``namespace:path``: lower case, digits, dot, dash and underscore, slashes in the path only."""
    return F.coalesce(s.rlike(r"^(?:[a-z0-9._-]+:)?[a-z0-9/._-]+$"), F.lit(False))


def is_one_word(s: Column) -> Column:
    """Not empty and without white space; null is none."""
    return F.coalesce(s.rlike(r"^\S+$"), F.lit(False))


def flag(s: Column) -> Column:
    """Whether an option is on: present and empty, or "true" in any case; absent (null) is off."""
    return F.coalesce((s == "") | (F.lower(s) == "true"), F.lit(False))


def enum_or_ordinal(s: Column, names: list[str]) -> Column:
    """A name of the list in any case, or the name at the number given, else null."""
    listed = F.array(*map(F.lit, names))
    upper = F.upper(s)
    return F.when(F.array_contains(listed, upper), upper).otherwise(F.get(listed, F.when(s.rlike("^[0-9]{1,6}$"), s.cast("int"))))


def listed(parts: Column, separator: str = ", ") -> Column:
    """Array elements as one string."""
    return F.array_join(parts, separator)


def with_json_field(document: Column, key: str, value: Column) -> Column:
    """A JSON object with one more field (or another value of it); what is no object stays as it is."""
    parsed = F.from_json(document, "map<string,string>")
    rest = F.map_filter(parsed, lambda k, _: k != key)
    return F.when(F.trim(document).startswith("{") & parsed.isNotNull(), F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))).otherwise(document)


def relative(given: Column, base: Column) -> Column:
    """A coordinate as a number, or ``~`` with an offset from a base."""
    offset = F.when(given == "~", F.lit(0)).otherwise(F.substring(given, 2, 20).try_cast("int"))
    return F.when(F.startswith(given, F.lit("~")), base + offset).otherwise(given.try_cast("int"))
