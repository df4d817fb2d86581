"""Text functions as Columns; Unicode classes are written out, since \\w differs between engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as code point ranges, in Java's notation.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NOT_WORD = rf"[^\p{{L}}\p{{N}}_{WS}]"
EDGES = rf"^[{WS}]+|[{WS}]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def normalize(text: Column) -> Column:
    """Lower case, without characters that are neither word nor white space, without white space at the ends."""
    return strip(F.regexp_replace(F.lower(text), NOT_WORD, ""))


def slug(text: Column) -> Column:
    """The id of a new entity: its normalised name with each ASCII space as an underscore."""
    return F.replace(normalize(text), F.lit(" "), F.lit("_"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), lambda w: w != ""))


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def contains_ignoring_case(query: str | None, *columns: Column) -> Column:
    """Literal substring of any of the columns; a null or empty query matches all."""
    if not query:
        return F.lit(True)
    return reduce(Column.__or__, [F.contains(F.lower(c), F.lower(F.lit(query))) for c in columns])


def fill(template: str, **values: Column) -> Column:
    """All occurrences of {name} replaced."""
    return reduce(lambda text, kv: F.replace(text, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), F.lit(template))


def numbered_lines(items: Column) -> Column:
    """An ordered array of strings as lines `1. "..."`."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit('. "'), x, F.lit('"'))), "\n")
