"""Text functions as column expressions; null text gives null or an empty array, as built-ins do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased ASCII letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of ASCII blanks become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))


def shingles(words: Column, n: int) -> Column:
    """Distinct n-word shingles; none where there are fewer words (sequence() would count down)."""
    made = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before a blank; blank pieces are dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), squeeze), lambda s: s != "")


def ratio(part: Column, whole: Column) -> Column:
    """0.0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body, or a loop in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` by a generator, in a select of its own: filters on it are not moved below, where it would be computed again."""
    return F.explode_outer(F.array(value))
