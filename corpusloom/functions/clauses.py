"""Clauses of claims and quotes, the scopes that restrict them, and the clauses that speak of a member. Null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where clauses end, months, opposed adjectives, and the forms of restrictions in time and to datasets.
CLAUSE_END = r"[.!?](?=\s|$)|;|\b(?:but|while|whereas)\b"
MONTHS = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b"
OPPOSITES = {"low": "high", "high": "low", "cold": "hot", "hot": "cold", "wet": "dry", "dry": "wet"}
TIMED = r"(?i)\b(?:after|before|during)\s+[^,.;]+?(?=\s+and\b|[,.;]|$)"
TIME_WORD = r"(?i)\b(?:after|before|during)\b"
DATASET = r"(?i)\b(?:on|using|under)\s+(?:(?!\band\b|\b(?:after|before|during)\b)[^,.;])*?\bdatasets?\b"
LEADING = r"(?i)^\s*(?:(?:after|before|during|on|using|under)\s+[^,.;]+,\s*)+"
MISSING = (
    r"(?i)\b(?:not (?:reported|measured|evaluated|established|known|available)|unreported|unmeasured|unevaluated|unknown|"
    r"no (?:\w+[ -]){0,5}(?:results?|measurements?|data|evidence|baseline))\b"
)


def clauses(text: Column) -> Column:
    """The clauses of a text, without blanks and commas at their ends; empty ones are none."""
    return F.filter(F.transform(F.split(text, CLAUSE_END), lambda c: F.regexp_replace(c, r"^[ ,\s]+|[ ,\s]+$", "")), lambda c: c != "")


def literal(text: Column) -> Column:
    """A pattern for the text itself."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")


def contains_words(span: Column, text: Column) -> Column:
    """Whether a span stands in a text as whole words, whatever its case; an empty span doesn't."""
    return F.coalesce(F.length(span) > 0, F.lit(False)) & F.coalesce(F.regexp_count(text, F.concat(F.lit("(?iU)(?<!\\w)"), literal(span), F.lit("(?!\\w)"))) > 0, F.lit(False))


def scope_conflict(time: Column, condition: Column, text: Column) -> Column:
    """Whether a text speaks of other months than its restriction, or of the opposite condition alone (high- for low-)."""
    restriction = F.concat_ws(" ", F.coalesce(time, F.lit("")), F.coalesce(condition, F.lit("")))
    months = lambda t: F.regexp_extract_all(t, F.lit(MONTHS), F.lit(0))
    asked, seen = months(restriction), months(text)
    by_month = (F.size(asked) > 0) & (F.size(seen) > 0) & ~F.arrays_overlap(asked, seen)
    pairs = F.regexp_extract_all(F.lower(restriction), F.lit(rf"\b(?:{'|'.join(OPPOSITES)})-[a-z]+\b"), F.lit(0))
    other = F.create_map(*[F.lit(x) for pair in OPPOSITES.items() for x in pair])
    opposed = F.exists(pairs, lambda p: contains_words(F.concat(other[F.split_part(p, F.lit("-"), F.lit(1))], F.lit("-"), F.split_part(p, F.lit("-"), F.lit(2))), text) & ~contains_words(p, text))
    return F.coalesce(by_month | opposed, F.lit(False))


def owned_clauses(member: Column, quotes: Column) -> Column:
    """The clauses of an array of quotes that name a member."""
    return F.filter(F.flatten(F.transform(quotes, clauses)), lambda c: contains_words(member, c))


def scope_restrictions(text: Column) -> Column:
    """(time, condition): restrictions in time (cut where a dataset's begins) and to datasets, in order."""
    times = F.transform(F.regexp_extract_all(text, F.lit(TIMED), F.lit(0)), lambda t: F.rtrim(F.regexp_replace(t, f"{DATASET}.*$", "")))
    return F.struct(F.filter(times, lambda t: t != "").alias("time"), F.regexp_extract_all(text, F.lit(DATASET), F.lit(0)).alias("condition"))


def scope_clauses(claim: Column) -> Column:
    """(start, end, time, condition, source) of each part of a claim between its words "and"; null where scopes are nested or mixed.

    A restriction before the first comma holds for all parts, and stands before the later ones' source; others hold for their own
    part. More than one restriction of a kind in a part, or a word of time without one, isn't taken apart.
    """
    pieces = F.filter(F.split(claim, r"(?i)(?=\band\b)"), lambda p: p != "")
    lead = F.regexp_extract(claim, LEADING, 0)
    shared = scope_restrictions(lead)

    def part(piece: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda acc, p: acc + F.length(p))
        own = scope_restrictions(piece)
        both = lambda k: F.array_distinct(F.concat(shared[k], own[k]))
        loose = F.regexp_count(piece, F.lit(TIME_WORD)) > F.size(own["time"])
        return F.struct(start.alias("start"), (start + F.length(piece)).alias("end"), both("time").alias("time"), both("condition").alias("condition"), F.when(i > 0, F.concat(lead, piece)).otherwise(piece).alias("source"), loose.alias("loose"))

    parts = F.transform(pieces, part)
    fine = F.forall(parts, lambda p: (F.size(p["time"]) <= 1) & (F.size(p["condition"]) <= 1) & ~p["loose"])
    return F.when(fine, F.transform(parts, lambda p: F.struct(*[p[c].alias(c) for c in ("start", "end", "time", "condition", "source")])))
