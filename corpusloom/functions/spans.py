"""Spans of texts with character offsets: tokens, quantities, phrases and the places of quotes. Null text gives null.

Spark's own functions give matches but not where they are, so these go through Arrow; a text is one value, in a task with
others. Offsets count characters from 0, ends are exclusive, and a span equals its slice of the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.grammar import CARDINALS, NUMBER, TOKEN

#: Words after a number that are no unit, what isn't counted, marks that may end a phrase, and its bounds.
NO_UNIT = "before after to and on in at for with than or".split()
UNCOUNTED = r"\b(?:at least one|one or more)\b"
PHRASE_END = "%)]\"'’"
PHRASE_TOKENS, PHRASE_CHARS = 16, 160
#: Letters that are set as one in print.
LIGATURES = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"})
_TOKEN = re.compile(TOKEN.removeprefix("(?U)"))
_DIGITS = re.compile(rf"(?i)(?<![\w.]){NUMBER}(?:\s*(?:%|percent\b))?(?!\w|\.\d)")
_WORDS = re.compile(rf"(?i)\b(?:{'|'.join(CARDINALS)})\b")
_UNIT = re.compile(r"\s+([A-Za-z]+)\b")
SPAN = "start:int,end:int"


def _plain(literal: str) -> str:
    """A decimal literal in the one spelling that ``grammar.canonical`` gives."""
    digits = literal.replace(",", "").lstrip("+")
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    whole, _, rest = digits.partition(".")
    out = (whole.lstrip("0") or "0") + (f".{rest.rstrip('0')}" if rest.rstrip("0") else "")
    return out if out == "0" else sign + out


def _tokens(text: str) -> list[dict]:
    return [{"start": m.start(), "end": m.end(), "token": m[0]} for m in _TOKEN.finditer(text)]


def _quantities(text: str) -> list[dict]:
    skipped = [m.span() for m in re.finditer(UNCOUNTED, text, re.I)]
    out = []
    for m in sorted([*_DIGITS.finditer(text), *_WORDS.finditer(text)], key=lambda m: m.start()):
        if any(a <= m.start() < b for a, b in skipped):
            continue
        word, end = m[0].casefold(), m.end()
        percent = "%" if "%" in word else "percent" if "percent" in word else ""
        unit = percent
        if not percent and (tail := _UNIT.match(text, end)) and tail[1].casefold() not in NO_UNIT:
            unit, end = tail[1], tail.end()
        value = str(CARDINALS.index(word)) if word in CARDINALS else _plain(re.sub(r"\s*(?:%|percent)$", "", word))
        out.append({"start": m.start(), "end": end, "quote": text[m.start() : end], "value": value, "unit": unit, "kind": "percent" if percent else "number"})
    return out


def _phrases(text: str, most_tokens: int, most_chars: int) -> list[dict]:
    found = list(_TOKEN.finditer(text))
    out = []
    for i, first in enumerate(found):
        if not any(map(str.isalnum, first[0])):
            continue
        for last in found[i : i + most_tokens]:
            if last.end() - first.start() > most_chars:
                break
            if any(map(str.isalnum, last[0])) or last[0] in PHRASE_END:
                out.append({"start": first.start(), "end": last.end()})
    return out


def _places(quotes: list[str], text: str) -> list[list[int]]:
    """Where each quote starts in the text, overlapping places too, by one pass for all quotes."""
    import ahocorasick

    trie = ahocorasick.Automaton()
    for q in set(quotes):
        if q:
            trie.add_word(q, q)
    found: dict[str, list[int]] = {}
    if len(trie):
        trie.make_automaton()
        for end, q in trie.iter(text):
            found.setdefault(q, []).append(end + 1 - len(q))
    return [found.get(q, []) for q in quotes]


def _slice(quote: str, text: str) -> dict | None:
    """Where a quote stands in a text, but for blanks and ligatures; whole ligatures only."""
    at = text.find(quote)
    if at >= 0 and quote.strip():
        return {"start": at, "end": at + len(quote), "slice": quote}
    wanted = " ".join(quote.translate(LIGATURES).split())
    if not wanted:
        return None
    # Words with the places of their letters; what a blank run was is forgotten.
    letters, places = [], []
    for i, c in enumerate(text):
        for x in (" " if c.isspace() else c.translate(LIGATURES)):
            if x != " " or (letters and letters[-1] != " "):
                letters.append(x)
                places.append(i)
    flat = "".join(letters)
    at = flat.find(wanted)
    while at >= 0:
        start, end = places[at], places[at + len(wanted) - 1] + 1
        if " ".join(text[start:end].translate(LIGATURES).split()) == wanted:
            return {"start": start, "end": end, "slice": text[start:end]}
        at = flat.find(wanted, at + 1)
    return None


def source_slice(quote: Column, text: Column) -> Column:
    """(start, end, slice): the original words of a text that a quote copies, blanks and ligatures apart; null where it has none.

    Case, marks and numbers must be the quote's. The first place counts, an exact one before others.
    """

    @F.pandas_udf(f"struct<{SPAN},slice:string>")
    def slices(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [None if q is None or t is None else _slice(q, t) for q, t in zip(quotes, texts)]
        out = pd.DataFrame([x or {"start": -1, "end": -1, "slice": None} for x in found], columns=["start", "end", "slice"])
        return out.astype({"start": "int32", "end": "int32", "slice": object})

    # Arrow carries no null struct from Python: a place that isn't there is null here.
    bound = F.transform(F.array(slices(quote, text)), lambda s: F.when(s["start"] >= 0, s))
    return F.get(bound, F.lit(0))


def token_spans(text: Column) -> Column:
    """(start, end, token) of each token, in order."""

    @F.pandas_udf(f"array<struct<{SPAN},token:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _tokens(t) for t in texts], dtype=object)

    return spans(text)


def quantity_spans(text: Column) -> Column:
    """(start, end, quote, value, unit, kind) of each quantity: digits or a number word up to twenty, and the unit right after it.

    value is a canonical spelling; kind is percent or number; a quote takes in its unit. Repeats stay.
    """

    @F.pandas_udf(f"array<struct<{SPAN},quote:string,value:string,unit:string,kind:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _quantities(t) for t in texts], dtype=object)

    return spans(text)


def phrase_spans(text: Column, most_tokens: int = PHRASE_TOKENS, most_chars: int = PHRASE_CHARS) -> Column:
    """(start, end) of every phrase of whole tokens: from one with a letter or digit to one with either or a closing mark."""

    @F.pandas_udf(f"array<struct<{SPAN}>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _phrases(t, most_tokens, most_chars) for t in texts], dtype=object)

    return spans(text)


def quote_places(quotes: Column, text: Column) -> Column:
    """For each quote of an array, the starts of all its places in the text (none for null and empty quotes)."""

    @F.pandas_udf("array<array<int>>")
    def places(many: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or t is None else _places([x or "" for x in q], t) for q, t in zip(many, texts)], dtype=object)

    return places(quotes, text)
