"""Text functions that no built-in equals, as small Arrow-batched helpers."""

from __future__ import annotations

import difflib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """NFKC normal form with blanks squeezed."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))

    return run(text)


def verbatim(span: Column, text: Column, threshold: float = 0.9, coarse: bool = True) -> Column:
    """Whether a span is in a text, exactly or in a window of its length of that similarity; windows move by a quarter or by one."""

    @F.pandas_udf("boolean")
    def run(spans: pd.Series, texts: pd.Series) -> pd.Series:
        def one(s: str | None, t: str | None) -> bool:
            if not s or not t:
                return False
            if s in t:
                return True
            n, step = len(s), max(1, len(s) // 4) if coarse else 1
            return any(difflib.SequenceMatcher(None, s, t[i : i + n]).ratio() >= threshold for i in range(0, max(1, len(t) - n + 1), step))

        return pd.Series([one(s, t) for s, t in zip(spans, texts)], dtype=bool)

    return run(span, text)


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys and no blanks; null where it doesn't parse, repeats a key or holds NaN."""

    def refuse(_: str):
        raise ValueError("not strict")

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(json.loads(t, object_pairs_hook=pairs, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return s.map(one)

    return run(text)


def first_object(text: Column) -> Column:
    """The first JSON object of a text, fenced or amid other text, as JSON; null where there is none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or (at := t.find("{")) < 0:
                return None
            try:
                value, _ = json.JSONDecoder().raw_decode(t[at:])
            except ValueError:
                return None
            return json.dumps(value, ensure_ascii=False)

        return s.map(one)

    return run(text)


def leaf_strings(text: Column) -> Column:
    """Every string value in a JSON text, however deep, in order; null where it doesn't parse."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            try:
                todo = [json.loads(t)] if t is not None else []
            except ValueError:
                return None
            out: list[str] = []
            while todo:
                v = todo.pop()
                if isinstance(v, str):
                    out.append(v)
                elif isinstance(v, (dict, list)):
                    todo += reversed(list(v.values()) if isinstance(v, dict) else v)
            return None if t is None else out

        return s.map(one)

    return run(text)
