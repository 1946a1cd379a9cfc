"""Joins of rows with one fact for each key, where some keys have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from so many rows on, or from a MOST_HOT-th of all rows, whichever is more: MOST_HOT keys at most are hot.
HOT_ROWS, MOST_HOT = 10_000, 50_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left joined with ``facts`` (key, count of its rows, ...); facts of hot keys are broadcast, so their rows aren't shuffled."""
    total = facts.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, -(-total // MOST_HOT))
    hot = F.broadcast(facts.where(F.col(count) >= least))
    cold = facts.where(F.col(count) < least)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))
