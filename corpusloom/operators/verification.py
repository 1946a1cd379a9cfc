"""Deterministic checks of numbers and tables: true, false or null where the source doesn't decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Factors of number suffixes.
SCALES = {"": 1, "k": 1_000, "m": 1_000_000, "b": 1_000_000_000}


def compare_bounds(lo: Column, hi: Column, seen_lo: Column, seen_hi: Column) -> Column:
    """Whether an observed interval lies in the asked one (true), outside it (false), or partly (null)."""
    return F.when((seen_lo >= lo) & (seen_hi <= hi), True).when((seen_hi < lo) | (seen_lo > hi), False)


def scaled_number(text: Column) -> Column:
    """(value, unit) of a cell such as 3.5k, 12% or 2M; null value where there is no number alone."""
    pattern = r"^\s*([+-]?\d+(?:\.\d+)?)\s*([kKmMbB%]?)\s*$"
    number, mark = F.regexp_extract(text, pattern, 1), F.lower(F.regexp_extract(text, pattern, 2))
    scale = F.create_map(*[F.lit(x) for k, v in SCALES.items() for x in (k, v)])
    factor = F.when(mark == "%", F.lit(1)).otherwise(scale[mark])
    return F.struct(F.when(number != "", number.cast("decimal(18,6)") * factor).cast("double").alias("value"), F.when(mark == "%", "percent").otherwise("number").alias("unit"))


def direction(now: Column, before: Column) -> Column:
    return F.when(before.isNull() | now.isNull(), F.lit(None)).when(now > before, "increase").when(now < before, "decrease").otherwise("unchanged")


def unique_leader(rows: DataFrame, group: list[str], value: str, member: str) -> DataFrame:
    """Each group's one member of the largest value; shared leads give none."""
    ranked = rows.withColumn("r", F.rank().over(Window.partitionBy(*group).orderBy(F.desc(value)))).where("r = 1")
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), F.min(member).alias(member), F.max(value).alias(value)).where("n = 1").drop("n")


def population_truth(members: DataFrame, population: DataFrame, group: str, member: str, truth: str) -> DataFrame:
    """ALL, SOME and NONE over a closed population: members without a finding leave ALL and NONE open, unless decided.

    Findings of a member that disagree count as none.
    """
    per = members.groupBy(group, member).agg(F.when(F.min(truth) == F.max(truth), F.min(truth)).alias("t"))
    j = population.join(per, [group, member], "left").groupBy(group).agg(
        F.count("*").alias("members"), F.count("t").alias("known"), F.count_if(F.col("t")).alias("yes"), F.count_if(~F.col("t")).alias("no")
    )
    closed = F.col("known") == F.col("members")
    return j.select(
        group, "members", "known",
        F.when(F.col("no") > 0, False).when(closed, True).alias("all_true"),
        F.when(F.col("yes") > 0, True).when(closed, False).alias("some_true"),
        F.when(F.col("yes") > 0, False).when(closed, True).alias("none_true"),
    )
