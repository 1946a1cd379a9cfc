"""Claims against cells and statements: parse into typed columns, join on scope, require one match, compare.

Every check gives (claim_id, verdict) with support or contradict; claims that don't parse, or whose scope isn't matched by
exactly one source value, are left out: the check abstains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a time unit, and what words of direction mean.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
DIRECTIONS = {"increased": "increase", "rose": "increase", "grew": "increase", "decreased": "decrease", "fell": "decrease", "dropped": "decrease", "unchanged": "unchanged"}
#: Measures of which less is better.
LOWER = ("mae", "rmse", "error", "loss", "perplexity", "latency")


def name(text: Column) -> Column:
    """Letters and digits in lower case, single blanks: what names are joined by."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def _verdict(agrees: Column) -> Column:
    return F.when(agrees, "support").otherwise("contradict")


def _unique(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows of keys with one distinct combination of values."""
    v = F.struct(*values)
    return rows.groupBy(key).agg(F.min(v).alias("v"), F.max(v).alias("w")).where("v <=> w").select(key, "v.*")


def check_cells(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """Claims "<row> has <number>[%] <column>" against (row, column, value, unit) cells."""
    p = r"(?i)^\s*(.+?) (?:has|had|reached|scored) ([0-9]+(?:\.[0-9]+)?)(%?)(?: of| in| on)? (.+?)\.?\s*$"
    c = claims.select("claim_id", name(F.regexp_extract("text", p, 1)).alias("row"), name(F.regexp_extract("text", p, 4)).alias("column"), F.try_to_number(F.regexp_extract("text", p, 2), F.lit("999999999999.999999")).alias("x"), F.when(F.regexp_extract("text", p, 3) == "%", "percent").otherwise("number").alias("unit"))
    s = cells.select(name(F.col("row")).alias("row"), name(F.col("column")).alias("column"), "unit", F.col("value").cast("decimal(18,6)").alias("value"))
    found = _unique(c.where("row <> ''").join(s, ["row", "column", "unit"]), "claim_id", "x", "value")
    return found.select("claim_id", _verdict(F.col("x") == F.col("value")).alias("verdict"))


def check_preferences(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """Claims "<row> outperforms <row> on <column>"; of error measures the smaller value is the better."""
    p = r"(?i)^\s*(.+?) (?:outperforms|beats|exceeds) (.+?) on (.+?)\.?\s*$"
    c = claims.select("claim_id", *[name(F.regexp_extract("text", p, k)).alias(n) for k, n in ((1, "one"), (2, "two"), (3, "column"))]).where("one <> ''")
    s = cells.select(name(F.col("row")).alias("row"), name(F.col("column")).alias("column"), "value")
    j = c.join(s.toDF("one", "column", "a"), ["one", "column"]).join(s.toDF("two", "column", "b"), ["two", "column"])
    j = _unique(j, "claim_id", "column", "a", "b")
    lower = F.exists(F.split("column", " "), lambda w: w.isin(*LOWER))
    return j.where("a <> b").select("claim_id", _verdict(F.when(lower, F.col("a") < F.col("b")).otherwise(F.col("a") > F.col("b"))).alias("verdict"))


def check_durations(claims: DataFrame, statements: DataFrame) -> DataFrame:
    """Claims and statements "<subject> takes at most <number> <unit>", units converted."""
    p = rf"(?i)^\s*(.+?) (?:takes|lasts|runs) at most ([0-9]+(?:\.[0-9]+)?) ({'|'.join(SECONDS)})s?\.?\s*$"
    unit = F.create_map(*[F.lit(x) for k, v in SECONDS.items() for x in (k, v)])

    def parsed(df: DataFrame, key: str, out: str) -> DataFrame:
        number = F.try_to_number(F.regexp_extract("text", p, 2), F.lit("999999999999.999999"))
        return df.select(key, name(F.regexp_extract("text", p, 1)).alias("subject"), (number * unit[F.lower(F.regexp_extract("text", p, 3))]).alias(out)).where("subject <> ''")

    j = _unique(parsed(claims, "claim_id", "a").join(parsed(statements, "source_id", "b"), "subject"), "claim_id", "a", "b")
    return j.select("claim_id", _verdict(F.col("a") == F.col("b")).alias("verdict"))


def check_parallel(claims: DataFrame, statements: DataFrame) -> DataFrame:
    """Claims "<name> has <value>" against "<values> for <names>, respectively", paired in order; unequal lists abstain."""
    p = r"(?i)^\s*(.+?) for (.+?),? respectively\.?\s*$"
    items = lambda k: F.filter(F.transform(F.split(F.regexp_extract("text", p, k), r"(?i)\s*(?:,\s*and\s+|,|\band\b)\s*"), lambda x: name(x)), lambda x: x != "")
    s = statements.select(items(1).alias("v"), items(2).alias("n")).where("size(v) = size(n) and size(v) > 1")
    s = s.select(F.explode(F.arrays_zip("v", "n")).alias("x")).select("x.n", F.col("x.v").alias("b"))
    q = r"(?i)^\s*(.+?) has (.+?)\.?\s*$"
    c = claims.select("claim_id", name(F.regexp_extract("text", q, 1)).alias("n"), name(F.regexp_extract("text", q, 2)).alias("a")).where("n <> ''")
    j = _unique(c.join(s, "n"), "claim_id", "a", "b")
    return j.select("claim_id", _verdict(F.col("a") == F.col("b")).alias("verdict"))


def check_directions(claims: DataFrame, statements: DataFrame) -> DataFrame:
    """Claims and statements "<subject> increased / fell / ..."; texts with words of several directions abstain."""
    words = F.create_map(*[F.lit(x) for k, v in DIRECTIONS.items() for x in (k, v)])
    p = rf"(?i)\b(?:{'|'.join(DIRECTIONS)})\b"

    def parsed(df: DataFrame, key: str, out: str) -> DataFrame:
        ways = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda w: words[F.lower(w)]))
        return df.select(key, name(F.element_at(F.split("text", p), 1)).alias("subject"), ways.alias("w")).where("size(w) = 1 and subject <> ''").select(key, "subject", F.col("w")[0].alias(out))

    j = _unique(parsed(claims, "claim_id", "a").join(parsed(statements, "source_id", "b"), "subject"), "claim_id", "a", "b")
    return j.select("claim_id", _verdict(F.col("a") == F.col("b")).alias("verdict"))


def dispatch(claims: DataFrame, verdicts: list[DataFrame]) -> DataFrame:
    """(claim_id, verdict, rule): the first check in the list that decides, else not_enough_info with a null rule."""
    every = None
    for k, v in enumerate(verdicts):
        part = v.select("claim_id", F.struct(F.lit(k).alias("rule"), "verdict").alias("r"))
        every = part if every is None else every.union(part)
    first = every.groupBy("claim_id").agg(F.min("r").alias("r"))
    return claims.select("claim_id").join(first, "claim_id", "left").select("claim_id", F.coalesce("r.verdict", F.lit("not_enough_info")).alias("verdict"), F.col("r.rule").alias("rule"))
