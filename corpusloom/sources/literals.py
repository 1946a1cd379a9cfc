"""String values of source and data files: literals of Python syntax trees, and leaves of JSON, as rows for leakage screens."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators.curation import leakage_pairs

SCHEMA = "path string, file_sha256 string, at int, value string, issue string"
#: Words that a value needs to be compared.
LEAST_WORDS = 6


def _leaves(value) -> Iterator[str]:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, (dict, list)):
            todo += reversed(list(v.values()) if isinstance(v, dict) else v)


def _values(path: str, text: str) -> Iterator[str]:
    if path.endswith(".py"):
        found = (n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Constant) and isinstance(n.value, str))
        yield from (n.value for n in sorted(found, key=lambda n: (n.lineno, n.col_offset)))
    elif path.endswith(".jsonl"):
        for line in text.splitlines():
            if line.strip():
                yield from _leaves(json.loads(line))
    else:
        yield from _leaves(json.loads(text))


def read_strings(spark: SparkSession, path: str, pattern: str = "*.{py,json,jsonl}") -> DataFrame:
    """(path, file_sha256, at, value, issue): the strings of all files below ``path``, numbered in each file.

    A file that doesn't parse gives one row with a null value and the issue unparsed; nothing in it is run. Files are read and
    parsed on executors, one at a time.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in parts:
            for name, digest, content in zip(files["path"], files["file_sha256"], files["content"]):
                try:
                    own = [(name, digest, k, v.encode("utf-8", "replace").decode(), None) for k, v in enumerate(_values(name, bytes(content).decode("utf-8-sig")))]
                except (ValueError, SyntaxError, RecursionError):
                    own = [(name, digest, None, None, "unparsed")]
                out = pd.DataFrame(own, columns=["path", "file_sha256", "at", "value", "issue"])
                yield out.astype({"at": "Int32", "value": object, "issue": object})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("file_sha256"), "content").mapInPandas(rows, SCHEMA)


def screen_strings(strings: DataFrame, targets: DataFrame, target_id: str = "target_id") -> DataFrame:
    """(target_id, path, text_sha256, shared_grams, jaccard): strings of files that leak a target's text, by ``leakage_pairs``.

    A string counts once for each file, however often and wherever it is nested; those under LEAST_WORDS words aren't compared.
    """
    words = F.array_join(tokens(F.col("value")), " ")
    each = strings.where("value is not null").select("path", words.alias("w"), F.sha2("value", 256).alias("text_sha256")).where(F.size(F.split("w", " ")) >= LEAST_WORDS)
    once = each.groupBy("path", "w").agg(F.min("text_sha256").alias("text_sha256"))
    # Equal strings of many files are compared once.
    texts = once.select(F.md5("w").alias("string_id"), F.col("w").alias("text")).distinct()
    pairs = leakage_pairs(texts, targets.select(target_id, "text"), "string_id", target_id)
    return pairs.join(once.withColumn("string_id", F.md5("w")), "string_id").select(target_id, "path", "text_sha256", "shared_grams", "jaccard")


def blocked_targets(strings: DataFrame, targets: DataFrame, pattern: str, target_id: str = "target_id", paper: str = "paper_id") -> DataFrame:
    """(target_id, paper_id, path): targets whose paper a scanned string names, by ``pattern`` (a version at its end doesn't count)."""
    named = strings.where("value is not null").select("path", F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("id"))
    named = named.select("path", F.regexp_replace("id", r"v\d+$", "").alias(paper)).distinct()
    return targets.select(target_id, F.regexp_replace(paper, r"v\d+$", "").alias(paper)).join(named, paper).select(target_id, paper, "path").distinct()
