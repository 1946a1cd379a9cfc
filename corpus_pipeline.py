"""The training-data pipeline: five stages from ``documents`` to token digests, each written and read again.

1. quality: documents that the quality classifier rejects go.
2. line_dedup: near-duplicate lines stay where they occur first; documents that lose all their words to others go.
3. near_dedup: one document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays.
4. decontamination: spans that hold benchmark passages are cut; documents that are mostly such spans go.
5. encode: byte-level BPE; one row of digests for each document.

Empty and null texts have no evidence of quality and go with the first stage; an empty table passes every stage.

A stage's scratch tables are needed until its result has been written. They go when the next stage begins, whose documents are
then read from that result (if they still are read from the scratch tables themselves, these stay).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, decontamination, line_dedup, near_dedup, quality
from corpusloom.session import materialize, release, scratch, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stage that ran last.
_LEFT: list[DataFrame] = []


def _tidy(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _LEFT:
            read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
            if not any(p.rsplit("/", 1)[-1] in read for t in _LEFT for p in t._scratch):
                release(*(t for t in _LEFT if t.sparkSession.sparkContext is spark.sparkContext))
            _LEFT.clear()
        with written() as tables:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(tables)
        return out

    return run_stage


def _sized(df: DataFrame, like: DataFrame) -> DataFrame:
    """n_chars follows a text that has changed."""
    return df.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else df


@_tidy
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    # The operator's columns must not hide those of documents.
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "source", "text")
    return quality.score_quality(packed, model).where("keep").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


@_tidy
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The text goes along once.
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "doc_id", "text")
    found = line_dedup.dedup_lines(packed).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return _sized(found.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns]), docs)


@_tidy
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


@_tidy
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")), docs)


@_tidy
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("encode", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as kept:
            docs = materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
#: SQL expresses neither the classifier nor the joins; tests hold stages against brute force.
ORACLE_SQL = None
