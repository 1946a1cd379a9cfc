"""Typed sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

_S = StringType()
CORPUS = StructType([StructField("doc_id", _S, False), StructField("text", _S, False), StructField("source_id", _S), StructField("metadata", StructType([StructField("paper_id", _S), StructField("title", _S)]))])
QRELS = StructType([StructField("query_id", _S), StructField("query", _S), StructField("relevant_doc_ids", ArrayType(_S)), StructField("reference_answer", _S)])
PREDICTIONS = StructType([StructField("example_id", _S), StructField("gold_label", _S), StructField("predicted_label", _S), StructField("confidence_score", DoubleType()), StructField("status", _S)])


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """JSON lines under a schema; blank lines are dropped. strict: a bad line fails the read, else it is null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_jsonl_marked(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with a leading byte-order mark removed, and the bad ones in a column ``bad``."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    parsed = lines.select("line", F.from_json("line", schema).alias("r"), F.expr("try_parse_json(line)").isNull().alias("wrong"))
    return parsed.select("r.*", F.when(F.col("wrong"), F.col("line")).alias("bad"))


def read_papers(spark: SparkSession, path: str, paper: StructType) -> DataFrame:
    """Papers of a JSON document that is an object keyed by id, an array, or one paper; the shape decides."""
    from pyspark.sql.types import MapType

    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    one = F.get_json_object("v", "$.full_text").isNotNull()
    keyed = whole.where(F.col("v").startswith("{") & ~one).select(F.explode(F.from_json("v", MapType(_S, paper))).alias("id", "p"))
    listed = whole.where(F.col("v").startswith("[")).select(F.explode(F.from_json("v", ArrayType(paper))).alias("p"))
    single = whole.where(one).select(F.from_json("v", paper).alias("p"))
    return keyed.select("id", "p.*").unionByName(listed.unionByName(single).select(F.lit(None).cast("string").alias("id"), "p.*"), allowMissingColumns=True)


SCIFACT_CORPUS = "doc_id string, title string, abstract array<string>"
SCIFACT_CLAIMS = "id long, claim string, evidence_doc_id string, evidence_label string, evidence_sentences array<int>, cited_doc_ids array<string>"


def read_scifact(spark: SparkSession, corpus: str, claims: str) -> tuple[DataFrame, DataFrame]:
    """(corpus, claims) of annotated claims, JSON lines or Parquet by the path's end, as ``examples.build_examples`` takes them.

    Claims are flat: a row for each annotation, in their order; ids are trimmed texts, whatever they are in the files.
    """

    def read(path: str, schema: str) -> DataFrame:
        if not path.rstrip("/").endswith(".parquet"):
            return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        wanted = StructType.fromDDL(schema)
        found = spark.read.parquet(path)
        return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])

    docs = read(corpus, SCIFACT_CORPUS).select(F.trim("doc_id").alias("doc_id"), "title", "abstract")
    rows = read(claims, SCIFACT_CLAIMS).withColumn("line", F.monotonically_increasing_id())
    cited = F.transform(F.coalesce("cited_doc_ids", F.array().cast("array<string>")), F.trim)
    return docs, rows.select(F.col("id").alias("claim_id"), "claim", cited.alias("cited"), F.trim("evidence_doc_id").alias("doc_id"), F.col("evidence_label").alias("label"), F.coalesce("evidence_sentences", F.array().cast("array<int>")).alias("indices"), "line")


def write_jsonl(rows: DataFrame, folder: str, mode: str = "overwrite") -> int:
    """JSON lines in ``folder``, null fields too; the number of rows there, counted as lines of what was written."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(folder)
    return rows.sparkSession.read.text(folder).count()


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Parquet splits as one table with a column ``split``."""
    out = None
    for name, path in paths.items():
        part = spark.read.parquet(path).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no split is named")
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files, content read on executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, block_no, tag, text): headings, paragraphs, list items and cells of pages, markup removed, in order."""
    found = F.regexp_extract_all(F.regexp_replace(html_col, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", ""), F.lit(r"(?is)<(h[1-6]|p|li|td|th)\b[^>]*>.*?(?=</?(?:h[1-6]|p|li|td|th|ul|tr|table|div|article|body)\b)"), F.lit(0))
    rows = pages.select(id_col, F.posexplode(found).alias("block_no", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", " "), r"\s+", " "))
    return rows.select(id_col, "block_no", F.lower(F.regexp_extract("raw", r"^<(\w+)", 1)).alias("tag"), text.alias("text")).where("text <> ''")


def pipe_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, table_no, row_no, col_no, header, cell) of tables of |-lines; ragged ones and repeated headers are left out."""
    from pyspark.sql.window import Window

    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line")).where(F.trim("line").rlike(r"^\|.*\|$"))
    w = Window.partitionBy(id_col).orderBy("at")
    grouped = lines.withColumn("grp", F.col("at") - F.row_number().over(w))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = grouped.withColumn("cells", cells).where(~F.trim("line").rlike(r"^\|[\s:|\-]+\|$"))
    ranked = rows.withColumn("row_no", F.row_number().over(Window.partitionBy(id_col, "grp").orderBy("at")) - 1)
    heads = ranked.where("row_no = 0").select(id_col, "grp", F.col("cells").alias("head")).where(F.size(F.array_distinct("head")) == F.size("head"))
    body = ranked.where("row_no > 0").join(heads, [id_col, "grp"])
    ragged = body.where(F.size("cells") != F.size("head")).select(id_col, "grp").distinct()
    out = body.join(ragged, [id_col, "grp"], "left_anti").select(id_col, F.col("grp").alias("table_no"), "row_no", F.posexplode(F.arrays_zip("head", "cells")).alias("col_no", "x"))
    return out.select(id_col, "table_no", "row_no", "col_no", F.col("x.head").alias("header"), F.col("x.cells").alias("cell"))


def write_routed(rows: DataFrame, reason: str, accepted: str, rejected: str) -> dict[str, int]:
    """Accepted rows (null reason) and rejected ones to folders of their own, from one scan of a written table; their counts."""
    rows.withColumn("__part", F.when(F.col(reason).isNull(), "accepted").otherwise("rejected")).write.mode("errorifexists").partitionBy("__part").parquet(rejected + ".all")
    both = rows.sparkSession.read.parquet(rejected + ".all")
    both.where("__part = 'accepted'").drop("__part", reason).write.mode("errorifexists").json(accepted)
    both.where("__part = 'rejected'").drop("__part").write.mode("errorifexists").json(rejected)
    return {r["__part"]: r["count"] for r in both.groupBy("__part").count().collect()}


def _checksum(postings: DataFrame) -> tuple[int, int, int]:
    """(documents with a token, postings, sum of their hashes): equal for equal postings, in any order."""
    r = postings.agg(F.countDistinct("doc"), F.count("*"), F.sum(F.xxhash64("doc", "term", "tf").cast("decimal(38,0)"))).first()
    return r[0], r[1], int(r[2] or 0)


def write_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Postings (sorted by term), documents with their lengths, those without tokens too, and terms of a corpus with unique ids.

    A manifest with counts and a checksum is written last, so its absence marks a partial index. A folder that exists is an error.
    """
    from corpusloom.operators.curation import corpus_gate
    from corpusloom.operators.retrieval import postings

    gate = corpus_gate(docs, id_col, text_col).first()
    if gate.rows != gate.ids or gate.null_ids:
        raise ValueError("ids must be unique and not null")
    postings(docs, id_col, text_col).repartition("term").sortWithinPartitions("term", "doc").write.mode("errorifexists").parquet(f"{folder}/postings")
    saved = docs.sparkSession.read.parquet(f"{folder}/postings")
    lengths = saved.groupBy("doc").agg(F.sum("tf").alias("dl"))
    docs.select(F.col(id_col).alias("doc")).join(lengths, "doc", "left").select("doc", F.coalesce("dl", F.lit(0)).alias("dl")).write.mode("errorifexists").parquet(f"{folder}/documents")
    saved.groupBy("term").agg(F.count("*").alias("df")).write.mode("errorifexists").parquet(f"{folder}/terms")
    with_tokens, n, total = _checksum(saved)
    row = [(gate.rows, with_tokens, n, str(total))]
    docs.sparkSession.createDataFrame(row, "documents long, with_tokens long, postings long, checksum string").coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(postings, number of documents) of a written index, for ``retrieval.bm25_from_postings``; one that doesn't fit its manifest is an error."""
    m = spark.read.schema("documents long, with_tokens long, postings long, checksum string").json(f"{folder}/manifest").first()
    saved = spark.read.parquet(f"{folder}/postings")
    if m is None or (m.with_tokens, m.postings, int(m.checksum)) != _checksum(saved):
        raise ValueError("the index isn't whole")
    return saved, m.documents
