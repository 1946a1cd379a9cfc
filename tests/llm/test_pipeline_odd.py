"""Stages on documents with extra and clashing columns, very long texts and repeated rows."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusloom.session import materialize, table

SF = "/root/testdata/sf0.001"


def test_extra_and_clashing_columns(spark):
    base = table(spark, SF, "documents")
    long = base.limit(1).select(F.lit(10_000_000).cast(base.schema["doc_id"].dataType).alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(120_000)), lambda i: F.concat(F.lit("word"), i.cast("string")))).alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(0).cast(base.schema["n_chars"].dataType).alias("n_chars"))
    docs = base.unionByName(long).unionByName(base.where("doc_id % 50 = 0"))
    for c in ("keep", "score", "n_hit", "hit_items", "node", "cls", "__doc", "dropped", "item_id", "t"):
        docs = docs.withColumn(c, F.concat(F.lit("own "), F.col("doc_id").cast("string")))
    docs = materialize(docs, "docs")
    columns, n = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() <= n
        assert docs.where(F.col("keep") != F.concat(F.lit("own "), F.col("doc_id").cast("string"))).count() == 0 and docs.where("keep <> `__doc`").count() == 0
        n = docs.count()
    assert docs.where("doc_id = 10000000 and text like '%word119999 word120000'").count() == 1
    assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    assert P.STAGES[-1][1](spark, docs, SF).count() == n
