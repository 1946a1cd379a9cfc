"""The pipeline stage by stage on the smallest tables, and on none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusloom.llm import decontamination, near_dedup
from corpusloom.session import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "near_dedup":
            again = near_dedup.near_duplicate_components(docs, percent=80)
            assert again.where("not kept").count() == 0
            assert docs.join(before, ["doc_id", "text"], "left_anti").count() == 0
        if name == "decontamination":
            assert decontamination.match_items(docs, table(spark, SF, "benchmark")).where("n_hit > 0").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    out = P.STAGES[-1][1](spark, docs, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == counts[-1]
    same = out.join(docs, "doc_id").where(F.col("decoded_sha256") != F.sha2(F.col("text").cast("binary"), 256)).count()
    assert same == 0


@pytest.mark.parametrize("rows", [0, 3])
def test_odd_documents(spark, rows):
    odd = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0)][:rows]
    docs = spark.createDataFrame(odd, table(spark, SF, "documents").schema)
    for _, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), "odd")
    assert docs.count() == 0
