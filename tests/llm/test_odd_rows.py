"""Repeated rows, very long texts, clashing columns and empty tables, for every operator on documents."""

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, decontamination, language, line_dedup, near_dedup, pii, quality, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASH = ("n_tokens", "n_hit", "score", "predicted", "ids", "decoded", "lang_pred", "keep", "n_lines", "dropped", "n_entities", "text_len", "__doc", "found", "gaps", "node", "__m")
LONG = " ".join(f"word{i} goes" for i in range(90_000)) + "\nA line of its own at the end of a very long text, mail a.b@mail.example.com"


def documents(spark):
    rows = [(1, "plain words in a row here"), (1, "plain words in a row here"), (2, LONG), (3, None), (None, "an id that isn't there"), (4, ""), (2, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    for c in CLASH:
        df = df.withColumn(c, F.lit("own"))
    return df


def apply(name, df):
    spark = df.sparkSession
    if name == "tokens":
        return token_counts.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model"))
    if name == "bytes":
        return byte_bpe.encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    if name == "decontamination":
        return decontamination.match_items(df, spark.createDataFrame([(1, "word5 goes word6 goes word7 goes word8 goes word9 goes")], "item_id long, text string"))
    if name == "quality":
        return quality.score_quality(df, quality.DocumentClassifier(None, 0.9))
    if name == "toxicity":
        return toxicity.ToxicityModel({}, None, None, 0.25).score(df)
    if name == "pii":
        return pii.surrogate_entities(df)
    if name == "language":
        return language.identify(df, {"en": b"word goes plain row here " * 30})
    if name == "lines":
        return line_dedup.dedup_lines(df)
    return near_dedup.near_duplicate_components(df)


@pytest.mark.parametrize("name", ["tokens", "bytes", "decontamination", "quality", "toxicity", "pii", "language", "lines", "near"])
def test_odd_rows(spark, name):
    df = documents(spark)
    out = apply(name, df)
    rows = out.collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == [-1, 1, 1, 2, 2, 3, 4]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0] == by[1][1] and by[2][0] == by[2][1]
    if name not in ("near",):
        assert all(r["text_len"] == "own" for r in rows)
    long, empty = by[2][0], by[3][0]
    if name == "bytes":
        assert bytes(long.decoded) == LONG.encode() and empty.n_tokens == 0
    if name == "decontamination":
        assert long.n_hit == 10 and long.n_words > 180_000 and empty.n_words == 0
    if name == "pii":
        assert long.n_entities == 1 and "a.b@" not in long.text and long.text.startswith("word0 goes word1 ") and empty.text is None
    if name == "quality":
        assert empty.score == 0.0 and long.text == LONG
    if name == "toxicity":
        assert all(r.score == 0.25 and r.predicted == 0 for r in rows)
    if name == "language":
        assert long.lang_pred == "en" and empty.lang_pred == "und"
    if name == "lines":
        assert long.n_dropped == 0 and long.text == LONG and empty.n_lines == 0
    if name == "near":
        assert long.n_shingles > 89_000 and long.component_id == 2 and empty.component_id == 3 and empty.n_shingles == 0
    none = apply(name, df.limit(0))
    assert none.columns == out.columns and none.count() == 0
