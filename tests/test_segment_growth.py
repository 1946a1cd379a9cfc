"""What queries on segments must not work out, and words read the short way against those read the long one."""

import re

from pyspark.sql import functions as F

from corpusloom.functions import grammar as G
from corpusloom.operators import segments
from corpusloom.plans import segments as plans

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "The size of a set is 5.", "State‑of-the-art +3.5% (GPT-4), 1/2!", "a‑5 b-‐c x_y -7 −8", "ΑΣ'α ΟΔΟΣ. ΑΣ-ΑΣ", "İstanbul IŞIK ǅ", "！ ‿ ́ _", "中文 字 12,5 Ωm", "IT'S 1,200/3 a-b-C--D x1y", "\t\n"]


def test_key_words_are_those_of_all_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    for r in df.select("t", G.tokens(F.col("t")).alias("all"), G.key_tokens(F.col("t")).alias("keys")).collect():
        assert r.keys == (None if r.t is None else [x for x in r.all if any(map(str.isalnum, x)) and x not in G.FUNCTION_WORDS]), r.t


def test_rank_reads_plain_segments_by_the_plain_pattern(spark):
    s = spark.createDataFrame([(1, n, t) for n, t in enumerate(["ΟΔΟΣ eins.", "the Eins of it", "Zwei ΟΔΟΣ eins", "!"], 1)], "doc_id int, n int, text string")
    df = segments.rank_by_terms(s, s.where("n = 1").select("doc_id", F.col("text").alias("claim")))
    assert [tuple(r) for r in df.orderBy("rank").collect()] == [(1, 1, 2, 1), (1, 3, 2, 2), (1, 2, 1, 3), (1, 4, 0, 4)]
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert G.PLAIN_WORD_TOKEN in text and text.count("RLIKE") == 1  # the claim's alone


def written(spark, monkeypatch, query):
    seen, plain = [], plans.materialize
    monkeypatch.setattr(plans, "materialize", lambda df, name="t": (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, name))[1])
    query(spark, SF)
    return seen


def test_offsets_and_paragraphs_are_not_worked_out_for_ranks(spark, monkeypatch):
    for query in (plans.segment_rank, plans.ledger_window):
        (text,) = written(spark, monkeypatch, query)
        assert len(re.findall(r"\bWindow \[", text)) == 1 and "sum(" not in text


def test_segments_are_put_in_order_once(spark):
    df = segments.source_segments(spark.createDataFrame([(1, "a. b\n\nc.  \n\n d"), (2, " x. y\x85")], "doc_id int, text string"))
    assert [tuple(r) for r in df.orderBy("doc_id", "n").collect()] == [(1, 1, 0, 2, "a.", 0, 0), (1, 2, 3, 4, "b", 0, 0), (1, 3, 6, 8, "c.", 2, 1), (1, 4, 13, 14, "d", 2, 2), (2, 1, 1, 3, "x.", 0, 0), (2, 2, 4, 5, "y", 0, 0)]
    assert len(re.findall(r"\bSort \[", df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString())) <= 1


def test_blanks_are_those_of_the_pattern(spark):
    every = spark.range(1, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    found = {r.c for r in every.where(F.col("c").rlike(r"(?U)\s")).collect()}
    assert found == set(segments.BLANKS)


def test_a_window_takes_the_best_ranks_alone(spark):
    """Each text's best segments are enough; the others aren't aggregated."""
    s = spark.createDataFrame([(i, n, f"w{n % (i + 2)} w{n % 3}") for i in range(4) for n in range(1, 21)], "doc_id int, n int, text string")
    claims, picked = s.where("n = 3").select("doc_id", F.col("text").alias("claim")), s.where("n in (5, 9) and doc_id < 3").select("doc_id", "n")
    df = segments.ledger_window(s, claims, picked, most=6)
    rank = {(r.doc_id, r.n): r.rank for r in segments.rank_by_terms(s, claims).collect()}
    level = lambda i, n: (0, n) if i < 3 and n in (5, 9) else (1, n) if i < 3 and n in (4, 8) else (2, rank[i, n])
    assert sorted(map(tuple, df.collect())) == [(i, n) for i in range(4) for n in sorted(sorted(range(1, 21), key=lambda n: level(i, n))[:6])]
    assert "WindowGroupLimit [doc_id" in (text := df._jdf.queryExecution().optimizedPlan().toString()) and text.count("WindowGroupLimit") == 2
