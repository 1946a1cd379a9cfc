import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import curation, evidence, metrics, retrieval, session, verification
from corpusloom.sources import readers
from corpusloom.streaming import events as streams


def test_bm25_repeats_ties_and_no_tokens(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "blue whale"), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox fox"), (2, "???"), (3, "zebra")], "item_id long, text string")
    rows = retrieval.bm25_topk(docs, asked, 5).orderBy("query", "rank").collect()
    assert [(r.query, r.doc, r["rank"]) for r in rows] == [(1, 1, 1), (1, 2, 2)]
    assert rows[0].score == rows[1].score


def test_bm25_negative_idf_match_stays(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert retrieval.bm25_topk(docs, asked, 5).count() == 3


def test_dense_excludes_itself_and_keeps_order(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = retrieval.dense_topk(v, v.where("vec_id = 1"), 2).orderBy("rank").collect()
    assert [(r.doc, r.score) for r in rows] == [(2, 1.0), (3, 0.0)]


def test_report_of_absent_label_and_last_bin(spark):
    rows = spark.createDataFrame([("support", "support", 1.0, True), ("contradict", None, None, False)], "gold string, predicted string, score double, correct boolean")
    rep = {r.label: r for r in metrics.classification_report(rows, ["support", "contradict", "not_enough_info"]).collect()}
    assert rep["support"].f1 == 1.0 and rep["not_enough_info"].f1 == 0.0 and rep["not_enough_info"].support == 0
    bins = metrics.reliability(rows, 10).orderBy("bin").collect()
    assert len(bins) == 10 and bins[9].n == 1 and bins[0].mean_score is None


def test_label_and(spark):
    rows = spark.createDataFrame([(1, "support"), (1, "support"), (2, "support"), (2, None), (3, "contradict"), (3, None)], "g int, label string")
    assert {r.g: r.label for r in metrics.label_and(rows, "g").collect()} == {1: "support", 2: "not_enough_info", 3: "contradict"}


def test_unequal_columns_raise(spark):
    df = spark.createDataFrame([(1, [1, 2], [3])], "id int, a array<int>, b array<int>")
    with pytest.raises(Exception, match="columns differ in length"):
        curation.zip_columns(df, ["a", "b"]).collect()


def test_pack_skips_misfits(spark):
    rows = spark.createDataFrame([("g", 0, 3), ("g", 1, 9), ("g", 2, 2)], "g string, pos int, size int")
    r = evidence.pack(rows, "g", "pos", "size", 6).first()
    assert r.kept == [0, 2] and r.used == 5


def test_span_in_text(spark):
    s = spark.createDataFrame([(1, "the quick Brown fox jumps over")], "item_id int, text string")
    d = spark.createDataFrame([(1, "so The quick\nbrown fox jumps overs"), (2, "quick brown fox jumps")], "doc_id int, text string")
    assert [r.doc_id for r in evidence.span_containment(s, d, "item_id", "doc_id").collect()] == [1]


def test_population_and_bounds(spark):
    pop = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, m int")
    found = spark.createDataFrame([("a", 1, True), ("b", 3, True), ("b", 3, False)], "g string, m int, t boolean")
    r = {x.g: x for x in verification.population_truth(found, pop, "g", "m", "t").collect()}
    assert (r["a"].all_true, r["a"].some_true, r["a"].none_true) == (None, True, False) and r["b"].known == 0
    x = spark.range(1).select(verification.compare_bounds(F.lit(1), F.lit(5), F.lit(0), F.lit(2)).alias("p"), verification.scaled_number(F.lit("3.5k")).alias("n"), verification.scaled_number(F.lit("n/a")).alias("z")).first()
    assert x.p is None and x.n.value == 3500.0 and x.z.value is None


def test_ready_and_budget(spark):
    t = spark.createDataFrame([("s", 1, True, None), ("s", 2, False, 1), ("s", 3, False, 2)], "s string, pos int, done boolean, needs int").withColumnsRenamed({"s": "sid"})
    assert session.ready_tasks(t, "sid", "pos", "done", "needs").first().pos == 2
    e = spark.createDataFrame([("u", 1, 5.0), ("u", 2, 6.0), ("u", 3, 1.0)], "u string, k int, cost double")
    assert [r.stop for r in session.enforce_budget(e, "u", ["k"], "cost", 2, 10.0).orderBy("k").collect()] == [None, "cost", "steps"]


def test_jsonl_and_routing(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('﻿{"doc_id":"1","text":"a"}\n\n{"doc_id":"2","doc_id":"3","text":"b"}\n', encoding="utf-8")
    rows = readers.read_jsonl_marked(spark, str(f), readers.CORPUS).collect()
    assert [r.bad is None for r in rows] == [True, False]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"doc_id":"1","text":"a"}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(bad), readers.CORPUS).collect()
    df = spark.createDataFrame([(1, None), (2, "short"), (3, None)], "id int, why string")
    assert readers.write_routed(df, "why", str(tmp_path / "ok"), str(tmp_path / "no")) == {"accepted": 2, "rejected": 1}
    assert spark.read.json(str(tmp_path / "no")).first().why == "short"


def test_papers_of_each_shape(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    paper = StructType([StructField("title", StringType()), StructField("full_text", StringType())])
    for name, value in {"map": {"x": {"title": "A"}}, "list": [{"title": "A"}], "one": {"title": "A", "full_text": "t"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        assert [r.title for r in readers.read_papers(spark, str(tmp_path / f"{name}.json"), paper).collect()] == ["A"]


def test_html_and_pipe_tables(spark):
    h = spark.createDataFrame([(1, "<h1>T</h1><script>var a='<p>x</p>'</script><p>one <b>two</b></p><ul><li>x</li></ul>")], "page_id int, html string")
    assert [(r.tag, r.text) for r in readers.html_blocks(h).orderBy("block_no").collect()] == [("h1", "T"), ("p", "one two"), ("li", "x")]
    d = spark.createDataFrame([(1, "t\n| a | b |\n|---|---|\n| 1 | 2 |\nx\n| a | a |\n| 1 | 2 |\ny\n| a | b |\n| 1 |")], "doc_id int, text string")
    assert [(r.header, r.cell) for r in readers.pipe_tables(d).orderBy("col_no").collect()] == [("a", "1"), ("b", "2")]


def test_index_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    readers.write_index(docs, str(tmp_path / "ix"))
    assert spark.read.json(str(tmp_path / "ix/manifest")).first().postings == 3
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streams.append(streams.windowed_actions(streams.read_events(spark, str(tmp_path / "in")), late="60 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    q = streams.append(streams.sessions(streams.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    q.awaitTermination()
    assert q.exception() is None


def test_span_containment_of_every_length(spark):
    from corpusloom.operators.evidence import span_containment

    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [" ".join(words), "xalpha  betax", "Beta\tgamma delta EPSILON zeta", "alphabet", "pre" + " ".join(words[2:8]) + "post", "", None, "alpha", "beta alpha gamma"]
    spans = [" ".join(words[i : i + n]) for n in range(1, 8) for i in (0, 1, 2) if i + n <= 8] + ["ph", "a b", "a  b c", "", None, "omega", "lpha beta gamma delta epsilon zet"]
    made = span_containment(spark.createDataFrame(list(enumerate(spans)), "i long, text string"), spark.createDataFrame(list(enumerate(texts)), "d long, text string"), "i", "d")
    plain = lambda t: " ".join(t.lower().split())
    want = {(i, d) for i, s in enumerate(spans) for d, t in enumerate(texts) if s is not None and t is not None and plain(s) in plain(t)}
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert span_containment(spark.createDataFrame([], "i long, text string"), spark.createDataFrame([], "d long, text string"), "i", "d").count() == 0
