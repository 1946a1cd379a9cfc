"""Examples, reviews and text helpers on small cases."""

from pyspark.sql import functions as F

from corpusloom.functions import grammar as G
from corpusloom.functions import python_text as T
from corpusloom.operators import examples as E


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_examples_of_annotated_claims(spark):
    corpus = spark.createDataFrame([("d1", " T ", ["One. ", "Two."]), ("d2", "U", ["Three."]), ("d3", "V", [])], "doc_id string, title string, abstract array<string>")
    rows = [(1, "c1", ["d1", "d2", "d9"], "d1", "support", [1], 0), (1, "c1", ["d1"], "d1", "SUPPORT ", [0, 1], 1), (1, "c1", [], "d1", "contradict", [5], 2), (2, "c2", ["d2"], "d9", "support", [0], 3), (2, "c2", ["d3"], "", "", [], 4), (3, "c3", ["d2"], "d2", "maybe", [0], 5)]
    claims = spark.createDataFrame(rows, "claim_id int, claim string, cited array<string>, doc_id string, label string, indices array<int>, line int")
    out = {r.example_id: r for r in E.build_examples(corpus, claims).collect()}
    assert sorted(out) == ["1:d1:0", "1:d1:1", "1:d2:nei", "2:d2:nei", "2:d3:nei"]
    assert out["1:d1:1"].sentences == ["One. ", "Two."] and out["1:d1:0"].context == "Title: T\nAbstract:\n[0] One.\n[1] Two." and out["2:d3:nei"].label == "not_enough_info"


def test_reviews_and_reports(spark):
    claims = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1), ("t", 2)], "session string, claim_id int")
    refs = spark.createDataFrame([("s", "a"), ("t", "a"), ("t", "b"), ("t", "c")], "session string, ref_id string")
    m = [tuple(r) for r in E.review_matrix(claims, refs, 4).orderBy("session", "at").collect()]
    assert m == [("s", 1, "a", 1), ("s", 2, "a", 2), ("t", None, None, None)]
    rows = [(1, "b", "support", 0.9, "ok"), (1, "a", "support", 0.9, "ok"), (2, "a", "support", 0.9, "ok"), (2, "b", "contradict", 0.1, "ok"), (3, "a", "support", 0.9, "ok"), (3, "b", "support", 0.9, "failed"), (4, "a", "support", 1.2, "ok"), (4, "b", "not_enough_info", 0.9, "ok")]
    r = {x.claim_id: (x.accepted, x.ref_id, x.reason) for x in E.accept_claims(spark.createDataFrame(rows, "claim_id int, ref_id string, label string, score double, status string"), 0.8, ["claim_id"]).collect()}
    assert r == {1: (True, "a", None), 2: (False, None, "conflict"), 3: (False, None, "review_failed"), 4: (False, None, "no_support")}
    p = E.prepared_report(spark.createDataFrame([("x", 5, 2), ("x", 50, 9), ("y", 60, 1)], "task string, tokens int, supervised int"), 10)
    assert sorted(tuple(x) for x in p.collect()) == [("x", 1, 1, 5, 2, 5), ("y", 0, 1, 0, 0, None)]
    o = spark.createDataFrame([("p", "a", True), ("p", "a", False), ("p", "b", True), ("q", "c", None)], "p string, m string, t boolean")
    assert {x.p: (x.all_true, x.none_true) for x in E.unanimous(o, ["p"], "m", "t").collect()} == {"p": (True, False), "q": (None, None)}
    t = spark.createDataFrame([("f1", "see 1234.56789v2 and 1234.56789"), ("f2", "1234.56789v1; 1111.22222")], "name string, text string")
    assert {x.paper_id: x.names for x in E.paper_ids(t, r"\d{4}\.\d{5}(?:v\d+)?").collect()} == {"1234.56789": ["f1", "f2"], "1111.22222": ["f2"]}


def test_text_helpers(spark):
    assert sorted(one(spark, G.evidence_numbers(F.lit("Table 3 has 1,200 rows, 5 % of section 2.1 and 7.5; Table 4 % x9")))) == ["1200", "4%", "5%", "7.5"]
    assert [one(spark, G.quantifier(F.lit(t))) for t in ("All of them", "no row", "at least one", "a row", "all or none")] == ["all", "none", "some", "atomic", None]
    assert one(spark, G.split_claims(F.lit("- One is 3.5 big. Two is.\n- Three\n2) Four. and five"))) == ["One is 3.5 big.", "Two is.", "Three", "Four. and five"]
    assert [one(spark, G.clean_json(F.lit(t))) for t in ('x ```json\n{"a": 1}\n``` y', 'so {"a": {"b": 2}} end', " none ")] == ['{"a": 1}', '{"a": {"b": 2}}', "none"]
    assert one(spark, G.joined_lines(F.lit("a hyphen-\n ated  word-\nX"))) == "a hyphenated word- X"
    units = [("models", "large language models", True), ("language models", "models", False), ("seconds", "long seconds", False), ("seconds", "seconds", True), ("model", "model", False), ("big models", "models big", False)]
    assert [one(spark, G.compatible_units(F.lit(a), F.lit(b))) for a, b, _ in units] == [c for *_, c in units]
    assert [one(spark, T.first_object(F.lit(t))) for t in ('```json\n{"a": [1]}\n```', 'x {"b": 2} {"c": 3}', "{bad", "none")] == ['{"a": [1]}', '{"b": 2}', None, None]
    assert one(spark, T.leaf_strings(F.lit('{"a": ["x", {"b": "y"}], "c": 3, "d": "z"}'))) == ["x", "y", "z"] and one(spark, T.leaf_strings(F.lit("{"))) is None
