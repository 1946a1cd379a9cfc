from pyspark.sql import functions as F

from corpusloom.functions import python_text
from corpusloom.operators import claims as C
from corpusloom.operators import report as R


def test_report(spark):
    s = spark.createDataFrame([("r", 0, "s0", "A one.  B two.", ["c1", "c2"]), ("r", 1, "s1", " ", ["c9", "c9"]), ("r", 2, "s2", "C", [])], "report string, pos int, sentence_id string, text string, claim_ids array<string>")
    c = spark.createDataFrame([("c1", "A one."), ("c2", "B two.")], "claim_id string, text string")
    assert {(r.sentence_id, r.error) for r in R.citation_errors(s, c).collect()} == {("s1", "blank"), ("s1", "repeated"), ("s1", "unknown"), ("s2", "uncited")}
    assert {r.sentence_id: r.exact for r in R.exact_copies(s, c).collect()} == {"s0": True, "s1": False, "s2": False}
    k = spark.createDataFrame([("r", "s0"), ("r", "s0"), ("r", "s1"), ("r", "s7")], "report string, sentence_id string")
    assert {(r.sentence_id, r.reviews) for r in R.critique_errors(s, k).collect()} == {("s0", 2), ("s2", 0), ("s7", 1)}
    v = spark.createDataFrame([("r", 0, "s0", None, True, ["c1"]), ("r", 1, "s1", False, True, ["c9"]), ("r", 2, "s2", False, False, [])], "report string, pos int, sentence_id string, grounded boolean, relevant boolean, claim_ids array<string>")
    a = R.repair_action(v).first()
    assert (a.sentence_id, a.action) == ("s1", "rewrite_sentence")
    fix = spark.createDataFrame([("r", "s1", "reselect_claims", None, ["c2", "c1"]), ("r", "s2", "delete_sentence", None, None)], "report string, sentence_id string, action string, text string, claim_ids array<string>")
    assert [(r.sentence_id, r.text) for r in R.apply_repairs(s, fix, c).orderBy("pos").collect()] == [("s0", "A one.  B two."), ("s1", "B two. A one.")]
    t = spark.createDataFrame([("r", 1, 2, 5), ("r", 2, 3, 1), ("r", 3, 3, 1)], "report string, attempt int, x int, y int")
    assert R.best_attempt(t, ["x", "y"]).first().attempt == 2


def test_next_search(spark):
    t = spark.createDataFrame([("a", 1, "bm25", 5, False, 5), ("b", 1, "bm25", 5, False, 5), ("b", 2, "dense", 5, False, 5), ("c", 1, "dense", 5, True, 5)], "session string, ord int, method string, k int, relevant boolean, found int")
    assert {r.session: (r.method, r.k) for r in R.retrieval_choice(t).collect()} == {"a": ("dense", 5), "b": ("dense", 15), "c": ("dense", 5)}


def test_claims(spark):
    texts = ["Model A has 91.5% accuracy", "Model A has 90% accuracy", "Model Z has 1% accuracy", "Model A outperforms Model B on MAE", "Setup takes at most 2 hours", "Red has 3", "Sales fell", "no grammar here"]
    c = spark.createDataFrame(list(enumerate(texts)), "claim_id int, text string")
    cells = spark.createDataFrame([("model a", "Accuracy", 91.5, "percent"), ("Model B", "accuracy", 90.0, "percent"), ("model a", "MAE", 0.2, "number"), ("model b", "MAE", 0.3, "number")], "row string, column string, value double, unit string")
    s = spark.createDataFrame([(1, "Setup takes at most 120 minutes."), (2, "2 and 3 for blue and red, respectively."), (3, "Sales increased")], "source_id int, text string")
    out = C.dispatch(c, [C.check_cells(c, cells), C.check_preferences(c, cells), C.check_durations(c, s), C.check_parallel(c, s), C.check_directions(c, s)])
    got = {r.claim_id: r.verdict for r in out.collect()}
    n = "not_enough_info"
    assert got == {0: "support", 1: "contradict", 2: n, 3: "support", 4: "support", 5: "support", 6: "contradict", 7: n}


def test_ambiguous_cells_abstain(spark):
    c = spark.createDataFrame([(1, "Model A has 5 wins")], "claim_id int, text string")
    cells = spark.createDataFrame([("model a", "wins", 5.0, "number"), ("Model A", "Wins", 6.0, "number")], "row string, column string, value double, unit string")
    assert C.check_cells(c, cells).count() == 0


def test_python_text(spark):
    df = spark.createDataFrame([("ﬁne  x", '{"b":1,"a":[1, 2]}'), (None, '{"a":1,"a":2}'), ("y", '{"a":NaN}')], "t string, j string")
    rows = df.select(python_text.nfkc(F.col("t")).alias("n"), python_text.canonical_json(F.col("j")).alias("j")).collect()
    assert [r.n for r in rows] == ["fine x", None, "y"] and [r.j for r in rows] == ['{"a":[1,2],"b":1}', None, None]
    v = spark.createDataFrame([("the quick brown fox", "so the quick browm fox ran"), ("absent words", "nothing here at all")], "s string, t string")
    assert [r.v for r in v.select(python_text.verbatim(F.col("s"), F.col("t"), coarse=False).alias("v")).collect()] == [True, False]
