"""Claims as whole statements, and their sources."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import contract

CASES = {
    "": "empty_claim", "Does it improve?": "question_not_claim", "12.5 %": "bare_quantity", "Large orders of Alpha.": "metric_or_relation_missing", "Were 5 items.": "entity_missing", "It was 5.": "entity_missing",
    "Alpha improved.": "predicate_incomplete", "Alpha failed.": None, "Alpha improved recall.": None, "Alpha, was 5.": "entity_missing", "Alpha rose, Beta has 5.": None, "Alpha has it.": "predicate_incomplete",
    "Mô hình sử dụng dữ liệu.": None, "Sử dụng dữ liệu.": "entity_missing", "Alpha uses 5": None, "x2 was good": None,
}


@pytest.fixture(scope="module")
def issues(spark):
    return {r.c: r.i for r in spark.createDataFrame([(c,) for c in CASES], "c string").select("c", contract.claim_issue(F.col("c")).alias("i")).collect()}


@pytest.mark.parametrize("claim", CASES)
def test_claims_are_whole_statements(issues, claim):
    assert issues[claim] == CASES[claim]


def test_claims_of_an_answer(spark):
    text = "Alpha reached 3.5, e.g. on dev. Beta failed; Gamma too.\n- One item was 5\n2) Two items were good"
    assert spark.range(1).select(contract.whole_claims(F.lit(text)).alias("x")).first().x == ["Alpha reached 3.5, e.g. on dev.", "Beta failed;", "Gamma too.", "One item was 5", "Two items were good"]
    df = spark.createDataFrame([(1, "Alpha has 5. Beta."), (2, None), (3, " "), (4, "Alpha has 5.")], "answer_id int, text string")
    assert sorted(tuple(r) for r in contract.answer_issues(df).collect()) == [(1, 1, "metric_or_relation_missing"), (2, 0, "empty_answer"), (3, 0, "empty_answer")]


def test_sources_are_there_and_hold_the_values(spark):
    units = [(1, "a", "Alpha has 1,200 rows and 5 % loss in Table 3."), (1, "b", "Beta has 7 rows."), (1, "c", "Gamma has 7 rows."), (2, "z", "x")]
    claims = [
        ("Alpha has 1200 rows.", ["a"], None, [], []), ("Alpha has 7 rows.", ["a"], "value_absent", ["7"], ["b", "c"]), ("Beta has 7 rows", ["b"], "unfinished_claim", [], []), ("Gamma has 7 rows.", ["c", "c"], "unknown_source", [], []),
        ("Beta has 7 rows!", ["b", "z"], "unknown_source", [], []), ("Beta has rows.", [], "unknown_source", [], []), ("Many rows.", ["a"], "indistinct_claim", [], []), ("Alpha has rows. Beta has rows.", ["a"], "indistinct_claim", [], []),
        ("Twice has rows.", ["a"], "indistinct_claim", [], []), ("Twice has rows.", ["b"], "indistinct_claim", [], []), ("Alpha has 5% loss and 9 rows.", ["a"], "value_absent", ["9"], []),
    ]
    df = spark.createDataFrame([(1, k, t, s) for k, (t, s, *_) in enumerate(claims)], "case_id int, at int, text string, source_ids array<string>")
    got = {r["at"]: (r.issue, r.missing, r.candidates) for r in contract.resolve_sources(df, spark.createDataFrame(units, "case_id int, source_id string, text string")).collect()}
    assert got == {k: tuple(c[2:]) for k, c in enumerate(claims)}
