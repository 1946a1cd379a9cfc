"""What clauses say of members."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import assessment as A
from corpusloom.operators import populations

CASES = [
    ("accuracy", "Alpha increased accuracy", "", "", "Alpha improved accuracy", True), ("accuracy", "Alpha increased accuracy", "", "", "Alpha reduced accuracy", False), ("accuracy", "Alpha increased accuracy", "", "", "Alpha improved recall", None),
    ("accuracy", "Alpha increased accuracy", "", "", "Alpha did not improve accuracy", False), ("accuracy", "Alpha increased accuracy", "", "", "Alpha has not improved accuracy", None), ("accuracy", "accuracy was unchanged", "", "", "accuracy stayed the same", True),
    ("accuracy", "Alpha increased accuracy", "", "", "accuracy rose and speed fell", None), ("accuracy", "Alpha increased accuracy", "", "", "Alpha may have improved accuracy", None), ("accuracy", "Alpha increased accuracy", "in May", "", "in May accuracy improved", True),
    ("accuracy", "Alpha increased accuracy", "in May", "", "accuracy improved in June", None), ("accuracy", "Alpha increased accuracy", "", "under low-light", "accuracy fell at high-light", None), ("improved", "all stores improved", "", "", "Beta gained", True),
    ("leaked", "some stores leaked", "", "", "Beta leaked", True), ("leaked", "some stores leaked", "", "", "Beta had no leaks", False), ("recall", "it increased recall", "", "", "recalling more improved", True), ("accuracy", "Alpha increased accuracy", "", "", "accuracy was not reported", None),
]


def test_truth_of_a_predicate(spark):
    df = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(CASES)], "k int, m string, q string, t string, c string, x string")
    got = {r.k: r.v for r in df.select("k", A.predicate_truth(*[F.col(c) for c in "mqtcx"]).alias("v")).collect()}
    assert got == {k: c[5] for k, c in enumerate(CASES)}


@pytest.mark.parametrize(
    "member, quotes, truth, issue",
    [
        ("Alpha", ["Alpha improved accuracy while Beta lost accuracy."], "true", None), ("Beta", ["Alpha improved accuracy while Beta lost accuracy."], "true", "observation_polarity_mismatch"), ("Gamma", ["Alpha improved accuracy."], "true", "observation_evidence_unbound"),
        ("Alpha", ["In June Alpha improved accuracy."], "true", "observation_scope_mismatch"), ("Gamma", ["Alpha improved accuracy."], "unknown", None), ("Alpha", [], "false", "observation_evidence_unbound"), ("Alpha", ["Alpha was there."], "false", None),
    ],
)
def test_citations_fit_their_member(spark, member, quotes, truth, issue):
    df = spark.createDataFrame([(member, quotes, truth, "accuracy", "Alpha increased accuracy", "in May", "")], "member string, quotes array<string>, truth string, metric string, quote string, time string, condition string")
    assert A.citation_issues(df).first().issue == issue


def test_from_a_stated_population_to_its_quantifier(spark):
    texts = {1: "The stores were Alpha, Beta and Gamma. Alpha leaked; Beta leaked, but Gamma leaked.", 2: "The stores were Alpha, Beta and Gamma. Alpha leaked; Beta never leaked.", 3: "The stores were Alpha, Beta and Gamma. Alpha leaked.", 4: "The stores were Alpha and Beta. Alpha had no leaks; Beta did not leak."}
    quantifier = {1: "all", 2: "all", 3: "all", 4: "some"}
    contexts = spark.createDataFrame(list(texts.items()), "case_id int, text string")
    parts = spark.createDataFrame([(k, "stores", "", "", "leaked", "stores leaked") for k in texts], "case_id int, entity string, time string, condition string, metric string, quote string")
    stated = populations.stated_populations(parts, contexts)
    seen = A.member_truths(parts.select("case_id", "metric", "quote", "time", "condition"), stated)
    cases = spark.createDataFrame(list(quantifier.items()), "case_id int, quantifier string")
    assert {r.case_id: r.truth for r in populations.closed_truth(cases, stated, seen).collect()} == {1: True, 2: False, 3: None, 4: False}
