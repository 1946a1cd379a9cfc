"""Explicit numeric proofs, each form by its own sources, and what leaves a claim open."""

from corpusloom.operators import rules

NAMED = "The other corpus (called here 'Alpha News') is a set of 1,200 daily news."
CASES = [
    ("The Alpha News corpus contains 1200 texts.", [NAMED], "support", [0]),
    ("The Alpha News corpus contains 1201 articles.", ["Some text.", NAMED], "contradict", [1]),
    ("The Beta corpus contains 1200 texts.", [NAMED], None, None),
    ("The Aligned corpus contained 500 documents after filtering.", ["First we filter and clean the line-aligned corpus.", "After filtering, we got 9,000 sentences in 500 documents."], "support", [0, 1]),
    ("The Aligned corpus contained 501 documents after filtering.", ["First we filter the aligned corpus.", "After filtering, we got 9,000 sentences in 500 documents."], "contradict", [0, 1]),
    ("The Aligned corpus contained 500 documents after filtering.", ["After filtering, we got 9,000 sentences in 500 documents.", "First we filter the aligned corpus."], None, None),
    ("After filtering, the dataset contained 70 tweets for floods.", ["This filtering left us with 50 tweets for fires and 70 tweets for high water (floods) across all events."], "support", [0]),
    ("After filtering, the dataset contained 50 tweets about high water.", ["This filtering left us with 50 tweets for fires and 70 tweets for high water (floods)."], "contradict", [0]),
    ("The two-step method used 300 examples randomly selected from the dev dataset for tuning.", ["For the two-step method, we randomly picked 300 examples from the dev data set for tuning."], "support", [0]),
    ("The two-step method used 300 examples randomly selected from the dev dataset for tuning.", ["For the two-step method, we randomly picked 200 examples from the dev dataset as tuning examples."], "contradict", [0]),
    ("The lexicon covered 81.50% of all words in the Red dataset.", ["The lexicon covers 81.5% and 70% of all words in Red and Blue, respectively."], "support", [0]),
    ("The lexicon covered 81.5% of all words in the Blue dataset.", ["The lexicon covers 81.5% and 70% of all words in Red and Blue, respectively."], "contradict", [0]),
    ("With configuration parameters unchanged, training the parser on candidates lowered error from 9% to 7%.", ["We trained the parser on logical form candidates generated using the grammar, and found its error to drop to 7% (from 9%); all configuration parameters were left unchanged."], "support", [0]),
    ("With configuration parameters unchanged, training the parser on candidates raised error from 9% to 7%.", ["We trained the parser on candidates, and found its error to drop to 7% (from 9%); all configuring parameters were left unchanged."], None, None),
    ("The standard Skipgram negative-sampling distribution uses a smoothing exponent of 0.750.", ["What matters is the choice of noise distribution for negative sampling.", "Skipgram employs a smoothed unigram distribution with a power rate of 0.75 as the noise distribution."], "support", [0, 1]),
    ("The standard Skipgram negative-sampling distribution uses a smoothing exponent of 0.75.", ["Skipgram employs a smoothed unigram distribution with a power rate of 0.75 as the noise distribution."], None, None),
    ("The Alpha News corpus contains 1200 texts.", [NAMED, NAMED.replace("1,200", "1,300")], None, None),
    ("Nothing of these forms.", [NAMED], None, None),
]


def test_every_form(spark):
    claims = spark.createDataFrame([(k, k, c) for k, (c, *_) in enumerate(CASES)], "case_id int, claim_id int, text string")
    segments = spark.createDataFrame([(k, n, t) for k, (_, s, *_) in enumerate(CASES) for n, t in enumerate(s)], "case_id int, n int, text string")
    windows = spark.createDataFrame([(k, n, True) for k, (_, s, *_) in enumerate(CASES) for n in range(len(s))], "claim_id int, n int, selected boolean")
    df = rules.explicit_verdicts(claims, windows, segments)
    got = {r.claim_id: (r.label, r.citations) for r in df.collect()}
    assert got == {k: (label, ids) for k, (_, _, label, ids) in enumerate(CASES) if label}
    # Only the first form may be proved beside a selected segment.
    beside = {r.claim_id for r in rules.explicit_verdicts(claims, windows.selectExpr("claim_id", "n", "false as selected"), segments).collect()}
    assert beside == {0, 1}
    # One more rule is one more reading of the same rows.
    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    fewer, all_ = (rules.explicit_verdicts(claims, windows, segments, rules=some) for some in (rules.RULES[:2], rules.RULES))
    assert shuffles(fewer) == shuffles(all_)
