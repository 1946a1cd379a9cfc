"""Rules of single operators that small cases decide: letters, huge vectors, blank texts, short and long lines, clashing columns."""

import itertools
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, decontamination, language, line_dedup, neighbours, quality, toxicity


def test_numerals_are_no_letters(spark):
    texts = ["\u00bd \u00b2 \u2167 12", "", None, "\u2460\u2461 7", "ein Wort", "\u0e01\u0e32\u0e23", "_ -", "\u00b2a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("__p", F.lit("own"))
    for r in language.identify(df, {"de": b"ein wort und noch eines " * 20, "en": b"a word and one more " * 20}).collect():
        lettered = any(unicodedata.category(c).startswith("L") for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and r["__p"] == "own" and (lettered or r.score == 0.0)


def near(spark, rows, queries):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(df, F.col("id").isin(queries)).collect()}


def test_huge_and_tiny_vectors_keep_their_distances(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [3e200, 0.0]), (3, [-1e308, 1e308]), (4, [2.0, 1.0]), (5, [5e200, 5e200])]
    got = near(spark, rows, [0])
    assert [got[0, k][0] for k in range(1, 6)] == [1, 4, 2, 5, 3] or [got[0, k][0] for k in range(1, 3)] == [1, 4]
    assert got[0, 1] == (1, 1.0) and len(got) == 5 and abs(got[0, 2][1] / 1e200 - 1) < 1e-12
    got = near(spark, [(k, [k * 1e-170, 1e-200]) for k in range(6)], [0])
    assert [got[0, k][0] for k in range(1, 6)] == [1, 2, 3, 4, 5] and abs(got[0, 1][1] / 1e-170 - 1) < 1e-12


def test_few_of_many_parts_find_the_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24)) * 3
    v = centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.4, (3000, 24))
    searched = []
    found = neighbours.probes_for
    monkeypatch.setattr(neighbours, "probes_for", lambda router, *a: searched.append((router.w[3].shape[0], found(router, *a))) or searched[-1][1])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 50):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 600 and searched[0][0] > 4 and searched[0][1] <= searched[0][0] / 2


def test_blank_texts_have_no_say_in_a_site(spark):
    rows = [(i, "a", "good words here") for i in range(20)] + [(100 + i, "a", " \n") for i in range(30)] + [(200 + i, "b", "good words here") for i in range(20)] + [(300, "empty", None), (301, None, "good words")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality.score_quality(df, quality.DocumentClassifier(None, 0.9)).collect()}
    assert got[0].site_score == got[200].site_score and got[0].score == got[200].score > 0.8
    assert got[100].score == got[300].score == 0.0 and not got[100]["keep"] and got[301].score > 0.8


def test_many_sites_are_joined_without_a_broadcast_of_all(spark, monkeypatch):
    rows = [(i, f"h{i % 7}/p{i % 3}" if i % 2 else "hot", "good words here") for i in range(300)] + [(400, None, "words"), (401, "", "words")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    model = quality.DocumentClassifier(None, 0.7)
    want = {r.doc_id: (r.site_score, r.score) for r in quality.score_quality(df, model).collect()}
    monkeypatch.setattr(quality, "BROADCAST_SITES", 2)
    monkeypatch.setattr("corpusloom.llm.components.HOT_ROWS", 50)
    assert {r.doc_id: (r.site_score, r.score) for r in quality.score_quality(df, model).collect()} == want and len(want) == 302


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lines_of_any_length_when_the_minimum_is_one(spark):
    rng = np.random.default_rng(2)
    lines = ["".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(1, 14, 120)] + ["x", "xy", "qrstuvw", "short line aa", "short line ab", "", " "]
    text = [(i, "\n".join(x)) for i, x in enumerate(itertools.batched(lines, 9))]
    df = spark.createDataFrame(text, "doc_id long, text string")
    every = sorted({line_dedup.normal(x) for x in lines} - {""})
    top = {x: x for x in every}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(every, 2):
        if distance(a, b) <= 2:
            top[root(a)] = root(b)
    seen, want = set(), {}
    for i, t in text:
        want[i] = [k for k, x in enumerate(t.split("\n")) if (n := line_dedup.normal(x)) and (root(n) in seen or seen.add(root(n)))]
    got = {r.doc_id: sorted(x.line_no for x in r.dropped) for r in line_dedup.dedup_lines(df, min_exact=1, min_chars=1).collect()}
    assert got == want
    # By default such lines stay, unless they are equal and long enough.
    assert sum(len(x) for x in want.values()) > sum(r.n_dropped for r in line_dedup.dedup_lines(df).collect())


def test_keys_of_a_very_long_line_are_bounded():
    assert [line_dedup.word_edits(n) for n in (7, 8, 48, 192, 768, 10**6)] == [0, 1, 2, 4, 8, 8]
    words = [f"w{i}" for i in range(200_000)]
    keys = line_dedup.line_keys(" ".join(words))
    assert len(keys) < 5_000
    other = " ".join([*words[:500], "changed", *words[501:]])
    assert {k for k, kind in keys if kind & 1} & {k for k, kind in line_dedup.line_keys(other) if kind & 2} and line_dedup.linked(" ".join(words), other)


@pytest.mark.parametrize("column", ["__m", "__e", "__n", "__p", "__x", "__raw", "__c", "__score", "__doc", "__text", "__data"])
def test_columns_of_any_name_come_back(spark, column):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "some words of a text", "own")], f"doc_id long, text string, `{column}` string")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(df, path, pattern)
    outs = [encoded, byte_bpe.decode(encoded, path), language.identify(df, {"en": b"words of a text " * 9}), toxicity.ToxicityModel({}, None, None, 0.25).score(df)]
    outs.append(decontamination.match_items(df, spark.createDataFrame([(1, "words of")], "item_id long, text string")))
    for out in outs:
        assert out.first()[column] == "own" and out.first().text == "some words of a text"
