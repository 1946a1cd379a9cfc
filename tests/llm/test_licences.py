"""Operator 11 against plain scans for phrases, and on notices with changed words."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import licences as lc
from corpusloom.llm.decontamination import words_of

PHRASES = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def base_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_query_has_every_base_place(spark):
    df = lc.op11_licences(spark, "/root/testdata/sf0.001")
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")] == ["bigint"] * 5 + ["string"] * 2 + ["double"]
    docs = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    rows = df.collect()
    assert len(rows) == len(docs) and sum(r.n_base for r in rows)
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == base_of(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels.split(",") == sorted(set(r.labels.split(","))) and (r.score > 0) == bool(r.labels)


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in lc.scan_licences(df).collect()}


def test_matching_statistics_equal_brute_force():
    a = lc.automaton(lc.TEMPLATES, lc.PHRASES)
    passages = [words_of(t) for _, t in lc.TEMPLATES] + [words_of(t) for t, _ in lc.PHRASES]
    joined = [b" ".join([b"", *p, b""]) for p in passages]
    text = words_of("the software is provided as is under the terms of the gnu general public license and apache license version 2 0 the license you may not use this file with a fee xyz permission is granted to anyone")
    seen = {i: m for i, _, m in a.statistics(text) if m}
    for i in range(len(text)):
        longest = max((n for n in range(1, i + 2) if any(b" ".join([b"", *text[i + 1 - n : i + 1], b""]) in p for p in joined)), default=0)
        assert seen.get(i, 0) == longest


@pytest.mark.parametrize("label, text", lc.TEMPLATES)
def test_each_template_is_its_own_label(label, text):
    words = words_of("intro words " + text.upper() + " and some words after it")
    _, spans = lc.automaton(lc.TEMPLATES, lc.PHRASES).scan(words)
    assert [(s[0], s[1], s[4]) for s in spans] == [(label, 2, 1.0)]
    assert spans[0][2] == 2 + len(words_of(text))


def test_changed_and_missing_words_are_bridged_and_short_statements_must_be_whole(spark):
    mit = next(t for n, t in lc.TEMPLATES if n == "mit" and len(t) > 200)
    changed = mit.replace("software and associated documentation", "program plus its documentation").replace("persons", "people")
    half = mit[: len(mit) // 2]
    lesser = next(t for n, t in lc.TEMPLATES if n == "lgpl" and len(t) > 200)
    got = scanned(spark, [changed, half, "Licensed under the Apache License, Version 1.1", lesser, f"{changed}\n\nsome other words\n{lesser} {changed}", "Licensed under CC BY-NC 4.0."])
    assert [s.label for s in got[0].spans] == ["mit"] and 0.8 <= got[0].spans[0].coverage < 1 and got[0].n_base == 0 and got[0].score == got[0].spans[0].coverage
    assert got[1].spans == [] and got[1].score == 0.0
    assert got[2].spans == [] and got[2].base_labels == ["apache"] and got[2].score == 1.0
    assert [s.label for s in got[3].spans] == ["lgpl"]
    assert [s.label for s in got[4].spans] == ["mit", "lgpl", "mit"]
    assert [s.label for s in got[5].spans] == ["cc-by-nc"] and got[5].base_labels == ["cc-by"]


def test_odd_rows(spark):
    long = "word of the license " * 60_000 + "MIT license"
    rows = [(1, "MIT License mit-license"), (1, "MIT License mit-license"), (2, None), (3, ""), (None, "no licence"), (4, long), (5, "mit license " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_words", "spans", "score", "__doc", "__found", "first_word"):
        df = df.withColumn(c, F.lit("own"))
    out = lc.scan_licences(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 7 and (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 0, 2) and got[1]["__doc"] == got[1]["__found"] == "own"
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].spans, got[2].score) == (got[3].n_words, 0, None, [], 0.0) == (0, 0, None, [], 0.0)
    assert (got[4].n_words, got[4].n_base, got[4].first_word) == (240_002, 1, 240_000) and got[5].n_base == 9
    assert lc.scan_licences(df.limit(0)).count() == 0
