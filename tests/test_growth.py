"""Shapes of plans and results on which larger tables depend."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import grammar as G
from corpusloom.functions.text import let, once
from corpusloom.llm import components, near_dedup
from corpusloom.operators import cells, contract, operands, requirements, retrieval
from corpusloom.plans import claims, requirements as plans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_stated_populations_are_not_broadcast(spark):
    df = plans.member_quantifiers(spark, SF)
    assert "rightHint=(strategy=merge)" in plan(df) and "Broadcast" not in plan(df)


def test_values_are_computed_once(spark):
    df = spark.createDataFrame([(1, "a b")], "k int, t string")
    twice = let(F.upper("t"), lambda u: F.concat(u, F.lit("-"), u))
    assert df.select(twice.alias("x")).first()[0] == "A B-A B"
    assert plan(df.select(twice.alias("x")))[:2000].split("== ")[0].count("upper(") == plan(df.select(F.upper("t").alias("x"))).count("upper(")
    kept = df.select("k", once(F.regexp_extract("t", "(c?)", 1)).alias("x")).where("x is not null")
    assert df.select(F.regexp_extract("t", "(c?)", 1).alias("x")).where("x <> 'q'")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 2
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_a_claim_is_judged_once(spark):
    answers = spark.createDataFrame([(1, "Large orders of Alpha. Alpha improved recall.")], "answer_id int, text string")
    df = contract.answer_issues(answers)
    assert [tuple(r) for r in df.collect()] == [(1, 0, "metric_or_relation_missing")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("bare_quantity") == 1


def test_quantities_are_read_once(spark):
    df = claims.claim_quantities(spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("percent)") <= 1
    spelt = spark.createDataFrame([(x,) for x in ("0", "-0", "007", "1,200.50", "+3", "−4.0", "10", "-12", "0.0", "1 0")], "t string")
    assert [r[0] for r in spelt.select(G.canonical(F.col("t"))).collect()] == ["0", "0", "7", "1200.5", "3", "-4", "10", "-12", "0", "10"]


def test_equal_points_and_boxes_meet_once(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0)] * 50 + [(0, 9.0, 9.0), (1, 1.0, 1.0), (0, None, 1.0)], "page int, x double, y double")
    boxes = spark.createDataFrame([(0, i, 0.0, 0.0, 2.0, 2.0) for i in range(40)] + [(0, 40, 0.0, 0.0, 10.0, 10.0), (1, 41, 5.0, 5.0, 6.0, 6.0), (0, 42, None, 0.0, 3.0, 3.0)], "page int, box int, x0 double, y0 double, x1 double, y1 double")
    got = {r[0]: r[1] for r in cells.count_in_boxes(points, boxes, "page", "box").collect()}
    assert got == {**{i: 50 for i in range(40)}, 40: 51}


def test_gaps_sort_spans_once(spark):
    spans = spark.createDataFrame([(1, 3, 5), (1, 4, 8), (1, 8, 9), (1, 20, 30), (1, 6, 6), (2, -5, 50), (4, 0, 2)], "k int, start int, end int")
    whole = spark.createDataFrame([(1, 0, 10), (1, 12, 25), (2, 0, 9), (3, 1, 4), (4, 0, 2)], "k int, start int, end int")
    df = requirements.gaps(spans, whole, ["k"])
    assert sorted(map(tuple, df.collect())) == [(1, 0, 3), (1, 9, 10), (1, 12, 20), (3, 1, 4)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1


def test_cells_are_made_once(spark):
    text = plans.count_cells(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("arrays_zip") == 1


def test_cells_deal_words_and_blocks_once(spark, monkeypatch):
    """Words and blocks are shuffled once at most; pages of any size, however they meet, give the same cells."""
    assert plans.count_cells(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    rng, words, blocks = random.Random(7), [], []
    for page in [*range(60), None]:
        up = rng.choice([0.0, 0.0, 64.0])
        blocks += [(page, 0, "caption", 0.0, up, 300.0, up + 6, rng.choice(["Table 1: x", "Table 2a. y", "Figure 1"]))] * rng.choice([1, 1, 1, 1, 2])
        heads = [(10.0, 60.0, "Statistic"), (100.0, 120.0, "Train"), (200.0, 220.0, "TEST")]
        line = [(1, 20.0, heads)] + [(9, 22.0, heads)] * (rng.random() < 0.1)
        for k in range(2, 7):
            label = rng.choice(["All rows", "Words", "words", "A  b"]).split(" ")
            ws = [(10.0 + rng.choice([0, 0, 1, 3]) + 15 * i, 22.0 + 15 * i, w) for i, w in enumerate(label)]
            ws += [(100.0 + rng.choice([0, 0, 2, 9]), 120.0, rng.choice(["7", "1,200", "x", "12"])), (200.0, 220.0, str(rng.randint(0, 9)))]
            line.append((k, 30.0 + 8 * k + rng.choice([0, 0, 0, 40]), ws))
        at = 0
        for k, y, ws in line:
            text = rng.choice([" ", " ", "\n", "  "]).join(w for *_, w in ws)
            tall = 14.0 if k > 1 and rng.random() < 0.2 else 6.0
            blocks.append((page, k if rng.random() < 0.97 else None, "text", 0.0, y, 300.0, y + tall, text))
            for x0, x1, w in ws:
                words.append((page, at, x0 if rng.random() < 0.99 else None, y + rng.choice([0.0, 0.0, 0.0, 1.5]), x1, y + 6, w if rng.random() < 0.99 else None))
                at += 1
    words = spark.createDataFrame(words, "page int, at int, x0 double, y0 double, x1 double, y1 double, word string")
    blocks = spark.createDataFrame(blocks, "page int, block int, kind string, x0 double, y0 double, x1 double, y1 double, text string")
    got = {}
    for held in (1000, 28, 0):
        monkeypatch.setattr(cells, "HELD", held)
        got[held] = sorted(map(repr, cells.count_cells(words, blocks, "page").collect()))
    assert got[1000] == got[28] == got[0] and len(got[0]) > 30


def test_scores_bound_the_parts_of_a_search(spark):
    hits = spark.createDataFrame([(i, "w") for i in range(100)], "doc int, term string")
    assert retrieval.by_document(hits, 10 * retrieval.TASK_SCORES).rdd.getNumPartitions() == 10
    assert retrieval.by_document(hits, 0).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_overlapping_buckets_are_dealt_once(spark, monkeypatch):
    """Twelve buckets of mostly the same 160 unlinked nodes, and one of others: rows in blocks are those of the nodes, no pair is lost."""
    monkeypatch.setattr(components, "BLOCK", 40)
    rng = random.Random(5)
    buckets = {k: [i for i in range(160) if rng.random() < 0.6] for k in range(12)} | {50: list(range(1000, 1070)), 51: [2000, 2001, 2002]}
    members = spark.createDataFrame([(k, i, 3) for k, ids in buckets.items() for i in ids], "key long, node long, kind int")
    seen = []

    def links(dealt):
        seen.extend(dealt.collect())
        return spark.createDataFrame([(40, 150)], "a long, b long")

    comps = components.linked_classes(members, lambda pairs: pairs.where("a = 2000 and b = 2001"), links)
    assert {(r.node, r.comp) for r in comps.collect()} == {(150, 40), (40, 40), (2000, 2000), (2001, 2000)}
    assert len(seen) <= 160 * 4 + 70 * 2 + 3
    blocks = {}
    for r in seen:
        blocks.setdefault((r.key, r.part_a, r.part_b), {}).setdefault(r.part, set()).add(r.node)
    met = {frozenset(p) for (_, a, b), parts in blocks.items() for p in itertools.product(parts.get(a, ()), parts.get(b, ()))}
    assert all(frozenset(p) in met for ids in buckets.values() for p in itertools.combinations(ids, 2))


def test_buckets_that_share_little_stay_apart(spark, monkeypatch):
    """A chain of buckets that share a quarter of their nodes with the next would be more rows as one."""
    monkeypatch.setattr(components, "BLOCK", 100)
    rows = [(k, i) for k in range(8) for i in range(72 * k, 72 * k + 96 + k)]
    left = spark.createDataFrame([(k, i, 3, i, 96 + k) for k, i in rows], "key long, node long, kind int, comp long, n long")
    assert sorted((r.key, r.node) for r in components._merged(left).collect()) == rows


@pytest.mark.parametrize("finer", [1, 16])
def test_finer_buckets_find_the_links_of_a_merged_one(spark, monkeypatch, finer):
    """Pairs that share a common passage with all others, by finer buckets or by blocks alone."""
    monkeypatch.setattr(components, "BLOCK", 32)
    monkeypatch.setattr(components, "FINER", finer)
    rng, docs = random.Random(12), []
    for g in range(70):
        own = [f"g{g}w{k}" for k in range(110)]
        docs.append((2 * g, " ".join([f"c{i}" for i in range(90)] + own)))
        own[rng.randrange(110)] = "changed"
        docs.append((2 * g + 1, " ".join([f"c{i}" for i in range(90)] + own)))
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {i: i - i % 2 for i, _ in docs}


def test_operands_are_dealt_before_they_are_counted(spark):
    """Choices are one pass over operands that meet requirements once; what a map task reads isn't held in an aggregate."""
    text = plan(plans.operand_choices(spark, SF))
    assert "LeftAnti" not in text and "REPARTITION_BY_NUM" in text
    asked = spark.createDataFrame([(1, 0, "eq", 3, "kg"), (1, 0, "near", 4, "kg"), (1, None, "ge", 1, "kg"), (2, 0, "near", 1, "kg"), (3, 0, "eq", 1, "m")], "case int, req int, relation string, value int, unit string")
    seen = spark.createDataFrame([(c, p, v, "KG") for c in (1, 2) for p, v in ((1, 3), (2, 4), (3, 4))], "case int, passage int, value int, unit string")
    got = operands.operand_choices(asked, seen, "case").select("case", "req", "r_value", "o_value", "truth", "n_passages", "issue").collect()
    open_ = "no_decisive_operand"
    assert {tuple(r) for r in got} == {(1, 0, 3, 3, True, 1, None), (1, 0, 3, 4, False, 2, None), (1, None, 1, 3, True, 1, None), (1, None, 1, 4, True, 2, None), (2, 0, 1, None, None, None, open_), (3, 0, 1, None, None, None, open_)} and len(got) == 6


def test_scores_of_a_block_are_held_in_parts(spark, monkeypatch):
    """However many rows a block has, about HELD_SCORES scores are made at once; ties and ranks are those of all."""
    monkeypatch.setattr(retrieval, "HELD_SCORES", 90)
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query, r.rank): r.doc for r in retrieval.dense_topk(v, v.where("vec_id % 2 = 0"), 5).collect()}
    for q, x in rows[::2]:
        best = sorted((-sum(a * b for a, b in zip(x, y)), d) for d, y in rows if d != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [d for _, d in best]
