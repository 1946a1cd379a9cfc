"""Segments, grammar, papers, tables, plans and screens on small cases, against plain Python or by hand."""

import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import grammar as G
from corpusloom.operators import boxes, metrics, papers, planning, screen, segments, tables
from corpusloom.sources import readers

TEXTS = ["", None, "   ", "One.", "A b. C d!  E f?\n\nNew para.\r\n \r\nLast one. These go on. ", "no end\n\n\n\nnext. \n x", "Dr. X.Y. z... end", "\n\n. a", "ä é. ö！ü. Ω?"]


def test_segments_have_exact_offsets(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    by = {}
    for r in segments.source_segments(df).orderBy("doc_id", "n").collect():
        t = TEXTS[r.doc_id]
        assert t[r.start : r.end] == r.text == r.text.strip() != ""
        before = by.setdefault(r.doc_id, [])
        gap = t[before[-1].end : r.start] if before else ""
        assert r.n == len(before) + 1 and gap.strip() == "" and (r.breaks == gap.count("\n") or not before)
        assert not before or r.para == before[-1].para + (gap.count("\n") >= 2)
        before.append(r)
    for i, t in enumerate(TEXTS):
        rest = [x.strip() for x in re.split(r"(?<=[.!?])\s+|\r?\n[ \t]*\r?\n", t or "")]
        assert [r.text for r in by.get(i, [])] == [x for x in rest if x]


def test_windows_of_segments(spark):
    text = "One a. Two b. Three c.\n\nFour d. They go. Six f. Seven g."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    s = segments.source_segments(df).cache()
    pick = lambda *n: spark.createDataFrame([(1, k) for k in n], "doc_id long, n int")
    near = lambda *n, **k: sorted(r.n for r in segments.nearby_segments(s, pick(*n), **k).collect())
    assert near(2) == [1, 2, 3] and near(5) == [4, 5, 6, 7] and near(7, reach=1) == [6, 7] and near(4, 7, most=3) == [4, 5, 7]
    assert sorted(r.n for r in segments.with_antecedents(s, pick(5)).collect()) == [4, 5]
    assert sorted((r.n, r.other) for r in segments.related_windows(s, pick(3, 4)).collect()) == [(3, 2), (3, 3), (4, 4), (4, 5)]
    w = segments.source_window(df, s, pick(1, 2, 5)).first()
    assert w.window == "One a. Two b.\n\nThey go." and [(o.n, w.window[o.start : o.end]) for o in w.offsets] == [(1, "One a."), (2, "Two b."), (5, "They go.")]
    claims = spark.createDataFrame([(1, "the seven of one")], "doc_id long, claim string")
    assert sorted(r.n for r in segments.ledger_window(s, claims, pick(5), most=4).collect()) == [1, 4, 5, 7]
    v = spark.createDataFrame([(1, "support", [5, 1]), (1, "support", [9]), (1, "support", []), (1, "not_enough_info", [])], "doc_id long, label string, cited array<int>")
    out = segments.resolve_citations(v.limit(1), s).first()
    assert out.issue is None and out.evidence == ["One a.", "They go."]


def passages(text, limit):
    bounds = [0] + [m.end() for m in re.finditer(r"[.!?](?=\s|$)|\n", text)] + [len(text)]
    found = set()
    for i in range(len(bounds) - 1):
        for j in range(i + 1, len(bounds)):
            p = text[bounds[i] : bounds[j]].strip()
            if p and len(p) <= limit:
                found.add(p)
        one = text[bounds[i] : bounds[i + 1]].strip()
        if len(one) > limit:
            words = [m.span() for m in re.finditer(r"\S+", one)]
            for a, _ in words:
                fits = [e for s, e in words if s >= a and e - a <= limit]
                found |= {one[a : max(fits)]} if fits else set()
    return found


def test_passages_equal_brute_force(spark):
    texts = [t for t in TEXTS if t] + ["a b c d e f g h i j k. l m\nn. " * 3, "longwordwithoutanyblank" * 4 + " tail. x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in segments.evidence_passages(df, 12).collect():
        got.setdefault(r.doc_id, set()).add(r.passage)
    assert got == {i: p for i, t in enumerate(texts) if (p := passages(t, 12))}


def test_passages_are_found_where_their_text_is(spark, monkeypatch):
    """No passage is shuffled, a text with more passages than are held at once has each once, and a private-use character is one like others."""
    texts = ["a\uf8feb c. d\uf8ff e.", "One. Two three. " * 40 + "word " * 60, "x.\u2003y z\x85w. " * 3, None, " \n ", "ab cd ef. gh"]
    df = spark.createDataFrame([*enumerate(texts), (None, "lost. one")], "doc_id long, text string")
    out = segments.evidence_passages(df, 12)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.passage) for r in out.collect())
    assert got == sorted((i, p) for i, t in enumerate(texts) if t for p in passages(t, 12))
    monkeypatch.setattr(segments, "HELD_PASSAGES", 10)
    assert sorted(segments._distinct_passages(texts[1], 12)) == sorted(passages(texts[1], 12))


def test_numbers_and_tokens(spark):
    words = {"three": 3, "tenth": 10, "2.50": Fraction(5, 2), "1,200": 1200, "3/4": Fraction(3, 4), "−4": -4, "two-fold": 2, "5fold": 5, "1/0": None, "12,34": None, "": None, "abc": None, "1/2/3": None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", G.number(F.col("w")).alias("x")).collect():
        assert (None if r.x is None else Fraction(r.x.num) / Fraction(r.x.den)) == words[r.w], r.w
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(G.tokens(F.lit("State‑of-the-art +3.5% (GPT-4), 1/2!"))) == ["state-of-the-art", "+3.5", "%", "(", "gpt", "-4", ")", ",", "1/2", "!"]
    assert one(G.key_tokens(F.lit("The size of a set is 5."))) == ["size", "set", "5"]
    q = one(G.quantities(F.lit("At least one of 1,200 items, 3.5 % of x2 and Twelve; v1.2.3"), claim=True))
    assert {(float(x.value), x.kind) for x in q} == {(1200.0, "number"), (3.5, "percent"), (12.0, "number")}
    assert one(G.direction(F.lit("It rose"), loose=True)) == "increase" and one(G.direction(F.lit("It rose"))) is None and one(G.direction(F.lit("raised, then lowered"))) is None
    cell = lambda t: (lambda v: v and (float(v.value), v.unit))(one(G.cell_value(F.lit(t))))
    assert [cell(t) for t in ("3.5k", "12 %", "1,000 ± 2.5", "−2M", "n/a", "3 4")] == [(3500, "number"), (12, "percent"), (1000, "number"), (-2e6, "number"), None, None]
    assert [one(G.scaled_count(F.lit(t))) for t in ("3 million", "twelve", "1,500")] == [3_000_000, 12, 1500] and one(G.scaled_count(F.lit("many"))) is None
    assert one(G.reference_free(F.lit("Table 3 and GPT-4 have 5 rows, group 2 %"))).split() == ["and", "have", "5", "rows,", "group", "2", "%"]
    assert [one(G.token_aligned(F.lit(a), F.lit(b))) for a, b in (("5", "15 5.2 5, 5"), ("cat", "concat cat."), ("a+b", "a+b xa+b"), ("", "x"))] == [2, 1, 1, 0]


def test_bounds(spark):
    n = lambda v: None if v is None else F.lit(v).cast("decimal(38,10)")
    b = lambda rel, v: G.bound(F.lit(rel), n(v))
    cases = [("ge", 4, "eq", 4, True), ("gt", 4, "eq", 4, False), ("ge", 4, "ge", 5, True), ("ge", 4, "ge", 3, None), ("le", 4, "gt", 4, False), ("eq", 4, "le", 4, None), ("lt", 4, "le", 3, True), ("only", 4, "eq", 4, True)]
    got = spark.range(1).select(*[G.compare_bounds(b(a, x), b(c, y)).alias(str(i)) for i, (a, x, c, y, _) in enumerate(cases)]).first()
    assert list(got) == [want for *_, want in cases]


ANSWER = "struct<unanswerable:boolean,yes_no:boolean,evidence:array<string>,highlighted_evidence:array<string>>"


@pytest.mark.parametrize("layout", ["plain", "wrapped", "columns"])
def test_papers_in_each_layout(spark, layout):
    para = ["First paragraph here.", "Second one.", "", "x" * 901]
    a = (False, None, ["Second one.", "FLOAT SELECTED: T", "missing", "x" * 901, "First paragraph here."], ["First", "FLOAT SELECTED"])
    b = (False, None, ["Second one.", "First paragraph here."], [])
    q = {"plain": [a, b], "wrapped": [(a,), (b,)], "columns": ([[x, y] for x, y in zip(a, b)],)}[layout]
    kind = {"plain": f"array<{ANSWER}>", "wrapped": f"array<struct<answer:{ANSWER}>>", "columns": "struct<answer:struct<unanswerable:array<boolean>,yes_no:array<boolean>,evidence:array<array<string>>,highlighted_evidence:array<array<string>>>>"}[layout]
    none = {"plain": [(True, None, [], [])], "wrapped": [((True, None, [], []),)], "columns": ([[True], [None], [[]], [[]]],)}[layout]
    clash = {"plain": [(False, True, ["Second one."], []), (False, False, [], [])], "wrapped": [((False, True, ["Second one."], []),), ((False, False, [], []),)], "columns": ([[False, False], [True, False], [["Second one."], []], [[], []]],)}[layout]
    df = spark.createDataFrame([("p", "T", [("s1", para[:2]), ("s2", para[2:])], [("Why?", "q1", q), ("None?", "", none), ("Clash?", None, clash)])], f"paper_id string, title string, full_text array<struct<section_name:string,paragraphs:array<string>>>, qas array<struct<question:string,question_id:string,answers:{kind}>>")
    assert [(r.p_no, r.text) for r in papers.paragraphs(df).orderBy("p_no").collect()] == list(enumerate(para))
    c = {r.question_id: r for r in papers.extract_claims(df).collect()}
    assert sorted(c) == ["1", "2", "q1"] and [x.text for x in c["q1"].claims] == ["Second one.", "First", "First paragraph here."] and not c["1"].claims and not c["2"].claims
    assert (c["q1"].dropped_visual, c["q1"].dropped_unmatched, c["q1"].dropped_long, c["q1"].cap_reached) == (1, 1, 1, False)
    assert [x.source_id for x in c["q1"].claims] == ["qasper:p:paragraph:1", "qasper:p:paragraph:0", "qasper:p:paragraph:0"]
    capped = {r.question_id: r for r in papers.extract_claims(df, max_claims=1).collect()}["q1"]
    assert (len(capped.claims), capped.dropped_visual, capped.cap_reached) == (1, 0, True)
    rows = papers.training_rows(papers.extract_claims(df), F.lit("train")).collect()
    assert sorted(r.task for r in rows if r.question_id == "q1") == ["action", "critic", "critic", "report"] and sum(r.question_id == "1" for r in rows) == 2 and len({r.example_id for r in rows}) == 8
    corpus, judged = papers.relevance(df)
    j = {r.question_id: r for r in judged.collect()}
    assert corpus.count() == 3 and {k: r.reason for k, r in j.items()} == {"q1": "missing_visual_or_unmatched_evidence", "1": "unanswerable_or_disagreement", "2": "answer_disagreement"}
    with pytest.raises(ValueError):
        papers.split_papers(spark.createDataFrame([("p", "a"), ("p", "b")], "paper_id string, split string"))


def test_relevant_paragraphs(spark):
    df = spark.createDataFrame([("p", "T", [("s", ["Ａ  full\nwidth", "other", "A full width"])], [("Q?", "q", [(False, None, ["A full width", " "], [])])])], f"paper_id string, title string, full_text array<struct<section_name:string,paragraphs:array<string>>>, qas array<struct<question:string,question_id:string,answers:array<{ANSWER}>>>")
    r = papers.relevance(df)[1].first()
    assert r.relevant == ["qasper:p:paragraph:0", "qasper:p:paragraph:2"] and r.query == "In the paper 'T', Q?"


def test_screen_and_tables(spark):
    flag = lambda c, *q: spark.range(1).select(screen.support_flags(F.lit(c), F.array(*[F.lit(x) for x in q])).alias("x")).first().x
    quote = "Latency was 5 ms before pruning and 7 ms after."
    assert flag("Latency decreased after pruning", quote) == ["numeric_direction_conflict"] and flag("Latency increased after pruning", quote) == []
    assert flag("Throughput decreased after pruning", quote) == ["numeric_scope_requires_review"] and flag("Latency did not increase", quote) == []
    assert flag("Latency rose by 9 and power fell", quote) == ["claim_quantity_not_quoted", "conjunct_lexical_gap"]
    text = "Table 2. Scores on the dev split.\n| model | F1 | BLEU score |\n|---|:-:|---|\n| Base | 80.5 | 3k |\n| Base large | 82.0 ± 0.4 | 4k |\n| Tiny | 12% | 2k |\n\nTable 3.\n| model | F1 |\n| Base | 1 |"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cells = tables.table_cells(docs).cache()
    assert cells.where("col = 0").count() == 4 and cells.where("block = 1 or row = 3").first().caption == "Table 2. Scores on the dev split."
    claims = ["Base large has a higher F1 than Base", "Base has a higher F1 than Base large", "Tiny has lower F1 than Base", "Base is not higher F1 than Base large", "Base has higher BLEU than Tiny", "Base large has fewer BLEU than Base in Table 3", "Base has higher accuracy than Tiny", "On test split, Base has higher F1 than Base large"]
    got = {r.claim_id: r.label for r in tables.compare_rows(spark.createDataFrame([(1, i, c) for i, c in enumerate(claims)], "doc_id long, claim_id int, claim string"), cells).collect()}
    assert got == {0: "support", 1: "contradict"}
    c = spark.createDataFrame([(1, 1, "base", "f1", 1), (1, 2, "base", "bleu score", 3)], "doc_id long, claim_id int, member string, metric string, count int")
    assert tables.refute_lead(c, cells).count() == 0  # a spread, a scale: no plain column; one row can't be beaten
    p = spark.createDataFrame([(1, 1, "the Base large", "base", ["F1"]), (1, 2, "base", "Tiny", ["F1"]), (1, 3, "base", "base", ["F1"])], "doc_id long, claim_id int, subject string, baseline string, metrics array<string>")
    assert {r.claim_id: r.label for r in tables.compare_preferences(p, cells).collect()} == {1: "support"}


def test_subjects_and_facts(spark):
    same = lambda a, b, ka="k", kb="k", n=1: spark.range(1).select(screen.same_subject(F.lit(a), F.lit(b), F.lit(ka), F.lit(kb), F.lit(n)).alias("x")).first().x
    assert same("the base model", "Base model") and not same("model 2", "model 3") and same("our model", "the proposed system") and not same("alpha", "beta") and same("alpha", "beta", n=2)
    assert same("small fast base model", "small base model", "a", "b") and not same("small model", "large model", "a", "b") and not same("", "x")
    cols = "claim_id int, req int, subject string, subject_key string, property string, scope string, relation string, value decimal(38,10), unit string"
    from decimal import Decimal

    req = spark.createDataFrame([(1, 1, "the set", "s", "size", "all", "ge", Decimal(4), "rows"), (1, 2, "the set", "s", "size", "dev", "eq", Decimal(4), "rows"), (2, 1, "the set", "s", "size", "all", "eq", Decimal(4), "rows")], cols)
    facts = spark.createDataFrame([(1, "set", "s", "size", "all", "eq", Decimal(5), "rows", 1), (1, "set", "s", "size", "all", "eq", Decimal(9), "items", 1), (2, "set", "s", "size", "all", "eq", Decimal(4), "rows", 1), (2, "set", "s", "size", "all", "eq", Decimal(5), "rows", 1)], cols.replace(" req int,", "") + ", spans int")
    assert sorted((r.claim_id, r.req, r.label) for r in screen.decide(req, facts).collect()) == [(1, 1, "support"), (1, 2, "not_enough_info"), (2, 1, "not_enough_info")]


def test_plans_limits_and_boxes(spark):
    plan = lambda q: spark.range(1).select(planning.create_plan(F.lit(q)).alias("x")).first().x
    assert [t.query for t in plan("Compare BM25 versus dense search on recall?")] == ["BM25", "dense search", ""] and [t.task_id for t in plan("A? B?")] == ["t1", "t2"] and len(plan("a?b?c?d?e?")) == 1
    none = F.lit(None).cast("double")
    good = {a: 1.0 for a in ("read", "search", "summarize", "factcheck", "write")}
    m = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p]) if d else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    issue = lambda s, t, c, b: spark.range(1).select(planning.limit_issue({"max_steps": F.lit(s), "max_seconds": F.lit(t), "max_cost": c, "bounds": m(b)}).alias("x")).first().x
    assert [issue(5, 1.0, none, {}), issue(0, 1.0, none, {}), issue(5, 0.0, none, {}), issue(5, 1.0, F.lit(-1.0), good), issue(5, 1.0, none, {"fly": 1.0}), issue(5, 1.0, F.lit(2.0), {"read": 1.0}), issue(5, 1.0, F.lit(2.0), good)] == [None, "max_steps", "max_seconds", "max_cost", "bounds", "bounds_missing", None]
    done = spark.createDataFrame([("a", "complete"), ("a", "active"), ("b", "complete"), ("c", None)], "plan string, status string")
    assert {r.plan: r.complete for r in planning.plan_complete(done).collect()} == {"a": False, "b": True, "c": False}
    b = spark.range(1).select(boxes.normal_box(F.array(*[F.lit(v) for v in (90.0, -5.0, 30.0, 300.0)]), F.lit(100.0), F.lit(200.0)).alias("b")).first().b
    assert b == [300, 0, 900, 1000]


def test_positions_and_index(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "at int, q string, v int")
    assert metrics.positional_join(a, a, "at", "q").count() == 2
    for other in (a.where("at = 1"), a.withColumn("q", F.lit("z"))):
        with pytest.raises(Exception):
            metrics.positional_join(a, other, "at", "q").collect()
    from corpusloom.operators import retrieval

    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "...")], "doc_id long, text string")
    readers.write_index(docs, str(tmp_path / "ix"))
    index, n = readers.read_index(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert n == 3 and spark.read.parquet(str(tmp_path / "ix/documents")).count() == 3
    assert sorted(retrieval.bm25_from_postings(index, n, q, 5).collect()) == sorted(retrieval.bm25_topk(docs, q, 5).collect())
    index.where("term = 'a'").write.parquet(str(tmp_path / "less/postings"))
    spark.read.json(str(tmp_path / "ix/manifest")).write.json(str(tmp_path / "less/manifest"))
    with pytest.raises(ValueError):
        readers.read_index(spark, str(tmp_path / "less"))
    with pytest.raises(ValueError):
        readers.write_index(docs.union(docs), str(tmp_path / "again"))
