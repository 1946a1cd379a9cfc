"""Requirements, operands, cells, ledgers, populations and clauses against plain Python and small cases."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import clauses as C
from corpusloom.functions import grammar as G
from corpusloom.functions import spans
from corpusloom.operators import boxes, cells, evidence, ledger, metrics, operands, populations, requirements, screen, tables


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers_of_any_length_are_exact(spark):
    long = "1" + "0" * 39
    cases = ["0.000001", "0.000002", long, long + ".5", "3/4", "6/8", "1,000", "1000.0", "-0.0", "0", "00012.50", "12.5", "1/3", "33333333333333333333/100000000000000000000", "999999999999999/1000000000000000", "123456789012345678/1"]
    df = spark.createDataFrame([(a, b) for a in cases for b in cases], "a string, b string")
    for r in df.select("a", "b", G.same_number(G.number(F.col("a")), G.number(F.col("b"))).alias("same")).collect():
        same = Fraction(r.a.replace(",", "")) == Fraction(r.b.replace(",", ""))
        assert r.same == same or (r.same is None and "/" in r.a + r.b and len(r.a + r.b) > 39)
    q = value(spark, G.quantities(F.lit(f"{long} and 0.000000000001 and 5%")))
    assert [(x.value is None, x.kind, x.exact) for x in q] == [(True, "number", long), (True, "number", "0.000000000001"), (False, "percent", "5")]
    missing = value(spark, G.missing_quantities(F.lit(f"{long} of 0.000000000002"), F.lit(f"{long} of 0.000000000001")))
    assert [x.exact for x in missing] == ["0.000000000002"]
    assert value(spark, G.cell_value(F.lit(long))) is None and value(spark, G.cell_value(F.lit("1" + "0" * 27 + "k"))) is None and value(spark, G.cell_value(F.lit("1.5k"))).value == 1500
    assert value(spark, G.scaled_count(F.lit(long + " million"))) is None and value(spark, G.number(F.lit("1/0"))) is None


TEXTS = ["", "Of 1,200 items at least one and Twelve boxes cost 3.5 % less than v1.2.3, -4 to 7 percent of x2.", "Größe 12km; 5 apples and 5 apples (all)", "0.50% 007 bonds"]


def test_spans_equal_slices_of_the_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "k int, text string")
    rows = df.select("k", "text", spans.token_spans(F.col("text")).alias("t"), spans.quantity_spans(F.col("text")).alias("q"), spans.phrase_spans(F.col("text"), 3, 20).alias("p"), G.tokens(F.col("text")).alias("words")).collect()
    for r in rows:
        if r.text is None:
            assert r.t is r.q is r.p is None
            continue
        assert [r.text[x.start : x.end] for x in r.t] == [x.token for x in r.t] and [x.token.lower().replace("‑", "-") for x in r.t] == r.words
        assert [r.text[x.start : x.end] for x in r.q] == [x.quote for x in r.q]
        assert all(r.text[x.start : x.end].strip() == r.text[x.start : x.end] and len(r.text[x.start : x.end]) <= 20 for x in r.p)
    assert [(x.quote, x.value, x.unit, x.kind) for x in rows[1].q] == [("1,200 items", "1200", "items", "number"), ("Twelve boxes", "12", "boxes", "number"), ("3.5 %", "3.5", "%", "percent"), ("-4", "-4", "", "number"), ("7 percent", "7", "percent", "percent")]
    assert [x.value for x in rows[2].q] == ["5", "5"] and [x.value for x in rows[3].q] == ["0.5", "7"]
    words = [m.span() for m in re.finditer(r"\w+|[^\w\s]", "a b, c")]
    assert {(x.start, x.end) for x in value(spark, spans.phrase_spans(F.lit("a b, c"), 2, 99))} == {(0, 1), (0, 3), (2, 3), (5, 6)} and len(words) == 4
    assert value(spark, spans.quote_places(F.array(F.lit("aa"), F.lit(""), F.lit(None), F.lit("b")), F.lit("aaab"))) == [[0, 1], [], [], [3]]


def test_quotes_find_their_original_words(spark):
    text = "The  ﬁrst\n line. The first line, oﬃcial."
    cases = {"The first line.": (0, 16), "The first line": (17, 31), "The ﬁrst line,": (17, 32), "official": (33, 39), "ficial": None, "the first": None, " ": None, "first line. The": (5, 20)}
    df = spark.createDataFrame([(q, text) for q in cases] + [(None, text), ("x", None)], "q string, t string")
    for r in df.select("q", "t", spans.source_slice(F.col("q"), F.col("t")).alias("s")).collect():
        want = cases.get(r.q) if r.t else None
        assert (r.s and (r.s.start, r.s.end)) == want and (r.s is None or r.s.slice == text[want[0] : want[1]])


def test_interval_cover(spark):
    rng = random.Random(4)
    spans_, whole, want = [], [], {}
    for k in range(60):
        lo, hi = 5, 40
        own = [(a, a + rng.randint(-1, 9)) for a in (rng.randint(0, 45) for _ in range(rng.randint(0, 7)))]
        spans_ += [(k, a, b) for a, b in own]
        whole.append((k, lo, hi))
        free = [x for x in range(lo, hi) if not any(a <= x < b for a, b in own)]
        want[k] = {(a, b) for a in free if a - 1 not in free for b in [next(x for x in range(a, 99) if x not in free)]}
    df = spark.createDataFrame(spans_, "k int, start int, end int")
    got = {}
    for r in requirements.gaps(df, spark.createDataFrame(whole, "k int, start int, end int"), ["k"]).collect():
        got.setdefault(r.k, set()).add((r.start, r.end))
    assert got == {k: v for k, v in want.items() if v}
    merged = {(r.start, r.end) for r in requirements.islands(spark.createDataFrame([(1, 0, 9), (1, 2, 3), (1, 9, 10), (1, 12, 12), (1, 11, 14)], "k int, start int, end int"), ["k"]).collect()}
    assert merged == {(0, 10), (11, 14)}


def test_quotes_are_bound_once_and_uncovered_content_is_named(spark):
    claims = spark.createDataFrame([(1, "The model gained 5% on the large test set, without a new encoder."), (2, "A gained B gained"), (3, None), (4, "")], "claim_id int, text string")
    quotes = spark.createDataFrame([(1, "model gained 5%"), (1, "large test"), (1, "test set"), (1, "mod"), (1, "no such"), (2, "gained"), (2, "A gained"), (3, "x"), (1, " "), (1, None)], "claim_id int, quote string")
    bound = {(r.claim_id, r.quote): (r.start, r.end, r.issue) for r in requirements.bind_quotes(claims, quotes).collect()}
    assert bound[1, "model gained 5%"] == (4, 19, None) and bound[1, "mod"][2] == "partial_token_span" and bound[1, "no such"][2] == "quote_not_in_claim"
    assert bound[2, "gained"][2] == "ambiguous_quote" and bound[2, "A gained"] == (0, 8, None) and bound[3, "x"][2] == "quote_not_in_claim" and bound[1, " "][2] == bound[1, None][2] == "empty_quote"
    good = spark.createDataFrame([(k, a, b) for (k, _), (a, b, i) in bound.items() if i is None], "claim_id int, start int, end int")
    got = {r.claim_id: r for r in requirements.claim_coverage(claims, good).collect()}
    assert [x.token for x in got[1].uncovered] == ["without", "new", "encoder"] and got[1].issue == "uncovered_claim_content"
    assert [x.token for x in got[2].uncovered] == ["B", "gained"] and (got[3].n_tokens, got[3].issue, got[4].issue) == (0, None, None)
    loose = requirements.unbound_conditions(claims, good).collect()
    assert [(r.claim_id, r.cue, r.start) for r in loose] == [(1, "without", 43)]
    held = spark.createDataFrame([(1, 40, 50), (1, 60, 61)], "claim_id int, start int, end int")
    assert requirements.unbound_conditions(claims, held).count() == 0
    assert requirements.unbound_conditions(claims, spark.createDataFrame([(1, 44, 50)], "claim_id int, start int, end int")).count() == 1


@pytest.mark.parametrize(
    "relation, cue, subjects, values, issue",
    [
        ("eq", None, 1, [("number", "5", 3, 4)], None), ("most", None, 1, [("number", "5", 3, 4)], "invalid_relation"), ("gt", "above", 1, [("number", "5", 3, 4)], None),
        ("gt", "nearly", 1, [("number", "5", 3, 4)], "unbound_relation_cue"), ("eq", None, 2, [("number", "5", 3, 4)], "unexpected_multiple_subjects"), ("le", "at most", 1, [("text", "x", 3, 4)], "invalid_comparison_operand"),
        ("before", "prior", 1, [("text", "b", 9, 10), ("text", "a", 3, 4)], "reversed_order_operands"), ("before", "prior", 1, [("text", "a", 3, 4)], "invalid_order_operands"), ("transition", None, 1, [("number", "1", 3, 4), ("number", "2", 9, 10)], None),
        ("eq", None, 1, [("number", "1", 9, 10), ("number", "2", 3, 4)], "reversed_value_operands"), ("includes", None, 1, [("text", "not x", 3, 8)], "unrepresented_negation"), ("not", "not", 1, [("text", "not x", 3, 8)], None),
        ("eq", None, 1, [("reference", "x", 3, 4)], "invalid_reference_operand"), ("respectively", "respectively", 1, [("text", "x", 3, 4)], "invalid_relation"), ("eq", None, 1, [("word", "x", 3, 4)], "invalid_value_kind"),
    ],
)
def test_parts_of_a_fact_fit_its_relation(spark, relation, cue, subjects, values, issue):
    row = spark.createDataFrame([(relation, cue, [(i, i + 1) for i in range(subjects)], values)], "r string, c string, s array<struct<start:int,end:int>>, v array<struct<kind:string,text:string,start:int,end:int>>")
    assert row.select(requirements.fact_issue(F.col("r"), F.col("c"), F.col("s"), F.col("v"), F.lit(True)).alias("x")).first().x == issue


@pytest.mark.parametrize(
    "v, unit, quote, source, issue",
    [
        ("5", "apples", "5 apples", "He had 5 apples.", None), ("5", "", "5", "It was 5.", None), ("5", "", "5", "It was 5 apples", "numeric_unit_required"), ("5", "", "5", "It was 5 and more", None),
        ("5", "%", "5%", "It was 5% less", None), ("5", "", "5%", "It was 5% less", "numeric_unit_not_grounded"), ("5", "apples", "5 pears", "5 pears", "numeric_unit_not_grounded"), ("6", "apples", "5 apples", "5 apples", "numeric_value_not_grounded"),
        ("5", "apples", "5 apples", "15 apples", "numeric_source_membership"), ("five", "apples", "5 apples", "5 apples", "numeric_value_format"), ("5", "", "5 apples", "5 apples", "numeric_unit_required"), (None, "", "5", "5", "numeric_operand_schema"),
        ("1" + "0" * 40, "", "1" + "0" * 40, "It is 1" + "0" * 40 + ".", None), ("5", "", "5", "5%", "numeric_unit_required"),
    ],
)
def test_operands_are_grounded(spark, v, unit, quote, source, issue):
    row = spark.createDataFrame([(v, unit, quote, source)], "v string, u string, q string, s string")
    assert row.select(operands.operand_issue(*[F.col(c) for c in "vuqs"]).alias("x")).first().x == issue


def test_choices_equal_the_whole_product(spark):
    rng = random.Random(9)
    asked = [(c, q, rng.choice(["eq", "gt", "le", "near"]), rng.randint(0, 6), rng.choice(["kg", "%", ""])) for c in range(30) for q in range(rng.randint(1, 3))]
    seen = [(c, p, rng.randint(0, 6), rng.choice(["KG", "percent", "", "m"])) for c in range(30) for p in range(rng.randint(0, 8))]
    got = operands.operand_choices(spark.createDataFrame(asked, "case int, req int, relation string, value int, unit string"), spark.createDataFrame(seen, "case int, passage int, value int, unit string"), "case")
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    key = lambda u: "%" if u == "percent" else u.lower()
    want = {}
    for c, q, rel, v, u in asked:
        for c2, p, w, u2 in seen:
            if c == c2 and key(u) == key(u2) and rel != "near":
                truth = {"eq": w == v, "gt": w > v, "le": w <= v}[rel]
                want.setdefault((c, q, w), [truth, set()])[1].add(p)
    rows = got.collect()
    assert {(r.case, r.req, r.o_value): [r.truth, r.n_passages, r.first_passage] for r in rows if r.issue is None} == {k: [t, len(p), min(p)] for k, (t, p) in want.items()}
    assert {(r.case, r.req) for r in rows if r.issue} == {(c, q) for c, q, *_ in asked} - {(c, q) for c, q, _ in want}
    verdicts = {r.case: r.truth for r in operands.requirement_verdicts(got, "case").collect()}
    for c in range(30):
        states = [{t for (c2, q2, _), (t, _) in want.items() if (c2, q2) == (c, q)} for c3, q, *_ in asked if c3 == c]
        assert verdicts[c] == (all(next(iter(s)) for s in states) if all(len(s) == 1 for s in states) else None)
    few = operands.operand_choices(spark.createDataFrame(asked, "case int, req int, relation string, value int, unit string"), spark.createDataFrame(seen, "case int, passage int, value int, unit string"), "case", most=1)
    assert few.where("issue = 'too_many_operands'").count() > 0 and few.where("issue is null").groupBy("case", "req").count().where("count > 1").count() == 0


def test_points_in_boxes_of_all_sizes(spark):
    rng = random.Random(3)
    points = [(rng.randint(0, 3), i, float(rng.randint(0, 60)), float(rng.randint(-20, 60))) for i in range(300)]
    held = [(p, i, float(x), float(y), float(x + w), float(y + h)) for i, (p, x, y, w, h) in enumerate((rng.randint(0, 3), rng.randint(-5, 50), rng.randint(-20, 50), rng.choice([0, 1, 3, 9, 40, 700]), rng.choice([1, 2, 8, 33])) for _ in range(60))]
    p = spark.createDataFrame(points, "page int, at int, x double, y double")
    b = spark.createDataFrame([*held, (0, 99, None, 1.0, 2.0, 2.0)], "page int, box int, x0 double, y0 double, x1 double, y1 double")
    for closed, inside in ((None, lambda x, y, a, t, r, o: a <= x < r and t <= y < o), (1.0, lambda x, y, a, t, r, o: a - 1 <= x <= r + 1 and t - 1 <= y <= o + 1)):
        got = sorted((r.at, r.box) for r in cells.points_in_boxes(p, b, "page", closed).collect())
        assert got == sorted((i, k) for q, i, x, y in points for w, k, *box in held if q == w and inside(x, y, *box))
    assert cells.points_in_boxes(p, b.limit(0), "page").count() == 0
    words = spark.createDataFrame([(1, 2, 10.0, 0.0, 20.0, 5.0, "b"), (1, 1, 0.0, 0.0, 8.0, 5.0, "a"), (1, 3, 95.0, 0.0, 120.0, 5.0, "c")], "page int, at int, x0 double, y0 double, x1 double, y1 double, word string")
    read = cells.read_boxes(words, spark.createDataFrame([(1, 7, 0.0, 0.0, 100.0, 9.0), (1, 8, 200.0, 0.0, 210.0, 9.0)], "page int, box int, x0 double, y0 double, x1 double, y1 double"), "page", "box")
    assert {r.box: r.text for r in read.collect()} == {7: "a b", 8: ""}


def page_of(spark, lines, header, caption="Table 3: x", top=0.0):
    """Words and blocks of one page: lines of (y, [(x0, x1, word), ...])."""
    words, n = [], 0
    blocks = [(1, 0, "caption", 0.0, top, 300.0, top + 6, caption)]
    for k, (y, ws) in enumerate([(20.0, header), *lines], 1):
        for x0, x1, word in ws:
            words.append((1, n, float(x0), y, float(x1), y + 6, word))
            n += 1
        blocks.append((1, k, "text", 0.0, y, 300.0, y + 6, ("\n" if k == 1 else " ").join(w for *_, w in ws)))
    return spark.createDataFrame(words, "page int, at int, x0 double, y0 double, x1 double, y1 double, word string"), spark.createDataFrame(blocks, "page int, block int, kind string, x0 double, y0 double, x1 double, y1 double, text string")


def test_count_cells_and_claims_about_them(spark):
    head = [(10, 60, "Statistic"), (100, 120, "Train"), (200, 220, "Test")]
    lines = [(40.0, [(10, 30, "All"), (32, 60, "rows"), (105, 115, "1,200"), (206, 214, "30")]), (50.0, [(10, 30, "Words"), (105, 115, "12"), (226, 234, "3")]), (60.0, [(10, 30, "words"), (105, 115, "7"), (206, 214, "8")]), (70.0, [(10, 30, "WORDS"), (105, 115, "7"), (206, 214, "8")])]
    words, blocks = page_of(spark, lines, head)
    got = cells.count_cells(words, blocks, "page")
    assert {(r.table_id, r.row_label, r.column_header, r.cell_text) for r in got.collect()} == {("3", "All rows", "Train", "1,200"), ("3", "All rows", "Test", "30")}
    c = got.where("column_header = 'Train'").select(F.struct(*got.columns).alias("cell"))
    say = lambda claim, context="All rows 1,200 30": (lambda v: v and tuple(v))(c.select(cells.cell_claim_verdict(F.lit(claim), F.lit(context), F.col("cell")).alias("v")).first().v)
    assert say("In Table 3, the count for All rows in the Train column is 1200.") == ("support", "table_count_matches")
    assert say("In Table 3, the count for All rows in the Train column is 1,300.") == ("contradict", "table_count_differs")
    assert say("In Table 4, the count for All rows in the Train column is 1,300.") == ("not_enough_info", "table_scope_mismatch")
    assert say("In Table 3, the count for All rows in the Train column is 1,200.", "All rows 30") == ("not_enough_info", "table_cell_absent_from_source") and say("Rows are 1,200.") is None
    twice = blocks.union(blocks.where("kind = 'caption'"))
    assert cells.count_cells(words, twice, "page").count() == 0


def test_percentage_cells(spark):
    head = [(10, 40, "Type"), (100, 106, "%"), (150, 180, "Count")]
    lines = [(40.0, [(10, 30, "red"), (32, 50, "ones"), (101, 120, "12.50%"), (150, 160, "7")]), (50.0, [(10, 30, "blue"), (110, 120, "3%")]), (60.0, [(10, 30, "green"), (100, 120, "4%")]), (70.0, [(10, 30, "Green"), (100, 120, "5%")])]
    words, blocks = page_of(spark, lines, head)
    got = cells.percentage_cells(words, blocks, "page")
    assert [(r.table_id, r.row_label, r.cell_text, r.label_header) for r in got.collect()] == [("3", "red ones", "12.50%", "Type")]
    c = got.select(F.struct(*got.columns).alias("cell"))
    say = lambda v: tuple(c.select(cells.cell_claim_verdict(F.lit(f"In Table 3, the percentage for red ones is {v}."), F.lit("red ones 12.50% 7"), F.col("cell"), percent=True).alias("v")).first().v)
    assert say("12.5%") == ("support", "table_percentage_matches") and say("12%") == ("contradict", "table_percentage_differs") and say("120%") == ("not_enough_info", "table_percentage_out_of_range")


def test_trees_of_any_depth(spark):
    rng = random.Random(8)
    nodes, seen, want = [], [], {}

    def grow(t, name, parent, depth):
        kids = rng.randint(1, 3) if depth < 5 and (depth == 0 or rng.random() < 0.7) else 0
        op, turned = (rng.choice(["and", "or"]) if kids else "leaf"), rng.random() < 0.3
        nodes.append((t, name, parent, op, turned if rng.random() < 0.9 or turned else None))
        truths = [grow(t, f"{name}.{k}", name, depth + 1) for k in range(kids)]
        if not kids:
            v = rng.choice([True, False, None])
            if v is not None:
                seen.append((t, name, v))
            if rng.random() < 0.1:
                seen.extend([(t, name, True), (t, name, False)])
                v = None
            truth = v
        elif op == "and":
            truth = False if False in truths else None if None in truths else True
        else:
            truth = True if True in truths else None if None in truths else False
        truth = truth if truth is None or not turned else not truth
        want[t, name] = truth
        return truth

    for t in range(25):
        grow(t, "r", None, 0)
    loop = [(99, "a", "b", "and", False), (99, "b", "a", "and", False)]
    schema = "tree int, node string, parent string, op string, negated boolean"
    df, obs = spark.createDataFrame(nodes + loop, schema), spark.createDataFrame(seen, "tree int, node string, truth boolean")
    rows = ledger.evaluate_trees(df, obs).collect()
    assert {(r.tree, r.node): r.truth for r in rows} == want and len(rows) == len(want)
    with pytest.raises(ValueError):
        ledger.evaluate_trees(df, obs, most_depth=1)
    assert ledger.evaluate_trees(df.limit(0), obs).count() == 0


def test_labels_of_claims_by_parts(spark):
    e, r, u = "entails", "refutes", "unresolved"
    cases = {1: [(e, "a"), (e, "b")], 2: [(e, "a"), (r, "b"), (r, "c")], 3: [(e, "a"), (u, "b")], 4: [(r, "a"), (e, "b")], 5: [(e, "a")], 6: [(e, x) for x in "abcde"]}
    parts = [(k, i, rel, [s], k in (4, 5)) for k, ps in cases.items() for i, (rel, s) in enumerate(ps)]
    got = {x.claim_id: (x.label, x.evidence_ids, x.reason) for x in ledger.claim_labels(spark.createDataFrame(parts, "claim_id int, part int, relation string, evidence_ids array<string>, disjunction boolean")).collect()}
    assert got == {1: ("support", ["a", "b"], None), 2: ("contradict", ["b"], None), 3: ("not_enough_info", [], None), 4: ("not_enough_info", [], None), 5: ("support", ["a"], None), 6: ("not_enough_info", [], "too_many_citations")}


def test_stated_populations(spark):
    cases = [
        (1, "stores", "", "", "We visited exactly three stores. All were open.", (3, [], "three stores")),
        (2, "stores", "", "", "The stores were Alpha, Beta and Gamma. Alpha leaked.", (3, ["Alpha", "Beta", "Gamma"], "Alpha, Beta and Gamma")),
        (3, "stores", "", "", "Exactly two stores: Alpha, Beta and Gamma.", None),
        (4, "stores", "", "", "Exactly two stores opened. Exactly three stores closed.", None),
        (5, "certified stores", "", "", "Exactly two stores opened.", None),
        (6, "stores", "", "", "Exactly 17 stores opened.", None),
        (7, "stores", "in May", "", "Exactly two stores opened. Both leaked in May.", (2, [], "two stores")),
        (8, "stores", "in May", "", "Exactly two stores opened. Both leaked in June. May was dry.", None),
        (9, "entries", "", "", "There were exactly 4 new entries.", (4, [], "4 new entries")),
        (10, "boxes", "", "", "Exactly one box was left.", (1, [], "one box")),
        (11, "stores", "", "", None, None),
    ]
    parts = spark.createDataFrame([c[:4] for c in cases], "case_id int, entity string, time string, condition string")
    got = {r.case_id: (r.n_members, r.names, r.anchor) for r in populations.stated_populations(parts, spark.createDataFrame([(c[0], c[4]) for c in cases], "case_id int, text string")).collect()}
    assert got == {c[0]: c[5] for c in cases if c[5]}


def test_quantifiers_over_closed_populations(spark):
    cases = spark.createDataFrame([(k, q) for k, q in enumerate(["all", "all", "all", "some", "none", "none", "all", "all"])], "case_id int, quantifier string")
    stated = spark.createDataFrame([(0, 2, ["A", "B"]), (1, 2, ["A", "B"]), (2, 2, []), (3, 2, []), (4, 2, ["A", "B"]), (5, 3, []), (6, 2, ["A", "B"])], "case_id int, n_members int, names array<string>")
    seen = [(0, "A", True), (0, "B", True), (1, "A", True), (2, "A", True), (2, "B", True), (3, "A", False), (3, "B", False), (4, "A", True), (5, "A", False), (5, "B", False), (6, "A", True), (6, "C", True), (1, "B", True), (1, "B", False)]
    got = {r.case_id: (r.truth, r.issue, r.closed) for r in populations.closed_truth(cases, stated, spark.createDataFrame(seen, "case_id int, member string, truth boolean")).collect()}
    open_ = "population_closure_required"
    assert got == {0: (True, None, True), 1: (None, open_, False), 2: (True, None, True), 3: (False, None, True), 4: (False, None, False), 5: (None, open_, False), 6: (None, "outside_member", False), 7: (None, "no_population", False)}


def test_clauses_scopes_and_members(spark):
    assert value(spark, C.clauses(F.lit("Alpha rose, but Beta fell; Gamma (3.5) stayed. Done!"))) == ["Alpha rose", "Beta fell", "Gamma (3.5) stayed", "Done"]
    assert value(spark, C.owned_clauses(F.lit("Beta"), F.array(F.lit("Alpha rose while Beta fell."), F.lit("Betas rose")))) == ["Beta fell"]
    conflict = lambda t, c, x: value(spark, C.scope_conflict(F.lit(t), F.lit(c), F.lit(x)))
    assert conflict("in May", "", "June was wet") and not conflict("in May", "", "May and June") and not conflict("", None, "June")
    assert conflict("", "under low-light", "tested at high-light") and not conflict("", "under low-light", "low-light and high-light")
    parts = value(spark, C.scope_clauses(F.lit("After training, accuracy rose and recall fell on the dev dataset")))
    assert [(p.time, p.condition) for p in parts] == [(["After training"], []), (["After training"], ["on the dev dataset"])] and parts[1].source == "After training, and recall fell on the dev dataset"
    assert value(spark, C.scope_clauses(F.lit("It rose after May, before June"))) is None
    text = "x rose and y fell"
    assert [text[p.start : p.end] for p in value(spark, C.scope_clauses(F.lit(text)))] == ["x rose ", "and y fell"]
    r = value(spark, C.scope_restrictions(F.lit("It rose after tuning on the big dataset, during May.")))
    assert (r.time, r.condition) == (["after tuning", "during May"], ["on the big dataset"])


def test_screen_looks_at_one_quote_at_a_time(spark):
    find = lambda c, *q: [tuple(x) for x in value(spark, screen.support_findings(F.lit(c), F.array(*[F.lit(x) for x in q])))]
    assert find("The price increased", "Price was 3 dollars", "before audit and 2 dollars after it") == []
    assert find("The price increased after audit", "Price was 3 dollars before audit and 2 dollars after it")[0][0] == "numeric_direction_conflict"
    assert find("Costs rose 7% and staff left and profit grew", "Costs rose") == [("claim_quantity_not_quoted", "7%"), ("conjunct_lexical_gap", "staff left"), ("conjunct_lexical_gap", "profit grew")]
    assert find("The price decreased after audit", "Price was 1" + "0" * 40 + " dollars before audit and 2 dollars after it") == []


def test_tables_refuse_joined_rows_and_read_columns_by_scope(spark):
    text = "Table 2: accuracy of three models\n| model | dev | test |\n|---|---|---|\n| alpha | 5 | 9 |\n| beta | 4 | 10 |\n| gamma | 3 | 1 |\n\nTable 3: other\n| model | accuracy |\n|---|---|\n| delta | 1 |\n| ragged | 2 | 3 |\n| eps | 2 |\n"
    claims = {
        1: "alpha has higher accuracy than beta on dev and test", 2: "On dev, alpha has higher accuracy than beta", 3: "On test, alpha has higher accuracy than beta", 4: "alpha has higher accuracy than beta",
        5: "Among the three models in Table 2, alpha has higher dev than beta", 6: "Among the four models in Table 2, alpha has higher dev than beta", 7: "Among the three systems in Table 2, alpha has higher dev than beta", 8: "alpha has higher dev than beta or gamma",
    }
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    c = spark.createDataFrame([(1, k, v) for k, v in claims.items()], "doc_id int, claim_id int, claim string")
    got = {r.claim_id: r.label for r in tables.compare_rows(c, tables.table_cells(docs)).collect()}
    assert got == {2: "support", 3: "contradict", 5: "support"}


def test_small_faults(spark):
    one = spark.createDataFrame([([10.0, 0.0, 30.0, 5.0],)], "b array<double>")
    assert one.select(boxes.normal_box(F.col("b"), F.lit(0.0), F.lit(0.5)).alias("x")).first().x == [1000, 0, 1000, 1000]
    assert one.select(boxes.normal_box(F.array(F.lit(1e30), F.lit(0.0), F.lit(1.0), F.lit(1.0)), F.lit(10.0), F.lit(10.0)).alias("x")).first().x == [100, 0, 1000, 100]
    df = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 6}") for i in range(40)] + [(99, None)], "doc_id int, key string")
    got = {r.doc_id: r.duplicate for r in metrics.later_duplicates(df, "key", "doc_id").collect()}
    assert [i for i, d in got.items() if not d] == [] or {i for i, d in got.items() if not d} == {0, 1, 2, 4, 99} and len(got) == 41
    docs = spark.createDataFrame([(1, "anaconda snake"), (2, "con artist"), (3, "the da vinci"), (4, "a conda env")], "doc_id int, text string")
    pairs = evidence.span_containment(spark.createDataFrame([(1, "con"), (2, "conda snake"), (3, "conda env")], "span_id int, text string"), docs, "span_id", "doc_id")
    assert {(r.span_id, r.doc_id) for r in pairs.collect()} == {(1, 1), (1, 2), (1, 4), (2, 1), (3, 4)}
