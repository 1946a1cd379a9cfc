"""Queries on claims against sources. Claims are written from the tables' columns, so that the SQL can tell from these what is right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import grammar as G
from corpusloom.operators import boxes as B
from corpusloom.operators import planning as P
from corpusloom.operators import screen, tables
from corpusloom.operators import papers as PP
from corpusloom.session import materialize, table


def claim_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities of a sentence about each line, without the number that names a table."""
    i = lambda c: F.col(c).cast("int").cast("string")
    text = F.concat(F.lit("Line "), i("l_linenumber"), F.lit(" of Table "), (F.col("l_orderkey") % 9).cast("string"), F.lit(" sold "), i("l_quantity"), F.lit(" units at "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("% off"))
    q = table(spark, sf, "lineitem").select("l_returnflag", F.explode_outer(G.quantities(G.reference_free(text))).alias("q")).where("q is not null")
    return q.groupBy("l_returnflag", "q.kind").agg(F.count("*").alias("n"), F.sum("q.value").cast("long").alias("total"))


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b = F.round("o_totalprice").cast("long"), F.when(k % 3 == 0, F.round("o_totalprice").cast("long")).otherwise(F.round("o_totalprice").cast("long") + (k % 5) * 10 - 20)
    claim = F.concat(F.lit("The price "), F.when(k % 2 == 0, "increased").otherwise("decreased"), F.lit(" after audit"), F.when(k % 7 == 0, " and quality holds").otherwise(F.when(k % 11 == 0, " of 5 rows").otherwise("")))
    quote = F.concat(F.lit("Price was "), a.cast("string"), F.lit(" dollars before audit and "), b.cast("string"), F.when(k % 13 == 0, " euros after it.").otherwise(" dollars after it."))
    return table(spark, sf, "orders").select("o_orderkey", claim.alias("claim"), F.array(quote).alias("quotes"))


def support_screen(spark: SparkSession, sf: str) -> DataFrame:
    m = _measured(spark, sf).select("o_orderkey", screen.support_flags(F.col("claim"), F.col("quotes")).alias("flags"))
    return m.select("o_orderkey", F.array_join("flags", ",").alias("flags"))


def _nation_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A text with a table for each region: its nations with their customers and suppliers."""
    count = lambda t, c: table(spark, sf, t).groupBy(F.col(c).alias("n_nationkey")).agg(F.count("*").alias(t))
    n = table(spark, sf, "nation").join(count("customer", "c_nationkey"), "n_nationkey", "left").join(count("supplier", "s_nationkey"), "n_nationkey", "left").na.fill(0)
    line = F.concat_ws(" | ", "n_name", "customer", "supplier", F.concat((F.col("customer") % 7).cast("string"), F.lit("%")))
    t = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", line.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |"))), "\n")
    text = F.concat(F.lit("Some text before.\n\nTable "), F.col("n_regionkey").cast("string"), F.lit(". Nations of the region.\n| nation | customers | suppliers | MAE |\n|---|---|---|---|\n"), body, F.lit("\n\nText after."))
    return t.select(F.col("n_regionkey").alias("doc_id"), text.alias("text"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    m = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("other"), "n_regionkey")
    return n.join(m, "n_regionkey").where("n_nationkey <> k2").select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") * 100 + F.col("k2")).alias("claim_id"), "n_name", "other", "n_nationkey", "k2")


def table_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Claims on two nations of a region each; those that name a table of another region aren't decided."""
    k = F.col("n_nationkey")
    how = F.when(k % 3 == 0, "higher").when(k % 3 == 1, "fewer").otherwise("equal")
    claim = F.concat("n_name", F.lit(" has "), how, F.when(F.col("k2") % 2 == 0, " customers").otherwise(" suppliers"), F.when(k % 3 == 2, " to ").otherwise(" than "), "other", F.when(F.col("claim_id") % 5 == 0, " in Table 9").otherwise(""))
    c = _pairs(spark, sf).select("doc_id", "claim_id", claim.alias("claim"))
    cells = materialize(tables.table_cells(_nation_tables(spark, sf)), "cells")
    return tables.compare_rows(c, cells)


def table_leader(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation is said to lead its region's five in customers."""
    n = table(spark, sf, "nation")
    size = n.groupBy("n_regionkey").agg(F.count("*").alias("count"))
    c = n.join(size, "n_regionkey").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("claim_id"), F.initcap("n_name").alias("member"), F.lit("Customers").alias("metric"), "count")
    return tables.refute_lead(c, materialize(tables.table_cells(_nation_tables(spark, sf)), "cells")).select("claim_id", "label")


def table_preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation is said to beat the others of its region on mean absolute error, which is a count modulo 7 here."""
    c = _pairs(spark, sf).select("doc_id", "claim_id", F.col("n_name").alias("subject"), F.col("other").alias("baseline"), F.array(F.lit("the mean absolute error")).alias("metrics"))
    return tables.compare_preferences(c, materialize(tables.table_cells(_nation_tables(spark, sf)), "cells"))


def metric_columns(spark: SparkSession, sf: str) -> DataFrame:
    m = tables.metric_column(tables.table_cells(_nation_tables(spark, sf)))
    return m.groupBy("doc_id", "header").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


def structured_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's claim of a line count of at least, at most or exactly a number, against the counts of its lines' facts; some subjects or units differ."""
    o = F.col("o_orderkey")
    req = table(spark, sf, "orders").select(
        o.alias("claim_id"), F.lit(1).alias("req"), F.concat(F.lit("the order "), o.cast("string")).alias("subject"), F.lit("order").alias("subject_key"), F.lit("lines").alias("property"), F.lit("all").alias("scope"),
        F.when(o % 3 == 0, "ge").when(o % 3 == 1, "le").otherwise("eq").alias("relation"), F.lit(4).cast("decimal(38,10)").alias("value"), F.lit("lines").alias("unit"),
    )
    k = F.col("l_orderkey")
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    facts = n.select(
        k.alias("claim_id"), F.concat(F.lit("Order "), (k + (k % 17 == 0).cast("int")).cast("string")).alias("subject"), F.lit("order").alias("subject_key"), F.lit("lines").alias("property"), F.lit("all").alias("scope"),
        F.when(k % 5 == 0, "ge").otherwise("eq").alias("relation"), F.col("n").cast("decimal(38,10)").alias("value"), F.when(k % 7 == 0, "items").otherwise("lines").alias("unit"), F.lit(1).alias("spans"),
    )
    return screen.decide(req, facts)


def plan_issues(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as a plan: each needs the line before it, some a later one; a line of the seventh supplier is a synthesis without needs."""
    line = F.col("l_linenumber")
    needs = F.when((line == 1) | (F.col("l_suppkey") % 7 == 0), F.array().cast("array<string>")).when(F.col("l_partkey") % 11 == 0, F.array((line + 1).cast("string"))).otherwise(F.array((line - 1).cast("string")))
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan"), line.alias("pos"), line.cast("string").alias("task_id"), F.when(F.col("l_suppkey") % 7 == 0, "synthesis").otherwise("evidence").alias("kind"), needs.alias("depends_on"))
    return P.plan_issues(t)


def next_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of decisions on states that orders stand for."""
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(s) for s in ("ready", "retrieved", "summary_ready", "summary_unverified", "verified", "completed", "writer_failed", "other")])
    s = {
        "stop_reason": F.when(k % 29 == 0, "asked"), "status": F.get(names, (F.col("o_custkey") % 8).cast("int")), "has_pdf": k % 3 == 0, "read_any": k % 2 == 0, "pages_left": k % 4, "n_evidence": k % 5, "unmatched_spans": k % 7 == 0,
        "plan_complete": k % 2 == 1, "agent": F.when(k % 13 == 0, "write"), "suggested": F.when(k % 17 == 0, "ask_clarify").when(k % 19 == 0, "search"), "check_budget_spent": k % 23 == 0, "check_failed": k % 31 == 0,
        "searches": k % 6, "max_searches": F.lit(5), "history": k % 2,
    }
    return table(spark, sf, "orders").select(P.choose_action(s).alias("d")).groupBy("d.action", "d.reason").agg(F.count("*").alias("n"))


def answer_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in four forms to questions for a place or a fact."""
    k = F.col("o_orderkey")
    q = F.when(k % 2 == 0, "Where is it reported?").otherwise("What was the total?")
    a = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(" %"))).when(k % 5 == 2, "The total is reported in the appendix.").when(k % 5 == 3, F.concat(F.lit("It is found in section "), k.cast("string"))).otherwise("The total was large.")
    return table(spark, sf, "orders").select((k % 10).alias("kind"), P.coverage_gap(q, a).alias("gap")).groupBy("kind", "gap").agg(F.count("*").alias("n"))


def question_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Plans of questions on a nation, on two nations, and of several parts."""
    k = F.col("c_custkey")
    name = F.col("c_mktsegment")
    q = F.when(k % 3 == 0, F.concat(F.lit("Compare "), name, F.lit(" and retail in terms of cost?"))).when(k % 3 == 1, F.concat(F.lit("What is "), name, F.lit("? How large is it?"))).otherwise(F.concat(F.lit("What is "), name, F.lit("?")))
    t = table(spark, sf, "customer").select("c_custkey", F.posexplode(P.create_plan(q)).alias("pos", "t"))
    return t.groupBy("t.task_id", "t.query", "t.kind").agg(F.count("*").alias("n"), F.sum(F.size("t.depends_on")).alias("needs"))


def normal_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes from a line's numbers on a page of 600 by 800, some beyond it."""
    box = F.array(*[F.col(c).cast("double") for c in ("l_suppkey", "l_partkey", "l_quantity", "l_linenumber")])
    b = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.get(B.page_boxes(F.array(box), F.lit(600.0), F.lit(800.0)), F.lit(0)).alias("b"))
    return b.select("l_orderkey", "l_linenumber", *[F.col("b")[i].alias(f"b{i}") for i in range(4)])


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as papers: their lines are paragraphs; evidence is the first line, that of odd ids also a figure's, that of every fifth a line that isn't there."""
    k = F.col("doc_id")
    lines = F.filter(F.split("text", "\n"), lambda x: F.lit(True))
    ev = F.array_compact(F.array(F.get(lines, F.lit(0)), F.when(k % 2 == 1, "FLOAT SELECTED: Table 1"), F.when(k % 5 == 0, "no such line"), F.get(lines, F.lit(1))))
    answer = F.struct((k % 7 == 0).alias("unanswerable"), F.when(k % 3 == 0, True).alias("yes_no"), ev.alias("evidence"), F.array().cast("array<string>").alias("highlighted_evidence"))
    other = F.struct(F.lit(False).alias("unanswerable"), F.when(k % 11 == 0, False).alias("yes_no"), F.array(F.get(lines, F.lit(0))).alias("evidence"), F.array().cast("array<string>").alias("highlighted_evidence"))
    return table(spark, sf, "documents").where("text is not null").select(
        k.cast("string").alias("paper_id"), F.lit("T").alias("title"), F.array(F.struct(F.lit("s").alias("section_name"), lines.alias("paragraphs"))).alias("full_text"),
        F.array(F.struct(F.lit("Why?").alias("question"), F.lit("q").alias("question_id"), F.array(answer, other).alias("answers"))).alias("qas"),
    )


def paper_claims(spark: SparkSession, sf: str) -> DataFrame:
    c = PP.extract_claims(_papers(spark, sf))
    return c.select("paper_id", F.size("claims").alias("n"), F.transform("claims", lambda x: F.length(x["text"])).alias("chars"), F.transform("claims", lambda x: x["source_id"]).alias("sources"), "dropped_visual", "dropped_unmatched", "dropped_long")


def paper_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return PP.paragraphs(_papers(spark, sf)).groupBy("paper_id").agg(F.count("*").alias("n"), F.max("p_no").alias("last"), F.sum(F.length("text")).alias("chars"))


def training_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each task and split, with the claims that they cite."""
    rows = PP.training_rows(PP.extract_claims(_papers(spark, sf)), F.when(F.col("paper_id").cast("long") % 4 == 0, "validation").otherwise("train"))
    return rows.groupBy("task", "split", "label_origin").agg(F.count("*").alias("n"), F.sum(F.size("cited")).alias("cited"))


QUERIES = {f.__name__: f for f in (claim_quantities, support_screen, table_comparison, table_leader, table_preferences, metric_columns, structured_facts, plan_issues, next_actions, answer_gaps, question_plans, normal_boxes, paper_claims, paper_paragraphs, training_tasks)}
_NATIONS = """
WITH n AS (SELECT n_nationkey AS k, n_name, n_regionkey AS r, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation)"""
_PAIRS = _NATIONS + ", p AS (SELECT a.k * 100 + b.k AS claim_id, a.k AS k, b.k AS k2, a.c AS ac, b.c AS bc, a.s AS a_s, b.s AS b_s FROM n a JOIN n b ON a.r = b.r AND a.k <> b.k)"
_CLAIMS = """
WITH d AS (SELECT doc_id AS k, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, k % 7 = 0 AS un, (k % 3 = 0 AND k % 11 = 0) OR k % 7 = 0 AS bad FROM d),
e AS (SELECT k, 1 AS o, l[1] AS t FROM a WHERE NOT bad UNION ALL SELECT k, 2, l[2] FROM a WHERE NOT bad AND len(l) > 1),
f AS (SELECT k, o, t, list_position(l, t) - 1 AS p FROM e JOIN a USING (k)),
g AS (SELECT *, row_number() OVER (PARTITION BY k, t ORDER BY o) AS nth FROM f),
c AS (SELECT k, list(length(t) ORDER BY o) AS chars, list('qasper:' || k || ':paragraph:' || p ORDER BY o) AS sources FROM g WHERE nth = 1 AND length(t) <= 900 AND NOT starts_with(ltrim(t), 'FLOAT SELECTED') GROUP BY k),
lo AS (SELECT k, count(*) AS n FROM (SELECT k, l[1] AS t FROM a WHERE NOT bad UNION ALL SELECT k, l[2] FROM a WHERE NOT bad AND len(l) > 1 UNION ALL SELECT k, l[1] FROM a WHERE NOT bad) WHERE length(t) > 900 GROUP BY k),
z AS (SELECT a.k::VARCHAR AS paper_id, coalesce(len(chars), 0) AS n, coalesce(chars, []) AS chars, coalesce(sources, []) AS sources, (NOT bad AND a.k % 2 = 1)::INT AS dropped_visual, (NOT bad AND a.k % 5 = 0)::INT AS dropped_unmatched, coalesce(lo.n, 0) AS dropped_long, a.k AS id FROM a LEFT JOIN c USING (k) LEFT JOIN lo USING (k))"""
SQL = {
    "claim_quantities": """WITH q AS (SELECT l_returnflag, l_linenumber::INT AS a, l_quantity::INT AS b, round(l_discount * 100)::INT AS c FROM lineitem),
x AS (SELECT l_returnflag, 'number' AS kind, a AS v FROM q UNION ALL SELECT l_returnflag, 'number', b FROM q WHERE a <> b UNION ALL SELECT l_returnflag, 'percent', c FROM q)
SELECT l_returnflag, kind, count(*) AS n, sum(v)::BIGINT AS total FROM x GROUP BY ALL""",
    "support_screen": """WITH o AS (SELECT o_orderkey AS k, round(o_totalprice)::BIGINT AS a, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice)::BIGINT ELSE round(o_totalprice)::BIGINT + (o_orderkey % 5) * 10 - 20 END AS b FROM orders),
f AS (SELECT k, CASE WHEN k % 7 <> 0 AND k % 11 = 0 AND 5 NOT IN (a, b) THEN 'claim_quantity_not_quoted' END AS q, CASE WHEN k % 7 = 0 THEN 'conjunct_lexical_gap' END AS g,
CASE WHEN k % 7 = 0 THEN NULL WHEN k % 13 = 0 THEN 'numeric_units_require_review' WHEN (k % 2 = 0 AND b <= a) OR (k % 2 = 1 AND b >= a) THEN 'numeric_direction_conflict' END AS d FROM o)
SELECT k AS o_orderkey, concat_ws(',', q, g, d) AS flags FROM f""",
    "table_comparison": _PAIRS
    + """ SELECT claim_id, CASE WHEN CASE k % 3 WHEN 0 THEN x > y WHEN 1 THEN x < y ELSE x = y END THEN 'support' ELSE 'contradict' END AS label
FROM (SELECT *, CASE WHEN k2 % 2 = 0 THEN ac ELSE a_s END AS x, CASE WHEN k2 % 2 = 0 THEN bc ELSE b_s END AS y FROM p) WHERE claim_id % 5 <> 0""",
    "table_leader": _NATIONS + " SELECT k AS claim_id, 'contradict' AS label FROM n WHERE c < (SELECT max(c) FROM n m WHERE m.r = n.r)",
    "table_preferences": _PAIRS + " SELECT claim_id, CASE WHEN ac % 7 < bc % 7 THEN 'support' ELSE 'contradict' END AS label FROM p",
    "metric_columns": _NATIONS + " SELECT r AS doc_id, header, count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT r, 'customers' AS header, c AS v FROM n UNION ALL SELECT r, 'suppliers', s FROM n UNION ALL SELECT r, 'MAE', c % 7 FROM n) GROUP BY ALL",
    "structured_facts": """WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey AS k, n, n IS NOT NULL AND o_orderkey % 17 <> 0 AND o_orderkey % 7 <> 0 AS ok, o_orderkey % 5 = 0 AS ge FROM orders LEFT JOIN n ON n.k = o_orderkey)
SELECT k AS claim_id, 1 AS req, CASE WHEN NOT ok THEN 'not_enough_info'
WHEN k % 3 = 0 THEN CASE WHEN n >= 4 THEN 'support' WHEN ge THEN 'not_enough_info' ELSE 'contradict' END
WHEN k % 3 = 1 THEN CASE WHEN n > 4 THEN 'contradict' WHEN ge THEN 'not_enough_info' ELSE 'support' END
ELSE CASE WHEN ge THEN CASE WHEN n > 4 THEN 'contradict' ELSE 'not_enough_info' END WHEN n = 4 THEN 'support' ELSE 'contradict' END END AS label FROM j""",
    "plan_issues": """WITH t AS (SELECT l_orderkey AS plan, l_linenumber AS pos, l_suppkey % 7 = 0 AS syn, CASE WHEN l_linenumber = 1 OR l_suppkey % 7 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN l_linenumber + 1 ELSE l_linenumber - 1 END AS need FROM lineitem),
m AS (SELECT t.plan, bool_or(t.need IS NOT NULL AND (t.need > t.pos OR u.pos IS NULL)) AS unmet, bool_or(t.syn) AS bare FROM t LEFT JOIN t u ON u.plan = t.plan AND u.pos = t.need GROUP BY t.plan),
c AS (SELECT plan, count(*) AS n, count(DISTINCT pos) AS ids FROM t GROUP BY plan)
SELECT plan, CASE WHEN n > 6 THEN 'too_many_tasks' WHEN ids < n OR unmet THEN 'not_unique_or_not_earlier' WHEN bare THEN 'synthesis_without_evidence' END AS issue FROM m JOIN c USING (plan)""",
    "next_actions": """WITH s AS (SELECT o_orderkey AS k, ['ready', 'retrieved', 'summary_ready', 'summary_unverified', 'verified', 'completed', 'writer_failed', 'other'][o_custkey % 8 + 1] AS st FROM orders),
d AS (SELECT CASE WHEN k % 29 = 0 THEN ['stop', 'asked'] WHEN st = 'ready' AND k % 3 = 0 AND k % 2 <> 0 THEN ['read', 'inspect_question_relevant_pages'] WHEN st = 'retrieved' THEN ['summarize', 'synthesize_available_evidence']
WHEN st = 'summary_ready' THEN ['factcheck', 'verify_claims_and_observed_conflicts'] WHEN st = 'summary_unverified' AND k % 5 >= 2 AND k % 7 <> 0 THEN ['factcheck', 'audit_unverified_source_statements']
WHEN st = 'verified' AND k % 2 = 1 THEN ['write', 'write_from_verified_claims'] WHEN st = 'completed' AND k % 2 = 1 THEN ['stop', 'task_completed'] WHEN k % 17 = 0 THEN ['stop', 'needs_clarification']
WHEN st = 'writer_failed' THEN ['stop', st] WHEN k % 23 = 0 THEN ['stop', 'factcheck_budget_exhausted'] WHEN k % 31 = 0 THEN ['stop', 'factchecker_failed'] WHEN k % 13 = 0 AND k % 19 <> 0 THEN ['stop', 'partial_report']
WHEN k % 6 >= 5 THEN ['stop', 'search_budget_exhausted'] WHEN k % 3 = 0 AND k % 4 > 0 AND st <> 'ready' THEN ['read', 'inspect_unread_pages_for_missing_evidence'] WHEN k % 2 > 0 THEN ['search', 'retrieve_missing_evidence'] ELSE ['search', 'initial_evidence_search'] END AS d FROM s)
SELECT d[1] AS action, d[2] AS reason, count(*) AS n FROM d GROUP BY ALL""",
    "answer_gaps": "SELECT o_orderkey % 10 AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'bare_number' WHEN 2 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'pointer_only' END END AS gap, count(*) AS n FROM orders GROUP BY ALL",
    "question_plans": """WITH t AS (SELECT c_mktsegment AS m, c_custkey % 3 AS k FROM customer)
SELECT task_id, query, kind, count(*) AS n, sum(needs)::BIGINT AS needs FROM (SELECT 't1' AS task_id, m AS query, 'evidence' AS kind, 0 AS needs FROM t WHERE k = 0 UNION ALL SELECT 't2', 'retail', 'evidence', 0 FROM t WHERE k = 0 UNION ALL SELECT 'synthesis', '', 'synthesis', 2 FROM t WHERE k = 0
UNION ALL SELECT 't1', 'What is ' || m || '?', 'evidence', 0 FROM t WHERE k = 1 UNION ALL SELECT 't2', 'How large is it?', 'evidence', 0 FROM t WHERE k = 1 UNION ALL SELECT 't1', 'What is ' || m || '?', 'evidence', 0 FROM t WHERE k = 2) GROUP BY ALL""",
    "normal_boxes": """WITH b AS (SELECT l_orderkey, l_linenumber, least(greatest(trunc(l_suppkey * 1000 / 600.0::DOUBLE)::INT, 0), 1000) AS x0, least(greatest(trunc(l_partkey * 1000 / 800.0::DOUBLE)::INT, 0), 1000) AS y0,
least(greatest(trunc((l_suppkey::DOUBLE + l_quantity::DOUBLE) * 1000 / 600.0::DOUBLE)::INT, 0), 1000) AS x1, least(greatest(trunc((l_partkey::DOUBLE + l_linenumber::DOUBLE) * 1000 / 800.0::DOUBLE)::INT, 0), 1000) AS y1 FROM lineitem)
SELECT l_orderkey, l_linenumber, least(x0, x1) AS b0, least(y0, y1) AS b1, greatest(x0, x1) AS b2, greatest(y0, y1) AS b3 FROM b""",
    "paper_claims": _CLAIMS + " SELECT paper_id, n, chars, sources, dropped_visual, dropped_unmatched, dropped_long FROM z",
    "paper_paragraphs": "SELECT doc_id::VARCHAR AS paper_id, len(string_split(text, chr(10))) AS n, len(string_split(text, chr(10))) - 1 AS last, length(replace(text, chr(10), '')) AS chars FROM documents WHERE text IS NOT NULL",
    "training_tasks": _CLAIMS
    + """, s AS (SELECT n, CASE WHEN id % 4 = 0 THEN 'validation' ELSE 'train' END AS split FROM z)
SELECT task, split, label_origin, count(*) AS n, sum(c)::BIGINT AS cited FROM (SELECT 'report' AS task, split, 'derived_evidence_quote' AS label_origin, least(n, 2) AS c FROM s UNION ALL SELECT 'critic', split, 'derived_evidence_quote', least(n, 2) FROM s
UNION ALL SELECT 'critic', split, 'synthetic_unsupported', 1 FROM s WHERE n > 0 UNION ALL SELECT 'action', split, 'synthetic_reselection', 1 FROM s WHERE n > 1) GROUP BY ALL""",
}
