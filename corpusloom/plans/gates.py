"""Queries of validators and gates. Rows and predictions follow documented rules on ids, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import metrics as M
from corpusloom.plans.metrics import predictions
from corpusloom.session import table


def evidence_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Spans: a text's first 40 characters, and the next 40 in capitals."""
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").where("text is not null").select(
        F.array(F.substring("text", 1, 40), F.upper(F.substring("text", 41, 40))).alias("spans"), F.col("text").alias("context"), (k % 4 != 0).alias("answerable"), F.when(k % 3 != 0, k % 2 == 0).alias("supported")
    )
    return M.evidence_rates(rows)


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions without a score have failed; calls: one to three by id."""
    p = predictions(spark, sf)
    return M.diagnostics(p.select("gold", "predicted", F.when(F.col("score").isNull(), "confidence_failed").otherwise("ok").alias("status"), "score", (F.col("doc_id") % 3 + 1).alias("calls")), 0.6)


def row_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as labelled rows, with faults by id; counts of each issue."""
    k = F.col("doc_id")
    first = F.substring("text", 1, 30)
    rows = table(spark, sf, "documents").select(
        F.when(k % 13 == 0, "perhaps").when(k % 2 == 0, "support").otherwise("not_enough_info").alias("label"), F.when(k % 17 == 0, "  ").otherwise("A claim").alias("claim"), F.col("text").alias("context"), F.when(k % 19 != 0, "why").alias("reasoning"),
        F.when(k % 2 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("indices"), F.when((k % 2 == 0) & (k % 5 != 0), F.array(F.when(k % 3 == 0, "no such sentence").otherwise(first))).otherwise(F.array().cast("array<string>")).alias("sentences"),
    )
    found = M.row_issues(rows, ["support", "contradict", "not_enough_info"]).select(F.explode("issues").alias("issue"))
    return found.groupBy("issue").agg(F.count("*").alias("n"))


def later_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text an earlier one has."""
    d = M.later_duplicates(table(spark, sf, "documents").where("text is not null").select("doc_id", "source", F.md5("text").alias("key")), "key", "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if("duplicate").alias("later"))


def router_report(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    tool = lambda v: F.when(v == 0, "bm25").otherwise("dense")
    return M.router_report(table(spark, sf, "orders").select(tool(k % 2).alias("expected"), F.when(k % 10 != 9, tool((k + (k % 7 == 0).cast("int")) % 2)).alias("chosen"), (k % 3 == 0).alias("said_relevant"), (k % 4 == 0).alias("is_relevant")))


def recovery_report(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as attempts at it, in the order of their numbers."""
    return M.recovery_report(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case"), F.lit("R").alias("expected"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey").cast("long") * 1000 + F.col("l_quantity").cast("int")).alias("attempt"), F.col("l_returnflag").alias("tool"), (F.col("l_quantity") > 25).alias("success")))


def nli_vetoes(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that follow from an order's key, and a judge that contradicts every fourth."""
    k = F.col("o_orderkey")
    label = F.when(k % 3 == 0, "support").when(k % 3 == 1, "contradict").otherwise("not_enough_info")
    kept = M.nli_veto(label, (k % 10) / 10, (k % 9) / 10, (k % 8) / 10, 0.5)
    agreed = M.judge_agreement(F.when(k % 11 != 0, kept), F.when(k % 4 == 0, "contradict").otherwise("support"), k % 2, k % 5)
    rows = table(spark, sf, "orders").select(kept.alias("label"), agreed.alias("a"))
    return rows.groupBy("label", "a.agrees", "a.verified", "a.status").agg(F.count("*").alias("n"))


def required_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Source and language pairs of documents against all pairs of both in large sources."""
    d = table(spark, sf, "documents")
    some = d.groupBy("source").count().where("count > 10").select("source")
    required = some.join(F.broadcast(d.select("lang").where("lang is not null").distinct()))  # a few languages
    return M.required_keys(d.select("source", "lang"), required, ["source", "lang"])


def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and their copies by ordinal: a sum over pairs that must agree in key."""
    a = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_orderkey", "l_quantity").groupBy("at", "l_orderkey").agg(F.sum("l_quantity").alias("q"))
    j = M.positional_join(a, a, "at", "l_orderkey")
    return j.agg(F.count("*").alias("n"), F.round(F.sum(F.col("q") * F.col("q_b")), 2).cast("double").alias("product"))


QUERIES = {f.__name__: f for f in (evidence_rates, diagnostics, row_issues, later_duplicates, router_report, recovery_report, nli_vetoes, required_keys, positional_join)}
_PRED = "(SELECT doc_id, n_chars, CASE WHEN toxic = 1 THEN 'contradict' WHEN quality = 1 THEN 'support' ELSE 'not_enough_info' END AS gold FROM documents JOIN labels USING (doc_id))"
SQL = {
    "evidence_rates": """WITH d AS (SELECT doc_id AS k, text, upper(substr(text, 41, 40)) AS u, coalesce(doc_id % 3 <> 0 AND doc_id % 2 = 0, false) AS y FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS n, count(*) * 2 AS evidence_spans, round((count(*) + count(*) FILTER (contains(text, u))) / (count(*) * 2), 9) AS verbatim_rate, round(count(*) FILTER (k % 4 <> 0 AND y) / count(*) FILTER (k % 4 <> 0), 9) AS answerable_supported,
round(count(*) FILTER (k % 4 = 0 AND y) / count(*) FILTER (k % 4 = 0), 9) AS unanswerable_supported FROM d""",
    "diagnostics": f"""WITH p AS (SELECT gold, CASE WHEN n_chars % 7 = 0 THEN 'not_enough_info' WHEN n_chars % 11 = 0 THEN 'contradict' WHEN n_chars % 13 = 0 THEN NULL ELSE gold END AS predicted, CASE WHEN n_chars % 17 <> 0 THEN (doc_id * 37 % 101) / 100 END AS score, doc_id % 3 + 1 AS calls FROM {_PRED}),
r AS (SELECT count(*) AS n, count(*) FILTER (score IS NULL) AS failed, count(*) FILTER (predicted = 'support' AND gold <> 'support') AS false_support, count(*) FILTER (predicted = 'support' AND score >= 0.6) AS accepted, count(*) FILTER (predicted = 'support' AND score >= 0.6 AND gold <> 'support') AS false_accepted, sum(calls)::BIGINT AS calls FROM p)
SELECT *, round(accepted / n, 9) AS coverage, round(1 - false_accepted / nullif(accepted, 0), 9) AS "precision", n > 0 AND failed = 0 AS calibrated FROM r""",
    "row_issues": """WITH d AS (SELECT doc_id AS k, text, substr(text, 1, 30) AS f, doc_id % 2 = 0 AND doc_id % 5 <> 0 AS has, CASE WHEN doc_id % 13 = 0 THEN 'perhaps' WHEN doc_id % 2 = 0 THEN 'support' ELSE 'not_enough_info' END AS label FROM documents),
i AS (SELECT unnest([CASE WHEN label = 'perhaps' THEN 'invalid_label' END, CASE WHEN k % 17 = 0 THEN 'empty_claim' END, CASE WHEN coalesce(trim(text, ' '), '') = '' THEN 'empty_context' END, CASE WHEN k % 19 = 0 THEN 'empty_reasoning' END, CASE WHEN k % 2 = 0 AND NOT has THEN 'index_text_length' END, CASE WHEN label <> 'not_enough_info' AND NOT has THEN 'labelled_without_evidence' END,
CASE WHEN has AND NOT contains(text, CASE WHEN k % 3 = 0 THEN 'no such sentence' ELSE trim(f, ' ') END) THEN 'not_verbatim' END]) AS issue FROM d)
SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue""",
    "later_duplicates": "SELECT source, count(*) AS n, count(*) FILTER (r > 1) AS later FROM (SELECT source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) GROUP BY source",
    "router_report": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 <> 9 AS ok FROM orders), r AS (SELECT count(*) AS n, count(*) FILTER (ok AND k % 7 <> 0) AS good, count(*) FILTER (ok AND k % 3 <> 0) AS no, count(*) FILTER (ok AND k % 3 <> 0 AND k % 4 <> 0) AS no_right, count(*) FILTER (NOT ok) AS errors FROM o)
SELECT n, round(good / n, 9) AS accuracy, round(CASE WHEN no = 0 THEN 0 ELSE no_right / no END, 9) AS critique_precision, round(errors / n, 9) AS parse_error_rate, good * 10 >= n * 8 AND no_right * 4 >= no * 3 AND no > 0 AND errors = 0 AS passed FROM r""",
    "recovery_report": """WITH p AS (SELECT l_orderkey, arg_min(l_returnflag, l_linenumber::BIGINT * 1000000000 + l_partkey::BIGINT * 1000 + l_quantity::INT) = 'R' AS good, bool_or(l_quantity > 25) AS done FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(count(*) FILTER (good) / count(*), 9) AS accuracy, round(count(*) FILTER (NOT good AND done) / nullif(count(*) FILTER (NOT good), 0), 9) AS recovery_rate FROM p""",
    "nli_vetoes": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 AS e, o_orderkey % 9 AS c, o_orderkey % 8 AS u FROM orders),
v AS (SELECT k, CASE WHEN k % 3 = 0 AND e >= 5 AND e > c AND e > u THEN 'support' WHEN k % 3 = 1 AND c >= 5 AND c > e AND c > u THEN 'contradict' ELSE 'not_enough_info' END AS label FROM o),
j AS (SELECT *, k % 11 <> 0 AND label = CASE WHEN k % 4 = 0 THEN 'contradict' ELSE 'support' END AS agrees FROM v)
SELECT label, agrees, agrees AND k % 4 <> 0 AND k % 2 > 0 AND k % 5 = 0 AS verified, CASE WHEN NOT agrees OR k % 5 > 0 OR (label = 'not_enough_info' AND k % 11 <> 0) THEN 'needs_context' ELSE 'label_agreement' END AS status, count(*) AS n FROM j GROUP BY ALL""",
    "required_keys": """WITH h AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT source, lang FROM (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 10), (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
j AS (SELECT n, h.source IS NOT NULL AND n IS NOT NULL AS have, r.source IS NOT NULL AS need FROM h FULL JOIN r ON h.source = r.source AND h.lang = r.lang)
SELECT count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (NOT need) AS extra, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n IS NULL OR NOT need OR n > 1) = 0 AS exact FROM j""",
    "positional_join": "SELECT count(*) AS n, round(sum(q * q), 2)::DOUBLE AS product FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)",
}
