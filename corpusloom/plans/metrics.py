"""Metric queries. Gold: labels; predicted and scores: a documented rule on ids and lengths, as the tables hold no predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import metrics as M
from corpusloom.session import table

LABELS = ["support", "contradict", "not_enough_info"]
BINS = 10


def predictions(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """(doc_id, source, gold, predicted, score): gold is contradict where toxic, else support where of quality."""
    gold = F.when(F.col("toxic") == 1, "contradict").when(F.col("quality") == 1, "support").otherwise("not_enough_info")
    n = F.col("n_chars") + shift
    said = F.when(n % 7 == 0, "not_enough_info").when(n % 11 == 0, "contradict").when(n % 13 == 0, F.lit(None)).otherwise(F.col("gold"))
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id").withColumn("gold", gold).withColumn("predicted", said)
    return rows.select("doc_id", "source", "gold", "predicted", F.when(F.col("n_chars") % 17 != 0, (F.col("doc_id") * 37 % 101) / 100).alias("score"), F.col("gold").eqNullSafe(F.col("predicted")).alias("correct"))


def _rows(shift: int = 0) -> str:
    return f"""(SELECT *, gold IS NOT DISTINCT FROM predicted AS correct FROM (SELECT doc_id, source, gold,
CASE WHEN (n_chars + {shift}) % 7 = 0 THEN 'not_enough_info' WHEN (n_chars + {shift}) % 11 = 0 THEN 'contradict' WHEN (n_chars + {shift}) % 13 = 0 THEN NULL ELSE gold END AS predicted,
CASE WHEN n_chars % 17 <> 0 THEN (doc_id * 37 % 101) / 100 END AS score
FROM (SELECT *, CASE WHEN toxic = 1 THEN 'contradict' WHEN quality = 1 THEN 'support' ELSE 'not_enough_info' END AS gold FROM documents JOIN labels USING (doc_id))))"""


def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return M.classification_report(predictions(spark, sf), LABELS)


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(predictions(spark, sf))


def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf)
    f1 = M.classification_report(rows, LABELS).agg(F.round(F.avg("f1"), 9).alias("macro_f1"))
    other = rows.agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 9).alias("accuracy"), F.count_if(F.col("predicted").isNull()).alias("invalid"))
    return other.crossJoin(f1)  # one row each


def sla_gate(spark: SparkSession, sf: str) -> DataFrame:
    return M.sla_flags(predictions(spark, sf))


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return M.reliability(predictions(spark, sf), BINS)


def ece_brier(spark: SparkSession, sf: str) -> DataFrame:
    return M.calibration_errors(predictions(spark, sf), BINS)


def group_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and accuracy by source and gold, each source, and all, as one rollup."""
    r = predictions(spark, sf).rollup("source", "gold").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"), F.grouping_id().alias("level"))
    return r.select("source", "gold", "n", "right", F.col("level").cast("int").alias("level"))


def paired_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The rule against itself on lengths one larger; every tenth document lacks in the second run."""
    return M.paired_gate(predictions(spark, sf), predictions(spark, sf, 1).where("doc_id % 10 <> 3"), "doc_id")


def label_challenges(spark: SparkSession, sf: str) -> DataFrame:
    """Each labelled row with its right and its wrong label, and whether a score of 0.6 or more trusts it."""
    wrong = F.when(F.col("gold") == "support", "contradict").when(F.col("gold") == "contradict", "support").otherwise("support")
    rows = predictions(spark, sf).select("gold", "score", F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(True).alias("right")), F.struct(wrong.alias("label"), F.lit(False).alias("right")))).alias("c"))
    return rows.groupBy("gold", "c.label", "c.right").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.6).alias("trusted"))


def left_join_missing_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against labels: a document without a label is invalid; labels without a document are extra."""
    d, lab = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality")
    per = d.join(lab, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("invalid"))
    extra = lab.join(d, "doc_id", "left_anti").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("invalid")).select(F.lit("(extra)").alias("source"), "n", "invalid")
    return per.union(extra)


def label_and(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of a source as parts of one claim."""
    return M.label_and(predictions(spark, sf).withColumn("label", F.col("predicted")), "source")


def quantifier_truth(spark: SparkSession, sf: str) -> DataFrame:
    """All, some and none of an order's lines were returned."""
    hit = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(hit).alias("all_true"), F.bool_or(hit).alias("some_true"), (~F.bool_or(hit)).alias("none_true"), F.count("*").alias("members"))


def judge_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).groupBy(F.coalesce("predicted", F.lit("invalid")).alias("verdict")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("verdict", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


def duplicate_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Sources and qualities with their count, and how many rows repeat an earlier one's text length."""
    rows = table(spark, sf, "documents").select("source", "n_chars").groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    return rows.groupBy("source").agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("later_duplicates"))


def span_token_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Multiset token recall of each turn's words in the turn before it, over a conversation."""
    from corpusloom.functions.text import tokens

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(tokens(F.col("text"))).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count("*").alias("n"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), "w", F.col("n").alias("m"))
    j = c.join(before, ["conv_id", "turn", "w"], "left")
    per = j.groupBy("conv_id").agg(F.sum("n").alias("wanted"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("found"))
    return per.select("conv_id", "wanted", "found", F.round(F.col("found") / F.col("wanted"), 9).alias("recall"))


QUERIES = {f.__name__: f for f in (classification_report, confusion_matrix, macro_f1, sla_gate, calibration_bins, ece_brier, group_gate, paired_gate, label_challenges, left_join_missing_invalid, label_and, quantifier_truth, judge_histogram, duplicate_labels, span_token_recall)}
_REPORT = f"""SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1, support FROM (
SELECT label, CASE WHEN said = 0 THEN 0 ELSE tp / said END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r, support FROM (
SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (predicted = label) AS said, count(*) FILTER (gold = label) AS support
FROM (SELECT unnest(['support', 'contradict', 'not_enough_info']) AS label), {_rows()} GROUP BY label))"""
SQL = {
    "classification_report": _REPORT,
    "confusion_matrix": f"SELECT gold, predicted, count(*) AS n FROM {_rows()} GROUP BY ALL",
    "macro_f1": f"SELECT count(*) AS n, round(avg(correct::INT), 9) AS accuracy, count(*) FILTER (predicted IS NULL) AS invalid, (SELECT round(avg(f1), 9) FROM ({_REPORT})) AS macro_f1 FROM {_rows()}",
    "sla_gate": f"""SELECT *, false_support = 0 AS no_false_support, missed * 100 <= answerable * 15 AS abstention_ok, (said_support - false_support) * 100 >= said_support * 90 AS precision_ok FROM (
SELECT count(*) FILTER (predicted = 'support' AND gold <> 'support') AS false_support, count(*) FILTER (predicted = 'support') AS said_support, count(*) FILTER (gold <> 'not_enough_info') AS answerable,
count(*) FILTER (gold <> 'not_enough_info' AND coalesce(predicted, 'not_enough_info') = 'not_enough_info') AS missed FROM {_rows()})""",
    "calibration_bins": f"""SELECT bin, coalesce(n, 0) AS n, mean_score, accuracy FROM (SELECT unnest(range(10))::INT AS bin) LEFT JOIN (
SELECT least(floor(score * 10)::INT, 9) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(correct::INT), 9) AS accuracy FROM {_rows()} WHERE score IS NOT NULL GROUP BY 1) USING (bin)""",
    "ece_brier": f"""SELECT sum(n)::BIGINT AS n, round(sum(abs(s - h)) / sum(n), 9) AS ece, round(sum(b) / sum(n), 9) AS brier FROM (
SELECT least(floor(score * 10)::INT, 9) AS bin, count(*) AS n, sum(score) AS s, sum(correct::INT) AS h, sum((score - correct::INT) ** 2) AS b FROM {_rows()} WHERE score IS NOT NULL GROUP BY 1)""",
    "group_gate": f'SELECT source, gold, count(*) AS n, count(*) FILTER (correct) AS "right", grouping(source, gold)::INT AS level FROM {_rows()} GROUP BY ROLLUP (source, gold)',
    "paired_gate": f"""SELECT *, missing = 0 AND extra = 0 AND lost = 0 AS passed FROM (SELECT count(*) FILTER (b.doc_id IS NOT NULL AND c.doc_id IS NULL) AS missing, count(*) FILTER (b.doc_id IS NULL) AS extra,
count(*) FILTER (b.doc_id IS NOT NULL AND c.doc_id IS NOT NULL AND NOT b.correct AND c.correct) AS won, count(*) FILTER (b.doc_id IS NOT NULL AND c.doc_id IS NOT NULL AND b.correct AND NOT c.correct) AS lost,
count(*) FILTER (b.doc_id IS NOT NULL AND c.doc_id IS NOT NULL AND b.correct = c.correct) AS equal
FROM {_rows()} b FULL JOIN (SELECT * FROM {_rows(1)} WHERE doc_id % 10 <> 3) c ON b.doc_id = c.doc_id)""",
    "label_challenges": f"""SELECT gold, label, "right", count(*) AS n, count(*) FILTER (score >= 0.6) AS trusted FROM (SELECT gold, gold AS label, true AS "right", score FROM {_rows()}
UNION ALL SELECT gold, CASE WHEN gold = 'support' THEN 'contradict' ELSE 'support' END, false, score FROM {_rows()}) GROUP BY ALL""",
    "left_join_missing_invalid": """SELECT source, count(*) AS n, count(*) FILTER (quality IS NULL) AS invalid FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
UNION ALL SELECT '(extra)', count(*), 0 FROM labels ANTI JOIN documents USING (doc_id)""",
    "label_and": f"""SELECT source, count(*) AS parts, CASE WHEN bool_or(coalesce(predicted = 'contradict', false)) THEN 'contradict' WHEN bool_and(coalesce(predicted = 'support', false)) THEN 'support' ELSE 'not_enough_info' END AS label
FROM {_rows()} GROUP BY source""",
    "quantifier_truth": "SELECT l_orderkey, bool_and(l_returnflag = 'R') AS all_true, bool_or(l_returnflag = 'R') AS some_true, NOT bool_or(l_returnflag = 'R') AS none_true, count(*) AS members FROM lineitem GROUP BY l_orderkey",
    "judge_histogram": f"SELECT coalesce(predicted, 'invalid') AS verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM {_rows()} GROUP BY 1",
    "duplicate_labels": "SELECT source, sum(c)::BIGINT AS n, sum(c - 1)::BIGINT AS later_duplicates FROM (SELECT source, n_chars, count(*) AS c FROM documents GROUP BY ALL) GROUP BY source",
    "span_token_recall": """WITH c AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations) GROUP BY ALL)
SELECT conv_id, sum(c.n)::BIGINT AS wanted, sum(least(c.n, coalesce(b.n, 0)))::BIGINT AS found, round(sum(least(c.n, coalesce(b.n, 0))) / sum(c.n), 9) AS recall
FROM c LEFT JOIN (SELECT conv_id AS k, turn + 1 AS t, w AS v, n FROM c) b ON k = conv_id AND t = turn AND v = w GROUP BY conv_id""",
}
