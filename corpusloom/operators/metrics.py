"""Classification, calibration and gate metrics from row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import join_hot

from corpusloom.functions.text import ratio


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Counts of each (gold, predicted); a null prediction is its own column value."""
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def classification_report(rows: DataFrame, labels: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, f1 and support of each label; absent labels and empty ratios are 0."""
    counts = confusion(rows, gold, predicted)
    each = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    per = counts.select("*", each).groupBy("label").agg(
        F.sum(F.when((F.col(gold) == F.col("label")) & (F.col(predicted) == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col(predicted) == F.col("label"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col(gold) == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
    )
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return per.select("label", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(ratio(2 * p * r, p + r), 9).alias("f1"), "support")


def sla_flags(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: false support, support precision and abstention, with flags in whole numbers."""
    support, unknown = F.lit("support"), F.lit("not_enough_info")
    r = rows.agg(
        F.count_if((F.col(predicted) == support) & (F.col(gold) != support)).alias("false_support"),
        F.count_if(F.col(predicted) == support).alias("said_support"),
        F.count_if(F.col(gold) != unknown).alias("answerable"),
        F.count_if((F.col(gold) != unknown) & (F.coalesce(F.col(predicted), unknown) == unknown)).alias("missed"),
    )
    return r.select(
        "*",
        (F.col("false_support") == 0).alias("no_false_support"),
        (F.col("missed") * 100 <= F.col("answerable") * 15).alias("abstention_ok"),
        ((F.col("said_support") - F.col("false_support")) * 100 >= F.col("said_support") * 90).alias("precision_ok"),
    )


def reliability(rows: DataFrame, bins: int, score: str = "score", correct: str = "correct") -> DataFrame:
    """Every bin with its count, mean score and accuracy; empty bins stay, with nulls. 1.0 is in the last."""
    at = F.least((F.col(score) * bins).cast("int"), F.lit(bins - 1))
    found = rows.where(F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg(score), 9).alias("mean_score"), F.round(F.avg(F.col(correct).cast("double")), 9).alias("accuracy")
    )
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "accuracy")


def calibration_errors(rows: DataFrame, bins: int, score: str = "score", correct: str = "correct") -> DataFrame:
    """One row: expected calibration error and Brier score."""
    hit = F.col(correct).cast("double")
    per = rows.where(F.col(score).isNotNull()).groupBy(F.least((F.col(score) * bins).cast("int"), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(hit).alias("h"), F.sum(F.pow(F.col(score) - hit, 2)).alias("b")
    )
    return per.agg(F.sum("n").alias("n"), F.round(F.sum(F.abs(F.col("s") - F.col("h"))) / F.sum("n"), 9).alias("ece"), F.round(F.sum("b") / F.sum("n"), 9).alias("brier"))


def paired_gate(base: DataFrame, new: DataFrame, key: str, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: cases that are only in one run, won, lost and equal ones; the gate passes without losses or missing cases."""
    b = base.select(key, F.col(gold).alias("bg"), F.col(predicted).alias("bp"), F.lit(1).alias("b"))
    n = new.select(key, F.col(gold).alias("ng"), F.col(predicted).alias("np"), F.lit(1).alias("c"))
    j = b.join(n, key, "full_outer")
    was, now = F.col("bp").eqNullSafe(F.col("bg")), F.col("np").eqNullSafe(F.col("ng"))
    both = F.col("b").isNotNull() & F.col("c").isNotNull()
    r = j.agg(
        F.count_if(F.col("c").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"),
        F.count_if(both & ~was & now).alias("won"), F.count_if(both & was & ~now).alias("lost"), F.count_if(both & (was == now)).alias("equal"),
    )
    return r.select("*", ((F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("lost") == 0)).alias("passed"))


def label_and(parts: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Three-valued AND of part labels: any contradiction, else support by all, else not enough information."""
    value = F.when(F.bool_or(F.coalesce(F.col(label) == "contradict", F.lit(False))), "contradict").when(F.bool_and(F.coalesce(F.col(label) == "support", F.lit(False))), "support")
    return parts.groupBy(group).agg(F.count("*").alias("parts"), value.otherwise("not_enough_info").alias("label"))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def required_keys(rows: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """One row: required keys that lack, others that are there, repeats, and whether rows have exactly the required ones, once each."""
    have = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    named = lambda df, mark: df.select(*keys, F.lit(1).alias(mark))
    j = have.withColumn("h", F.lit(1)).join(named(required.distinct(), "r"), keys, "full_outer")
    r = j.agg(F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"))
    return r.select("*", ((F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("repeated") == 0)).alias("exact"))


def positional_join(a: DataFrame, b: DataFrame, ordinal: str, check: str) -> DataFrame:
    """Rows of ``a`` and ``b`` (its columns with _b) at the same ordinal; another ``check`` value at an ordinal, or a side without it, is an error."""
    renamed = b.select(*[F.col(c).alias(c if c == ordinal else f"{c}_b") for c in b.columns], F.lit(1).alias("__b"))
    j = a.withColumn("__a", F.lit(1)).join(renamed, ordinal, "full_outer")
    good = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col(check).eqNullSafe(F.col(f"{check}_b"))
    return j.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("rows differ at "), F.col(ordinal).cast("string"))).cast("boolean"))).drop("__a", "__b", f"{check}_b")


def evidence_rates(rows: DataFrame, spans: str = "spans", context: str = "context", answerable: str = "answerable", supported: str = "supported") -> DataFrame:
    """One row: spans, their share that is verbatim in the context, and shares of answerable and other rows said to be supported; null where there are none."""
    each = F.filter(F.coalesce(F.col(spans), F.array().cast("array<string>")), lambda s: s.isNotNull())
    yes = F.coalesce(F.col(supported), F.lit(False))
    r = rows.agg(
        F.count("*").alias("n"), F.sum(F.size(each)).alias("evidence_spans"), F.sum(F.size(F.filter(each, lambda s: F.contains(F.col(context), s)))).alias("found"),
        F.count_if(F.col(answerable)).alias("a"), F.count_if(F.col(answerable) & yes).alias("a_yes"), F.count_if(~F.col(answerable)).alias("u"), F.count_if(~F.col(answerable) & yes).alias("u_yes"),
    )
    share = lambda p, w: F.round(F.try_divide(p, w), 9)
    return r.select("n", "evidence_spans", share("found", "evidence_spans").alias("verbatim_rate"), share("a_yes", "a").alias("answerable_supported"), share("u_yes", "u").alias("unanswerable_supported"))


def diagnostics(rows: DataFrame, threshold: float) -> DataFrame:
    """One row over (gold, predicted, status, score, calls): failures, false support, support from ``threshold`` on with coverage and precision, and whether calibration may be stated: only if no row failed."""
    accepted = (F.col("status") == "ok") & (F.col("predicted") == "support") & (F.col("score") >= threshold)
    wrong = F.col("gold") != "support"
    r = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if((F.col("predicted") == "support") & wrong).alias("false_support"),
        F.count_if(accepted).alias("accepted"), F.count_if(accepted & wrong).alias("false_accepted"), F.sum("calls").alias("calls"),
    )
    return r.select("*", F.round(F.try_divide("accepted", "n"), 9).alias("coverage"), F.round(1 - F.try_divide("false_accepted", "accepted"), 9).alias("precision"), ((F.col("n") > 0) & (F.col("failed") == 0)).alias("calibrated"))


def row_issues(rows: DataFrame, labels: list[str]) -> DataFrame:
    """``rows`` (label, claim, context, reasoning, indices, sentences) with issues, every one that holds, in a fixed order."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    none = F.col("label") == "not_enough_info"
    indices, sentences = F.coalesce(F.size("indices"), F.lit(0)), F.coalesce(F.size("sentences"), F.lit(0))
    found = [
        (~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "invalid_label"), (blank("claim"), "empty_claim"), (blank("context"), "empty_context"), (blank("reasoning"), "empty_reasoning"),
        (indices != sentences, "index_text_length"), (none & ((indices > 0) | (sentences > 0)), "nei_with_evidence"), (~none & (sentences <= 0), "labelled_without_evidence"),
        (F.coalesce(F.exists("sentences", lambda s: ~F.contains(F.col("context"), F.trim(s))), F.lit(False)), "not_verbatim"),
    ]
    return rows.withColumn("issues", F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in found])))


def later_duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with duplicate: whether a row of a smaller ``order`` has the same key; null keys are none, rows equal in both are one row.

    Only keys that come more than once are looked up, those of many rows by a broadcast, so that none gathers in a task.
    """
    firsts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"), F.count("*").alias("__rows")).where("__rows > 1")
    found = join_hot(rows, firsts, key, "__rows")
    return found.withColumn("duplicate", F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__first", "__rows")


def router_report(rows: DataFrame) -> DataFrame:
    """One row over (expected, chosen, said_relevant, is_relevant; a null chosen is a parse error): accuracy with parse errors in its denominator, precision of 'irrelevant', parse error rate and whether all pass."""
    read = F.col("chosen").isNotNull()
    no = read & ~F.coalesce("said_relevant", F.lit(True))
    r = rows.agg(F.count("*").alias("n"), F.count_if(read & (F.col("chosen") == F.col("expected"))).alias("right"), F.count_if(no).alias("no"), F.count_if(no & ~F.col("is_relevant")).alias("no_right"), F.count_if(~read).alias("errors"))
    a, p, e = ratio(F.col("right"), F.col("n")), ratio(F.col("no_right"), F.col("no")), ratio(F.col("errors"), F.col("n"))
    return r.select("n", F.round(a, 9).alias("accuracy"), F.round(p, 9).alias("critique_precision"), F.round(e, 9).alias("parse_error_rate"), ((F.col("right") * 10 >= F.col("n") * 8) & (F.col("no_right") * 4 >= F.col("no") * 3) & (F.col("no") > 0) & (F.col("errors") == 0)).alias("passed"))


def recovery_report(attempts: DataFrame) -> DataFrame:
    """One row over (case, expected, attempt, tool, success): share of cases whose first tool was right, and of the others that succeeded in the end; null without others."""
    per = attempts.groupBy("case").agg(F.min_by("tool", "attempt").alias("first"), F.first("expected").alias("expected"), F.bool_or("success").alias("done"))
    right = F.coalesce(F.col("first") == F.col("expected"), F.lit(False))
    r = per.agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(~right & F.col("done")).alias("recovered"))
    return r.select("n", F.round(ratio(F.col("right"), F.col("n")), 9).alias("accuracy"), F.round(F.try_divide(F.col("recovered"), F.col("n") - F.col("right")), 9).alias("recovery_rate"))


def nli_veto(label: Column, entailment: Column, contradiction: Column, neutral: Column, least: float) -> Column:
    """The label if its own score is at least ``least`` and strictly the largest, else not_enough_info."""
    support = (label == "support") & (entailment >= least) & (entailment > contradiction) & (entailment > neutral)
    against = (label == "contradict") & (contradiction >= least) & (contradiction > entailment) & (contradiction > neutral)
    return F.when(F.coalesce(support | against, F.lit(False)), label).otherwise("not_enough_info")


def judge_agreement(label: Column, judged: Column, quoted: Column, lacking: Column) -> Column:
    """(agrees, verified, status) of a verdict beside a judge's; a null label is no verdict; quoted and lacking: quotes and missing facts there are."""
    agrees = F.coalesce(label == judged, F.lit(False))
    status = F.when(~agrees | (lacking > 0) | (label == "not_enough_info"), "needs_context").otherwise("label_agreement")
    return F.struct(agrees.alias("agrees"), (agrees & (judged == "support") & (quoted > 0) & (lacking == 0)).alias("verified"), status.alias("status"))


def probe_gate(outputs: DataFrame, cases: DataFrame, least_valid: int, most_calls: int) -> DataFrame:
    """One row on a probe of cases (example_id) by outputs (example_id, status, calls): counts, three checks and whether all pass.

    Checks: every case has one output and none is unknown, exactly ``least_valid`` are completed, calls are ``most_calls`` at most.
    """
    o = outputs.groupBy("example_id").agg(F.count("*").alias("k"), F.count_if(F.col("status") == "completed").alias("v"), F.sum("calls").alias("c"))
    j = o.join(cases.select("example_id").distinct().withColumn("asked", F.lit(True)), "example_id", "full_outer")
    per = j.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("valid"), F.coalesce(F.sum("c"), F.lit(0)).alias("calls"), F.count_if(F.col("k").isNull() | F.col("asked").isNull() | (F.col("k") > 1)).alias("off")
    )
    per = per.select("n", "valid", (F.col("n") - F.col("valid")).alias("incomplete"), "calls", (F.col("off") == 0).alias("all_present"), (F.col("valid") == least_valid).alias("all_valid"), (F.col("calls") <= most_calls).alias("within_calls"))
    return per.withColumn("passes", F.col("all_present") & F.col("all_valid") & F.col("within_calls"))
