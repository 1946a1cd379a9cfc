"""What clauses say of members: the truth of a claim's predicate in a clause, evidence that fits a member, and members' truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.clauses import MISSING, clauses, contains_words, scope_conflict
from corpusloom.functions.grammar import direction

#: Words of rise, fall and standing still, words that leave a clause open, and where joined results are cut.
UP = r"(?i)\b(?:improv(?:ed|es?)|increas(?:ed|es?)|rose|raised|gained|higher|better)\b"
DOWN = r"(?i)\b(?:decreas(?:ed|es?)|reduc(?:ed|es?)|fell|lowered|lost|worsened|worse|slower|less accurate)\b"
SAME = r"(?i)\b(?:unchanged|stayed the same|did not improve)\b"
OPEN = r"(?i)\b(?:hypothetical|would|could|may|might|should|if|expected|predicted|approximately|about|planned|proposed|alleged|claimed|disputed|false|incorrect|denied|retracted|not true|which|who)\b"
MAY_MONTH = r"(?i)\b(?:in|during)\s+May\b"
LEAKED, NOT_LEAKED = r"(?i)\bleaked\b", r"(?i)\b(?:no leaks?|did not leak|never leaked|had no leaks?)\b"
JOINED = r"(?i)\band\s+(?=(?:one|two|three|four|five|each|every|all|the third)\b[^.;]*\b(?:improved|reduced|gained|lost|increased|decreased)\b)"


def local_clauses(text: Column) -> Column:
    """``clauses``, cut at "and" before another count's result too; lists of names and objects stay together."""
    parts = F.flatten(F.transform(clauses(text), lambda c: F.split(c, JOINED)))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ ,]+|[ ,]+$", "")), lambda p: p != "")


def names_metric(metric: Column, text: Column) -> Column:
    """Whether a text names a metric, as its words or, for recall and leaks, another form of them."""
    low = F.lower(metric)
    return contains_words(metric, text) | ((low == "recall") & text.rlike(r"(?i)\brecalling\b")) | (low.isin("leak", "leaks", "leaked") & text.rlike(r"(?i)\bleak(?:ed|s)?\b"))


def requested_direction(quote: Column) -> Column:
    """The one direction that a claim's quote asks for; improve and gain ask for an increase."""
    return F.coalesce(direction(quote, loose=True), F.when(quote.rlike(r"(?i)\b(?:improv\w*|gain\w*)\b"), "increase"))


def predicate_truth(metric: Column, quote: Column, time: Column, condition: Column, text: Column) -> Column:
    """Whether a clause makes a claim's positive predicate true or false, whatever its quantifier; null where it doesn't say.

    Clauses that speak of missing data, may or would, another month or the opposite condition say nothing, nor do negated ones
    but for what stayed as it was. A metric of leaking is true by leaked and false by its denial; other predicates take the
    metric (improved stands for any) and one direction, which is compared with the claim's.
    """
    bare = F.regexp_replace(text, MAY_MONTH, "")
    shut = text.rlike(MISSING) | bare.rlike(OPEN) | scope_conflict(time, condition, text)
    leak = F.when(text.rlike(NOT_LEAKED), False).when(text.rlike(LEAKED), True)
    asked = requested_direction(quote)
    same = text.rlike(SAME)
    up = text.rlike(UP) & ~text.rlike(r"(?i)\bdid not improve\b")
    ways = F.array_compact(F.array(F.when(up, "increase"), F.when(text.rlike(DOWN), "decrease"), F.when(same, "unchanged")))
    denied = text.rlike(r"(?i)\b(?:not|never|no)\b") & ~same
    moved = F.when((F.size(ways) == 1) & ~denied & asked.isNotNull() & ((F.lower(metric) == "improved") | names_metric(metric, text)), F.get(ways, F.lit(0)) == asked)
    return F.when(~shut, F.when(F.lower(metric).isin("leak", "leaks", "leaked"), leak).otherwise(moved))


def citation_issues(observations: DataFrame) -> DataFrame:
    """``observations`` (member, quotes: array, truth: true, false or unknown, metric, quote, time, condition) with issue.

    Issues, first of: observation_evidence_unbound (no cited clause names the member), observation_scope_mismatch (all that do are
    of another scope), observation_polarity_mismatch (those that say anything agree on the other truth); null for unknown.
    """
    own = F.filter(F.flatten(F.transform("quotes", local_clauses)), lambda c: contains_words(F.col("member"), c))
    o = observations.withColumn("__own", own)
    says = F.array_distinct(F.array_compact(F.transform("__own", lambda c: predicate_truth(F.col("metric"), F.col("quote"), F.col("time"), F.col("condition"), c))))
    off = F.forall("__own", lambda c: scope_conflict(F.col("time"), F.col("condition"), c))
    o = o.withColumn("__says", says)
    wrong = (F.size("__says") == 1) & (F.get("__says", F.lit(0)) != (F.col("truth") == "true"))
    issue = F.when(F.col("truth") == "unknown", F.lit(None).cast("string")).when(F.size("__own") == 0, "observation_evidence_unbound").when(off, "observation_scope_mismatch").when(wrong, "observation_polarity_mismatch")
    return o.withColumn("issue", issue).drop("__own", "__says")


def member_truths(parts: DataFrame, stated: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, member, truth) of the named members of stated populations (``populations.stated_populations``), where their clauses agree.

    parts: (case, metric, quote, time, condition). What this gives is what ``populations.closed_truth`` takes as observations.
    """
    j = stated.select(case, F.explode("names").alias("member"), "text").join(parts, case)
    each = j.select(case, "member", F.explode(F.filter(local_clauses(F.col("text")), lambda c: contains_words(F.col("member"), c))).alias("clause"), "metric", "quote", "time", "condition")
    told = each.select(case, "member", predicate_truth(*[F.col(c) for c in ("metric", "quote", "time", "condition", "clause")]).alias("truth")).where("truth is not null")
    return told.groupBy(case, "member").agg(F.when(F.min("truth") == F.max("truth"), F.min("truth")).alias("truth")).where("truth is not null")


