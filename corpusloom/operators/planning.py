"""Research plans and next actions of many sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms of a comparison, words before its dimension, marks of a pointer and of a question for a place.
PAIR = r"(?i)(?:compare|so sánh)\s+(.+?)\s+(?:and|versus|vs\.?|với|và)\s+(.+?)(?:[?.!]|$)"
DIMENSION = r"(?i)\s+(?:in terms of|with respect to|on|về|theo)\s+.*$"
PLACE = r"(?i)\bwhere\b|ở đâu|phần nào|mục nào"
POINTER = r"(?i)(?:\b(?:reported|provided|described|found|available)\s+in\s+(?:the\s+)?|\bsee\s+(?:the\s+)?)(?:appendix|supplement|table|section)\b"
FAILED = ("reader_failed", "retrieval_failed", "summary_failed", "writer_failed")


def create_plan(question: Column) -> Column:
    """Tasks (task_id, question, query, kind, depends_on) of a question: two subjects and their synthesis for a comparison, one for each of two to four questions, else one."""
    left = F.trim(F.regexp_extract(question, PAIR, 1))
    right = F.regexp_replace(F.trim(F.regexp_extract(question, PAIR, 2)), DIMENSION, "")
    none = F.array().cast("array<string>")
    task = lambda i, q, query, kind, needs: F.struct(i.alias("task_id"), q.alias("question"), query.alias("query"), F.lit(kind).alias("kind"), needs.alias("depends_on"))
    about = lambda s: F.concat(F.lit("Evidence about "), s, F.lit(". Research goal: "), question)
    pair = F.array(task(F.lit("t1"), about(left), left, "evidence", none), task(F.lit("t2"), about(right), right, "evidence", none), task(F.lit("synthesis"), question, F.lit(""), "synthesis", F.array(F.lit("t1"), F.lit("t2"))))
    parts = F.transform(F.filter(F.transform(F.split(question, r"\?"), lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.concat(p, F.lit("?")))
    listed = F.when(F.size(parts).between(2, 4), parts).otherwise(F.array(question))
    single = F.transform(listed, lambda q, i: task(F.concat(F.lit("t"), (i + 1).cast("string")), q, q, "evidence", none))
    return F.when(F.regexp_extract(question, PAIR, 1) != "", pair).otherwise(single)


def plan_issues(tasks: DataFrame, plan: str = "plan", pos: str = "pos") -> DataFrame:
    """(plan, issue) of ``tasks`` (plan, pos, task_id, kind, depends_on): null where there are one to six tasks, ids are unique, each depends on earlier ones and a synthesis on some."""
    needs = tasks.select(plan, pos, "kind", F.explode_outer("depends_on").alias("need"))
    known = tasks.select(F.col(plan).alias("__p"), F.col("task_id").alias("__t"), F.col(pos).alias("__o"))
    met = needs.join(known, (F.col(plan) == F.col("__p")) & (F.col("need") == F.col("__t")) & (F.col("__o") < F.col(pos)), "left")
    bad = met.groupBy(plan).agg(F.bool_or(F.col("need").isNotNull() & F.col("__t").isNull()).alias("unmet"), F.bool_or((F.col("kind") == "synthesis") & F.col("need").isNull()).alias("bare"))
    size = tasks.groupBy(plan).agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("ids"))
    issue = F.when(F.col("n") > 6, "too_many_tasks").when((F.col("ids") < F.col("n")) | F.col("unmet"), "not_unique_or_not_earlier").when(F.col("bare"), "synthesis_without_evidence")
    return size.join(bad, plan).select(plan, issue.alias("issue"))


def plan_complete(tasks: DataFrame, plan: str = "plan", status: str = "status") -> DataFrame:
    """(plan, complete): whether there is a task and all are complete."""
    return tasks.groupBy(plan).agg(F.bool_and(F.coalesce(F.col(status) == "complete", F.lit(False))).alias("complete"))


def coverage_gap(question: Column, answer: Column) -> Column:
    """empty, bare_number or pointer_only where an answer obviously isn't one; null otherwise."""
    bare = F.trim(F.coalesce(answer, F.lit("")))
    pointer = ~question.rlike(PLACE) & answer.rlike(POINTER) & (F.size(F.split(bare, r"\s+")) <= 18) & ~answer.rlike(r"\d")
    return F.when(bare == "", "empty").when(bare.rlike(r"^[\d\s.,%+\-]+$"), "bare_number").when(pointer, "pointer_only")


def choose_action(s: dict[str, Column]) -> Column:
    """(action, reason) of a session's state, first rule first.

    ``s``: stop_reason, status, has_pdf, read_any, pages_left, n_evidence, unmatched_spans, plan_complete, agent, suggested,
    check_budget_spent, check_failed, searches, max_searches, history. Missing flags and counts read as false and 0.
    """
    flag = lambda c: F.coalesce(s[c], F.lit(False))
    count = lambda c: F.coalesce(s[c], F.lit(0))
    status, suggested = s["status"], F.coalesce(s["suggested"], F.lit(""))
    say = lambda action, reason: F.struct(F.lit(action).alias("action"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    rules = [
        (s["stop_reason"].isNotNull() & (s["stop_reason"] != ""), say("stop", s["stop_reason"])),
        (status == "invalid_input", say("stop", "invalid_input")),
        ((status == "ready") & flag("has_pdf") & ~flag("read_any"), say("read", "inspect_question_relevant_pages")),
        (status == "retrieved", say("summarize", "synthesize_available_evidence")),
        (status == "summary_ready", say("factcheck", "verify_claims_and_observed_conflicts")),
        ((status == "summary_unverified") & (count("n_evidence") >= 2) & ~flag("unmatched_spans"), say("factcheck", "audit_unverified_source_statements")),
        ((status == "verified") & flag("plan_complete"), say("write", "write_from_verified_claims")),
        ((status == "completed") & flag("plan_complete"), say("stop", "task_completed")),
        (suggested == "ask_clarify", say("stop", "needs_clarification")),
        (status.isin(*FAILED), say("stop", status)),
        (flag("check_budget_spent"), say("stop", "factcheck_budget_exhausted")),
        (flag("check_failed"), say("stop", "factchecker_failed")),
        ((F.coalesce(s["agent"], F.lit("")) == "write") & (suggested != "search"), say("stop", "partial_report")),
        (count("searches") >= s["max_searches"], say("stop", "search_budget_exhausted")),
        (flag("has_pdf") & (count("pages_left") > 0) & ~status.isin("ready", "read_ready"), say("read", "inspect_unread_pages_for_missing_evidence")),
    ]
    last = say("search", F.when(count("history") > 0, "retrieve_missing_evidence").otherwise("initial_evidence_search"))
    out = None
    for when, then in rules:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(last)


def limit_issue(b: dict[str, Column]) -> Column:
    """Why a budget (max_steps, max_seconds, max_cost, bounds: map of action to cost) is invalid; null where it is valid."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    cost, bounds = b["max_cost"], b["bounds"]
    known = F.array(*[F.lit(a) for a in ("read", "search", "summarize", "factcheck", "write")])
    named = F.map_keys(bounds)
    return (
        F.when(~b["max_steps"].between(1, 200), "max_steps")
        .when(~finite(b["max_seconds"]) | (b["max_seconds"] <= 0), "max_seconds")
        .when(cost.isNotNull() & (~finite(cost) | (cost < 0)), "max_cost")
        .when((F.size(F.array_except(named, known)) > 0) | F.exists(F.map_values(bounds), lambda v: ~finite(v) | (v < 0)), "bounds")
        .when(cost.isNotNull() & (F.size(F.array_except(known, named)) > 0), "bounds_missing")
    )
