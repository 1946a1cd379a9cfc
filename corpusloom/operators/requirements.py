"""Requirements of a claim: their quotes bound to spans, the claim's content that no span covers, and unbound conditions.

Spans and tokens meet by one sort of each claim's rows (a sweep), never as a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.grammar import FUNCTION_WORDS
from corpusloom.functions.spans import quote_places, token_spans

#: Words that open a condition, cues that a relation needs, and what a relation takes.
CONDITIONS = ("without", "despite", "regardless of", "although", "even though", "at the cost of")
CUES = {
    "not": "no not never without neither nor",
    "only": "only solely exclusively just",
    "gt": "above greater higher more over exceeds",
    "lt": "below less lower under fewer",
    "ge": "least minimum ≥",
    "le": "most maximum ≤",
    "before": "before prior first followed phases steps",
    "respectively": "respectively",
}
RELATIONS = ("eq", "not", "only", "gt", "lt", "ge", "le", "includes", "before", "transition", "respectively")
NEGATIONS = ("no", "not", "never", "without", "neither", "nor")


def islands(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by, start, end) of the unions of overlapping or touching spans; nested ones vanish, empty ones are none."""
    w = Window.partitionBy(*by).orderBy(start, end)
    fine = spans.where(F.col(start) < F.col(end)).select(*by, start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = fine.withColumn("__new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    return new.withColumn("__at", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "__at").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__at")


def gaps(spans: DataFrame, whole: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by, start, end): what ``spans`` leave of each range of ``whole``, whose ranges of a key are disjoint; parts outside don't count.

    A range without spans is a gap as a whole.
    """
    # What no span covers, between minus and plus infinity (null), by one sort of a key's spans; ranges are cut out of that.
    w = Window.partitionBy(*by).orderBy(start, end)
    fine = spans.where(F.col(start) < F.col(end)).select(*by, start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    edges = fine.withColumn("__reach", reach).withColumn("__last", F.lead(start).over(w).isNull())
    before = F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), F.struct(F.col("__reach").alias("s"), F.col(start).alias("e")))
    after = F.when(F.col("__last"), F.struct(F.greatest("__reach", end).alias("s"), F.lit(None).cast(fine.schema[start].dataType).alias("e")))
    free = edges.select(*by, F.explode_outer(F.array(before, after)).alias("g")).where("g is not null").select(*by, "g.s", "g.e")
    met = whole.select(*by, F.col(start).alias("__lo"), F.col(end).alias("__hi")).join(free, by, "left")
    return met.select(*by, F.greatest("__lo", "s").alias(start), F.least("__hi", "e").alias(end)).where(F.col(start) < F.col(end))


def _enclosed(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (by, start, end, ...) with ``inside``: whether one of ``spans`` (by, start, end) holds them whole."""
    other = [c for c in rows.columns if c not in (*by, "start", "end")]
    both = rows.withColumn("__span", F.lit(0)).unionByName(spans.select(*by, "start", "end").withColumn("__span", F.lit(1)), allowMissingColumns=True)
    # Spans that start at or before a row come first; the farthest end among them decides.
    reach = F.max(F.when(F.col("__span") == 1, F.col("end"))).over(Window.partitionBy(*by).orderBy("start", F.desc("__span")).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("inside", F.coalesce(reach >= F.col("end"), F.lit(False))).where("__span = 0").select(*by, "start", "end", *other, "inside")


def bind_quotes(claims: DataFrame, quotes: DataFrame, claim_id: str = "claim_id", text: str = "text") -> DataFrame:
    """``quotes`` (claim_id, quote, ...) with start, end and issue.

    issue: empty_quote, quote_not_in_claim, ambiguous_quote (more than one place), partial_token_span (it cuts a token); null
    where the quote is bound. All quotes of a claim are looked for in one pass over it.
    """
    by_claim = quotes.select(claim_id, "quote").where("quote is not null").distinct().groupBy(claim_id).agg(F.collect_list("quote").alias("qs"))
    read = claims.join(by_claim, claim_id).select(claim_id, "qs", quote_places("qs", text).alias("ps"), token_spans(F.col(text)).alias("ts"))
    each = read.select(claim_id, "ts", F.explode(F.arrays_zip("qs", "ps")).alias("x"))
    at = F.get(F.col("x.ps"), F.lit(0))
    end = at + F.length("x.qs")
    cuts = F.exists("ts", lambda t: ((t["start"] < at) & (at < t["end"])) | ((t["start"] < end) & (end < t["end"])))
    n = F.size("x.ps")
    issue = F.when(n == 0, "quote_not_in_claim").when(n > 1, "ambiguous_quote").when(cuts, "partial_token_span")
    found = each.select(claim_id, F.col("x.qs").alias("quote"), F.when(issue.isNull(), at).alias("start"), F.when(issue.isNull(), end).alias("end"), issue.alias("__issue"), F.lit(True).alias("__read"))
    out = quotes.join(found, [claim_id, "quote"], "left")
    blank = F.coalesce(F.trim("quote"), F.lit("")) == ""
    return out.withColumn("issue", F.when(blank, "empty_quote").when(F.col("__read").isNull(), "quote_not_in_claim").otherwise(F.col("__issue"))).drop("__issue", "__read")


def _is_content(token: Column) -> Column:
    return ~F.lower(token).isin(*FUNCTION_WORDS) & (token.rlike(r"[\p{L}\p{N}]") | token.isin("%", "≥", "≤"))


def claim_coverage(claims: DataFrame, spans: DataFrame, claim_id: str = "claim_id", text: str = "text") -> DataFrame:
    """(claim_id, n_tokens, uncovered, issue): the content tokens of each claim that no union of its spans covers.

    Content is what has a letter or digit and is no function word, and the marks %, ≥ and ≤. uncovered: (start, end, token)
    in order; issue: uncovered_claim_content, or null. Null and empty claims have no tokens.
    """
    read = claims.select(claim_id, F.explode_outer(token_spans(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    tokens = read.where("t is not null").select(claim_id, "t.start", "t.end", "t.token")
    checked = _enclosed(tokens, islands(spans.select(claim_id, "start", "end"), [claim_id]), [claim_id])
    left = F.when(~F.col("inside") & _is_content(F.col("token")), F.struct("start", "end", "token"))
    per = checked.groupBy(claim_id).agg(F.count("*").alias("n_tokens"), F.array_sort(F.collect_list(left)).alias("uncovered"))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    out = claims.select(claim_id).join(per, claim_id, "left").select(claim_id, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("uncovered", none).alias("uncovered"))
    return out.withColumn("issue", F.when(F.size("uncovered") > 0, "uncovered_claim_content"))


def unbound_conditions(claims: DataFrame, qualifiers: DataFrame, claim_id: str = "claim_id", text: str = "text") -> DataFrame:
    """(claim_id, start, end, cue) of words that open a condition and lie in none of the claim's scope or cue spans (claim_id, start, end)."""
    tokens = claims.select(claim_id, token_spans(F.col(text)).alias("ts"))
    low = F.transform("ts", lambda t: F.lower(t["token"]))
    many = tokens.withColumn("low", low)

    def places(cue: str) -> Column:
        n = len(cue.split())
        at = F.when(F.size("ts") >= n, F.sequence(F.lit(1), F.size("ts") - n + 1)).otherwise(F.array().cast("array<int>"))
        at = F.filter(at, lambda i: F.array_join(F.slice("low", i, n), " ") == cue)
        return F.transform(at, lambda i: F.struct(F.element_at("ts", i)["start"].alias("start"), F.element_at("ts", i + n - 1)["end"].alias("end"), F.lit(cue).alias("cue")))

    found = many.select(claim_id, F.explode(F.concat(*map(places, CONDITIONS))).alias("c")).select(claim_id, "c.start", "c.end", "c.cue")
    return _enclosed(found, qualifiers.select(claim_id, "start", "end"), [claim_id]).where("not inside").drop("inside")


def fact_issue(relation: Column, cue: Column, subjects: Column, values: Column, of_claim: Column) -> Column:
    """Why a fact's parts don't fit its relation, or null.

    subjects: array of (start, end); values: array of (kind: text, number or reference, text, start, end), in the order given.
    """
    n, kinds = F.size(values), F.transform(values, lambda v: v["kind"])
    every = lambda kind: F.forall(kinds, lambda k: k == kind)
    words = lambda t: F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"[^\s\w]|\w+"), F.lit(0)), F.lower)
    needs = F.create_map(*[F.lit(x) for k, v in CUES.items() for x in (k, v)])[relation]
    ordered = lambda a: F.forall(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: (F.size(a) < 2) | (F.element_at(a, i)["end"] <= F.element_at(a, F.least(i + 1, F.size(a)))["start"]))
    compares = relation.isin("gt", "lt", "ge", "le")
    negated = F.exists(values, lambda v: F.arrays_overlap(words(v["text"]), F.array(*[F.lit(w) for w in NEGATIONS])))
    return (
        F.when(~relation.isin(*RELATIONS) | (of_claim & (relation == "respectively")), "invalid_relation")
        .when(needs.isNotNull() & ~F.arrays_overlap(words(cue), F.split(needs, " ")), "unbound_relation_cue")
        .when(n == 0, "invalid_structured_list")
        .when(~F.forall(kinds, lambda k: k.isin("text", "number") | (of_claim & (k == "reference"))), "invalid_value_kind")
        .when((relation == "respectively") & ((F.size(subjects) != n) | (n < 2) | ~ordered(subjects) | ~ordered(values)), "invalid_parallel_alignment")
        .when((relation != "respectively") & (F.size(subjects) != 1), "unexpected_multiple_subjects")
        .when(compares & ((n != 1) | F.exists(kinds, lambda k: k == "text")), "invalid_comparison_operand")
        .when((relation == "before") & ((n != 2) | ~every("text")), "invalid_order_operands")
        .when((relation == "before") & ~ordered(values), "reversed_order_operands")
        .when((relation == "transition") & ((n != 2) | ~every("number")), "invalid_transition_operands")
        .when((relation == "eq") & ~ordered(values), "reversed_value_operands")
        .when(~compares & F.exists(kinds, lambda k: k == "reference"), "invalid_reference_operand")
        .when((relation != "not") & negated, "unrepresented_negation")
    )
