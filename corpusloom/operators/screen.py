"""Support screen and structured facts: flags that ask for a review, and requirements decided by observed facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import grammar as G

#: A measurement before and after an event, words that qualify a claim, names that mean the authors, negations.
BEFORE_AFTER = rf"(?i)([A-Za-z][A-Za-z -]{{0,70}})\s+(?:was|is)\s+({G.NUMBER})\s+([A-Za-z]+)\s+before\s+([A-Za-z -]{{1,60}}?)\s+and\s+({G.NUMBER})\s+([A-Za-z]+)\s+after\b"
QUALIFIED = r"(?i)\b(?:not|never|no|none|all|every|each|some|at least|one or more)\b"
AUTHORS = ("authors", "our", "we", "proposed", "paper")


def bound_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def support_findings(claim: Column, quotes: Column) -> Column:
    """(code, fragment) of each thing that a support verdict's quotes (array) leave open.

    claim_quantity_not_quoted: quantities of the claim that no quote has, as fragment; conjunct_lexical_gap: a part of a joined
    claim without a word of the quotes; numeric_scope_requires_review, numeric_units_require_review, numeric_direction_conflict:
    the one measurement before and after an event that one of the quotes states, by itself, and that quote's words.
    """
    none = F.array().cast("array<struct<code:string,fragment:string>>")
    finding = lambda code, fragment: F.struct(F.lit(code).alias("code"), fragment.alias("fragment"))
    parts = F.split(claim, r"(?i)\s+and\s+")
    quoted = F.array_join(quotes, "\n")
    # A measurement is one quote's; joined quotes would make new ones.
    hits = F.flatten(F.transform(quotes, lambda q: F.regexp_extract_all(q, F.lit(BEFORE_AFTER), F.lit(0))))

    def gap(missing: Column) -> Column:
        return F.when(F.size(missing) > 0, F.array(finding("claim_quantity_not_quoted", F.array_join(F.transform(missing, lambda m: F.concat(m["exact"], F.when(m["kind"] == "percent", "%").otherwise(""))), ", ")))).otherwise(none)

    def lexical(seen: Column) -> Column:
        bare = F.filter(parts, lambda p: bound_once(G.content_words(p), lambda w: (F.size(w) > 0) & ~F.arrays_overlap(w, seen)))
        return F.when(F.size(parts) > 1, F.transform(bare, lambda p: finding("conjunct_lexical_gap", p))).otherwise(none)

    def measured(hit: Column) -> Column:
        part = lambda g: F.regexp_extract(hit, BEFORE_AFTER, g)
        spelled = [G.canonical(part(g)) for g in (2, 5)]
        return F.struct(hit.alias("quote"), part(1).alias("metric"), part(4).alias("event"), (F.lower(part(3)) != F.lower(part(6))).alias("units"), *[s.alias(n) for s, n in zip(spelled, ("was", "now"))])

    def numeric(m: Column) -> Column:
        terms = G.content_words(claim)
        out_of_scope = ~F.arrays_overlap(G.content_words(m["metric"]), terms) | (F.size(F.array_except(G.content_words(m["event"]), terms)) > 0)
        before, after = G.exact_decimal(m["was"]), G.exact_decimal(m["now"])
        moved = F.when(m["was"] == m["now"], "unchanged").when(after > before, "increase").when(after < before, "decrease")
        code = F.when(out_of_scope, "numeric_scope_requires_review").when(m["units"], "numeric_units_require_review").when(moved != G.direction(claim), "numeric_direction_conflict")
        return F.when(code.isNotNull(), F.array(F.struct(code.alias("code"), m["quote"].alias("fragment")))).otherwise(none)

    ready = (F.size(parts) == 1) & ~claim.rlike(QUALIFIED) & G.direction(claim).isNotNull()
    one = bound_once(hits, lambda h: F.when(F.size(h) == 1, bound_once(measured(F.get(h, F.lit(0))), numeric)).otherwise(none))
    lexical_gaps = F.when(F.size(parts) > 1, bound_once(G.content_words(quoted), lexical)).otherwise(none)
    return F.concat(bound_once(G.missing_quantities(claim, quoted), gap), lexical_gaps, F.when(ready, one).otherwise(none))


def support_flags(claim: Column, quotes: Column) -> Column:
    """The distinct codes of ``support_findings``."""
    return F.array_distinct(F.transform(support_findings(claim, quotes), lambda f: f["code"]))


def same_subject(left: Column, right: Column, left_key: Column, right_key: Column, spans: Column) -> Column:
    """Whether two mentions name one thing: equal words; with equal numbers, equal keys and a shared word, an author's reference or a second evidence span; or an equal last word and three quarters of the words."""
    a, b = G.key_tokens(left), G.key_tokens(right)
    one, two = F.array_distinct(a), F.array_distinct(b)
    digits = lambda w: F.array_sort(F.filter(w, lambda t: t.rlike("[0-9]")))
    authors = F.array(*[F.lit(w) for w in AUTHORS])
    anchored = F.arrays_overlap(one, two) | (F.arrays_overlap(one, authors) & F.arrays_overlap(two, authors)) | (spans > 1)
    near = (F.element_at(a, -1) == F.element_at(b, -1)) & (F.size(F.array_intersect(one, two)) * 4 >= F.size(F.array_union(one, two)) * 3)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), False).when(a == b, True).when(digits(one) != digits(two), False).when(left_key == right_key, anchored).otherwise(near)


def decide(requirements: DataFrame, facts: DataFrame, claim_id: str = "claim_id") -> DataFrame:
    """(claim_id, req, label) of scalar requirements: support or contradict where all facts that compare agree, else not_enough_info.

    requirements: (claim_id, req, subject, subject_key, property, scope, relation, value, unit); facts: the same but req, with
    spans (number of evidence spans). They meet on claim, property and scope, then by subject; a unit or a relation that
    isn't comparable gives no vote.
    """
    f = facts.select(claim_id, "property", "scope", *[F.col(c).alias(f"f_{c}") for c in ("subject", "subject_key", "relation", "value", "unit", "spans")])
    j = requirements.join(f, [claim_id, "property", "scope"], "left")
    alike = same_subject(F.col("subject"), F.col("f_subject"), F.col("subject_key"), F.col("f_subject_key"), F.col("f_spans"))
    scalar = lambda c: F.col(c).isin("eq", "only", "gt", "ge", "lt", "le")
    asked, seen = G.bound(F.col("relation"), F.col("value")), G.bound(F.col("f_relation"), F.col("f_value"))
    vote = F.when(F.coalesce(alike, F.lit(False)) & (F.col("unit") == F.col("f_unit")) & scalar("relation") & scalar("f_relation"), G.compare_bounds(asked, seen))
    per = j.select(claim_id, "req", vote.alias("vote")).groupBy(claim_id, "req").agg(F.bool_and("vote").alias("every"), F.bool_or("vote").alias("any"))
    label = F.when(F.col("every") & F.col("any"), "support").when(~F.col("any"), "contradict").otherwise("not_enough_info")
    return per.select(claim_id, "req", F.coalesce(label, F.lit("not_enough_info")).alias("label"))
