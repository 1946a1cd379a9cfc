"""Closed populations: what a text states about who belongs to one, and ALL, SOME and NONE over its members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.clauses import contains_words, literal, scope_conflict
from corpusloom.functions.grammar import CARDINALS

#: Sentences, rosters, and the bounds of what one population may be.
SENTENCE = r"[^.!?]+(?:[.!?](?=\s|$)|$)"
ROSTER = r"(?:\b(?:were|was)\s+|:\s*)([A-Z][\w-]*(?:,\s*[A-Z][\w-]*)*(?:,?\s+and\s+[A-Z][\w-]*))\s*[.!]?$"
COUNT = rf"(?:\d+|{'|'.join(CARDINALS)})"
MOST_MEMBERS, WINDOW, ANCHOR_CHARS, TEXT_CHARS = 16, 3, 160, 384


def noun_pattern(entity: Column) -> Column:
    """A pattern for the last word of an entity, in singular and plural."""
    word = F.lower(F.element_at(F.split(F.trim(entity), r"\s+"), -1))
    head = F.when(word.rlike("(?:ch|sh|x|z|s)es$"), F.regexp_replace(word, "es$", "")).when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).otherwise(F.regexp_replace(word, "s$", ""))
    plural = F.when(head.endswith("y"), F.regexp_replace(head, "y$", "ies")).when(head.rlike("(?:ch|sh|x|z|s)$"), F.concat(head, F.lit("es"))).otherwise(F.concat(head, F.lit("s")))
    return F.when(head.rlike("^[a-z-]+$"), F.concat(F.lit("(?:"), literal(head), F.lit("|"), literal(plural), F.lit(")")))


def _extract(text: Column, pattern: Column, group: int) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def stated_populations(parts: DataFrame, contexts: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, n_members, names, anchor, text) of cases whose context states one population of the part's entity; others have none.

    parts: (case, entity, time, condition); contexts: (case, text). A sentence that names the entity states its population by
    "exactly" and a count, or by a roster of capitalised names, of MOST_MEMBERS at most; both must agree where both are there.
    It holds with the two sentences after it, up to one of another scope (months, opposed conditions); the entity's earlier
    words and a restriction must stand in them. Two statements, even equal ones, leave the case open.
    """
    s = contexts.select(case, F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("at", "sentence")).select(case, "at", F.trim("sentence").alias("sentence")).where("sentence <> ''")
    j = s.join(parts.select(case, "entity", "time", "condition"), case)
    off = scope_conflict(F.col("time"), F.col("condition"), F.col("sentence"))
    w = Window.partitionBy(case).orderBy("at")
    j = j.withColumn("off", off)
    for k in range(1, WINDOW):
        j = j.withColumn(f"s{k}", F.lead("sentence", k).over(w)).withColumn(f"off{k}", F.coalesce(F.lead("off", k).over(w), F.lit(True)))
    noun = noun_pattern(F.col("entity"))
    count = F.concat(F.lit(rf"(?i)\bexactly\s+(({COUNT})\s+(?:[a-z-]+\s+){{0,3}}"), noun, F.lit(r"\b)"))
    j = j.withColumn("counted", F.when(noun.isNotNull(), _extract(F.col("sentence"), count, 1))).withColumn("number", F.when(noun.isNotNull(), F.lower(_extract(F.col("sentence"), count, 2))))
    j = j.withColumn("roster", F.regexp_extract("sentence", ROSTER, 1)).withColumn("named", F.coalesce(F.regexp_count("sentence", F.concat(F.lit(r"(?i)\b"), noun, F.lit(r"\b"))) > 0, F.lit(False)))
    names = F.filter(F.transform(F.split("roster", r",\s*(?:and\s+)?|\s+and\s+"), F.trim), lambda n: n != "")
    numbers = F.create_map(*[F.lit(x) for i, c in enumerate(CARDINALS) for x in (c, i)])
    j = j.withColumn("names", F.when(F.col("roster") != "", names).otherwise(F.slice(names, 1, 0)))
    n = F.when(F.col("number") != "", F.coalesce(F.col("number").try_cast("int"), F.try_element_at(numbers, F.col("number")))).otherwise(F.size("names"))
    earlier = F.split(F.trim("entity"), r"\s+")
    words = F.forall(F.slice(earlier, 1, F.size(earlier) - 1), lambda x: contains_words(x, F.col("sentence")))
    j = j.withColumn("n_members", n).where(~F.col("off") & F.col("named") & words & ((F.col("number") != "") | (F.size("names") > 0)))
    j = j.where((F.col("n_members") > 0) & (F.col("n_members") <= MOST_MEMBERS) & ((F.size("names") == 0) | (F.size("names") == F.col("n_members"))))
    text, open_ = F.col("sentence"), F.lit(True)
    for k in range(1, WINDOW):
        open_ = open_ & ~F.col(f"off{k}")
        text = F.when(open_, F.concat_ws(" ", text, F.col(f"s{k}"))).otherwise(text)
    anchor = F.when(F.col("number") != "", F.col("counted")).otherwise(F.col("roster"))
    j = j.withColumn("window", text).withColumn("anchor", anchor)
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?i)^(?:on|in|during|under)\s+", "")
    held = lambda c: (bare(c) == "") | bare(c).rlike("[0-9]") | contains_words(bare(c), F.col("window"))
    fine = j.where(held("time") & held("condition") & (F.length("anchor") <= ANCHOR_CHARS) & (F.length("window") <= TEXT_CHARS))
    one = fine.groupBy(case).agg(F.count("*").alias("n"), F.first(F.struct("n_members", "names", "anchor", F.col("window").alias("text"))).alias("p")).where("n = 1")
    return one.select(case, "p.n_members", "p.names", "p.anchor", "p.text")


def closed_truth(cases: DataFrame, populations: DataFrame, observations: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, quantifier, n_members, n_observed, closed, truth, issue) of cases (case, quantifier: all, some or none).

    populations: (case, n_members, names) as stated; observations: (case, member, truth), a member whose observations disagree is
    not observed. A population is closed if its roster's names are the observed members, exactly, or, where only a count is
    stated, if as many are observed. One member decides against all, for some and against none; the other way round takes a
    closed population. Issues: no_population, outside_member (observed, but not in the roster), population_closure_required.
    """
    seen = observations.where("member is not null").groupBy(case, "member").agg(F.when(F.min("truth") == F.max("truth"), F.min("truth")).alias("t")).where("t is not null")
    roster = populations.select(case, F.explode("names").alias("member"), F.lit(True).alias("listed"))
    listed = seen.join(roster, [case, "member"], "full_outer").groupBy(case).agg(
        F.count("t").alias("n_observed"), F.count_if("t").alias("yes"), F.count_if(~F.col("t")).alias("no"), F.count_if(F.col("listed") & F.col("t").isNull()).alias("unseen"), F.count_if(F.col("t").isNotNull() & F.col("listed").isNull()).alias("outside")
    )
    j = cases.select(case, "quantifier").join(populations.select(case, "n_members", (F.size("names") > 0).alias("by_roster")), case, "left").join(listed, case, "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_observed", "yes", "no", "unseen", "outside")})
    by_roster = F.coalesce("by_roster", F.lit(False))
    closed = F.when(by_roster, (F.col("unseen") == 0) & (F.col("outside") == 0)).otherwise(F.coalesce(F.col("n_observed") == F.col("n_members"), F.lit(False)))
    outside = by_roster & (F.col("outside") > 0)
    q = F.col("quantifier")
    truth = F.when(q == "all", F.when(F.col("no") > 0, False).when(closed, True)).when(q == "some", F.when(F.col("yes") > 0, True).when(closed, False)).when(q == "none", F.when(F.col("yes") > 0, False).when(closed, True))
    stated = F.col("n_members").isNotNull()
    truth = F.when(stated & ~outside, truth)
    issue = F.when(~stated, "no_population").when(outside, "outside_member").when(truth.isNull(), "population_closure_required")
    return j.select(case, "quantifier", "n_members", "n_observed", (closed & stated).alias("closed"), truth.alias("truth"), issue.alias("issue"))
