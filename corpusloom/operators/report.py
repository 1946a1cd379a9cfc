"""Reports of cited sentences: integrity, exact-copy review, repairs, and the choice of the best attempt.

Sentences: (report, pos, sentence_id, text, claim_ids array). Claims: (claim_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import squeeze


def citation_errors(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """(report, sentence_id, error): unknown or repeated citations, none at all, and blank sentences."""
    own = sentences.select(
        "report", "sentence_id",
        F.explode(F.array_compact(F.array(
            F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "blank"), F.when(F.coalesce(F.size("claim_ids"), F.lit(0)) <= 0, "uncited"),
            F.when(F.size(F.array_distinct("claim_ids")) < F.size("claim_ids"), "repeated"),
        ))).alias("error"),
    )
    cited = sentences.select("report", "sentence_id", F.explode("claim_ids").alias("claim_id"))
    unknown = cited.join(claims.select("claim_id"), "claim_id", "left_anti").select("report", "sentence_id", F.lit("unknown").alias("error")).distinct()
    return own.union(unknown)


def critique_errors(sentences: DataFrame, critiques: DataFrame) -> DataFrame:
    """(report, sentence_id, reviews): sentences that a critique doesn't cover exactly once, and reviews of no sentence."""
    s = sentences.select("report", "sentence_id", F.lit(1).alias("there"))
    c = critiques.groupBy("report", "sentence_id").agg(F.count("*").alias("reviews"))
    j = s.join(c, ["report", "sentence_id"], "full_outer").withColumn("reviews", F.coalesce("reviews", F.lit(0)))
    return j.where(F.col("there").isNull() | (F.col("reviews") != 1)).select("report", "sentence_id", "reviews")


def exact_copies(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """(report, sentence_id, exact): whether a sentence is its cited claims, in order of citation, blanks aside."""
    cited = sentences.select("report", "sentence_id", F.posexplode("claim_ids").alias("k", "claim_id")).join(claims.select("claim_id", F.col("text").alias("claim")), "claim_id", "left")
    joined = cited.groupBy("report", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("k", "claim"))).alias("c"), F.count_if(F.col("claim").isNull()).alias("lost"))
    made = joined.select("report", "sentence_id", "lost", squeeze(F.array_join(F.transform("c", lambda x: x["claim"]), " ")).alias("made"))
    exact = (F.col("lost") == 0) & (squeeze(F.col("text")) == F.col("made"))
    return sentences.join(made, ["report", "sentence_id"], "left").select("report", "sentence_id", F.coalesce(exact, F.lit(False)).alias("exact"))


def repair_action(reviews: DataFrame) -> DataFrame:
    """(report, sentence_id, action): each report's first violation; definite ones (grounded = false) go before unknown ones."""
    bad = reviews.where(~F.coalesce("grounded", F.lit(False)) | ~F.coalesce("relevant", F.lit(True)))
    order = F.struct(F.when(F.col("grounded").isNull(), 1).otherwise(0), F.col("pos"))
    first = bad.groupBy("report").agg(F.min_by(F.struct("sentence_id", "grounded", "relevant", "claim_ids"), order).alias("s"))
    action = F.when(~F.coalesce("s.relevant", F.lit(True)), "delete_sentence").when(F.size("s.claim_ids") > 0, "rewrite_sentence").otherwise("reselect_claims")
    return first.select("report", F.col("s.sentence_id").alias("sentence_id"), action.alias("action"))


def apply_repairs(sentences: DataFrame, repairs: DataFrame, claims: DataFrame) -> DataFrame:
    """``sentences`` after repairs (report, sentence_id, action, text, claim_ids): deleted, rewritten, or copied from new claims."""
    r = repairs.select("report", "sentence_id", "action", F.col("text").alias("new_text"), F.col("claim_ids").alias("new_ids"))
    copied = r.where("action = 'reselect_claims'").select("report", "sentence_id", F.posexplode("new_ids").alias("k", "claim_id")).join(claims.select("claim_id", F.col("text").alias("claim")), "claim_id")
    copied = copied.groupBy("report", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("k", "claim"))).alias("c")).select("report", "sentence_id", F.array_join(F.transform("c", lambda x: x["claim"]), " ").alias("copy"))
    j = sentences.join(r, ["report", "sentence_id"], "left").join(copied, ["report", "sentence_id"], "left").where("action is null or action <> 'delete_sentence'")
    text = F.when(F.col("action") == "rewrite_sentence", F.col("new_text")).when(F.col("action") == "reselect_claims", F.col("copy")).otherwise(F.col("text"))
    ids = F.when(F.col("action") == "reselect_claims", F.col("new_ids")).otherwise(F.col("claim_ids"))
    return j.select("report", "pos", "sentence_id", text.alias("text"), ids.alias("claim_ids"))


def best_attempt(attempts: DataFrame, scores: list[str]) -> DataFrame:
    """Each report's attempt of the largest scores, compared in turn; the first of equals."""
    order = F.struct(*[F.col(c) for c in scores], -F.col("attempt"))
    return attempts.groupBy("report").agg(F.max_by("attempt", order).alias("attempt"))


def retrieval_choice(trials: DataFrame) -> DataFrame:
    """(session, method, k): the next search after each session's last trial (ord, method, k, relevant, found).

    A failed method gives way to the other one; after both, the first returns with a wider k, at most 50.
    """
    last = trials.groupBy("session").agg(
        F.max_by(F.struct("method", "k", "relevant"), "ord").alias("l"), F.collect_set(F.when(~F.col("relevant"), F.col("method"))).alias("failed"), F.count("*").alias("n"), F.sum("found").alias("seen")
    )
    other = F.when(F.col("l.method") == "bm25", "dense").otherwise("bm25")
    both = F.size("failed") > 1
    method = F.when(F.col("l.relevant"), F.col("l.method")).when(both, F.col("l.method")).otherwise(other)
    return last.select("session", method.alias("method"), widened(F.col("l.k"), F.when(both, F.col("n")).otherwise(0)).cast("int").alias("k"))


def widened(k: Column, trials: Column) -> Column:
    return F.least(F.lit(50), k * (trials + 1))
