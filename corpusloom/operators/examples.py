"""Verification examples from annotated claims, reviews of claims against references, and reports of prepared rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels of annotations.
LABELS = {"SUPPORT": "support", "CONTRADICT": "contradict"}


def numbered_context(title: Column, sentences: Column) -> Column:
    """A title and its sentences with their numbers from 0, a line each."""
    lines = F.transform(sentences, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.trim(s)))
    return F.concat(F.lit("Title: "), F.trim(title), F.lit("\nAbstract:\n"), F.array_join(lines, "\n"))


def build_examples(corpus: DataFrame, claims: DataFrame) -> DataFrame:
    """(example_id, claim_id, doc_id, claim, context, label, indices, sentences) of annotated claims.

    corpus: (doc_id, title, abstract: array); claims, a row for each annotation: (claim_id, claim, cited: array of ids, doc_id,
    label, indices, line: the row's order). Annotations with an unknown label, document or sentence are left out. Cited
    documents of the corpus that a claim has no annotation for are not_enough_info.
    """
    has = (F.coalesce(F.col("label"), F.lit("")) != "") & (F.coalesce(F.col("doc_id"), F.lit("")) != "")
    text = claims.groupBy("claim_id").agg(F.min_by("claim", "line").alias("claim"))
    noted = claims.where(has).select("claim_id", "doc_id", F.upper(F.trim("label")).alias("mark"), "indices", "line")
    label = F.try_element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), F.col("mark"))
    within = F.coalesce((F.array_min("indices") >= 0) & (F.array_max("indices") < F.size("abstract")), F.lit(True))
    good = noted.withColumn("label", label).where("label is not null").join(corpus, "doc_id").where(within)
    nth = F.row_number().over(Window.partitionBy("claim_id", "doc_id", "mark").orderBy("line")) - 1
    sentences = F.transform("indices", lambda i: F.get("abstract", i))
    a = good.select("claim_id", "doc_id", nth.cast("string").alias("nth"), "label", "indices", sentences.alias("sentences"), "title", "abstract")
    cited = claims.select("claim_id", F.explode("cited").alias("doc_id")).distinct().join(noted.select("claim_id", "doc_id").distinct(), ["claim_id", "doc_id"], "left_anti").join(corpus, "doc_id")
    none = lambda t: F.array().cast(f"array<{t}>")
    b = cited.select("claim_id", "doc_id", F.lit("nei").alias("nth"), F.lit("not_enough_info").alias("label"), none("int").alias("indices"), none("string").alias("sentences"), "title", "abstract")
    out = a.unionByName(b).join(text, "claim_id")
    ident = F.concat_ws(":", F.col("claim_id").cast("string"), "doc_id", "nth")
    return out.select(ident.alias("example_id"), "claim_id", "doc_id", "claim", numbered_context(F.col("title"), F.col("abstract")).alias("context"), "label", "indices", "sentences")


def review_matrix(claims: DataFrame, refs: DataFrame, most: int, session: str = "session", claim: str = "claim_id", ref: str = "ref_id") -> DataFrame:
    """(session, claim, ref, at): every claim of a session with each of its references, and at, their number; a session of more than ``most`` pairs is over its budget and gives a row with null claim and ref alone."""
    n = claims.groupBy(session).agg(F.count("*").alias("c")).join(refs.groupBy(session).agg(F.count("*").alias("r")), session).select(session, (F.col("c") * F.col("r")).alias("pairs"))
    fits = n.where(F.col("pairs") <= most).select(session)
    pairs = claims.select(session, claim).join(fits, session).join(refs.select(session, ref), session)
    at = F.row_number().over(Window.partitionBy(session).orderBy(claim, ref))
    over = n.where(F.col("pairs") > most).select(session, F.lit(None).cast(claims.schema[claim].dataType).alias(claim), F.lit(None).cast(refs.schema[ref].dataType).alias(ref), F.lit(None).cast("int").alias("at"))
    return pairs.withColumn("at", at).unionByName(over)


def accept_claims(reviews: DataFrame, threshold: float, by: list[str], ref: str = "ref_id") -> DataFrame:
    """(by, accepted, ref, reason): the supporting reference of the highest score, ties to the smaller, from ``threshold`` to 1, unless any review failed or contradicts."""
    fit = (F.col("label") == "support") & F.col("score").between(threshold, 1.0)
    g = reviews.groupBy(*by).agg(
        F.bool_or(F.col("status") != "ok").alias("failed"), F.bool_or(F.col("label") == "contradict").alias("against"),
        F.array_sort(F.collect_list(F.when(fit, F.struct((-F.col("score")).alias("s"), F.col(ref).alias("r"))))).alias("l"),
    )
    best = F.get("l", F.lit(0))["r"]
    reason = F.when(F.col("failed"), "review_failed").when(F.col("against"), "conflict").when(best.isNull(), "no_support")
    return g.withColumn("reason", reason).select(*by, F.col("reason").isNull().alias("accepted"), F.when(F.col("reason").isNull(), best).alias(ref), "reason")


def prepared_report(rows: DataFrame, most: int, task: str = "task", tokens: str = "tokens", supervised: str = "supervised") -> DataFrame:
    """(task, kept, dropped, tokens, supervised, longest): rows of at most ``most`` tokens by task, and their tokens."""
    fits = F.col(tokens) <= most
    only = lambda c: F.when(fits, F.col(c))
    return rows.groupBy(task).agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"), F.coalesce(F.sum(only(tokens)), F.lit(0)).alias("tokens"), F.coalesce(F.sum(only(supervised)), F.lit(0)).alias("supervised"), F.max(only(tokens)).alias("longest"))


def unanimous(observations: DataFrame, by: list[str], member: str, truth: str) -> DataFrame:
    """(by, all_true, some_true, none_true): over members whose observations agree; members that conflict are left out, null where none is left."""
    per = observations.where(F.col(truth).isNotNull()).groupBy(*by, member).agg(F.bool_and(truth).alias("t"), F.bool_or(truth).alias("o")).where("t = o")
    return observations.select(*by).distinct().join(per.groupBy(*by).agg(F.bool_and("t").alias("all_true"), F.bool_or("t").alias("some_true"), (~F.bool_or("t")).alias("none_true")), by, "left")


def paper_ids(texts: DataFrame, pattern: str, name: str = "name", text: str = "text") -> DataFrame:
    """(paper_id, names): distinct ids in texts that ``pattern`` finds, without a version, and where each is."""
    found = texts.select(name, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("id"))
    return found.select(name, F.regexp_replace("id", r"v\d+$", "").alias("paper_id")).groupBy("paper_id").agg(F.array_sort(F.collect_set(name)).alias("names"))
