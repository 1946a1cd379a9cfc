"""Annotated papers: paragraphs, questions, answers, verbatim claims, training rows and relevance judgements.

A paper: (paper_id, title, full_text: array of (section_name, paragraphs), qas: array of (question, question_id, answers)).
Answers come in three layouts, which the schema tells apart: an array of answers, an array of wrappers with an ``answer``,
and one wrapper whose ``answer`` is a struct of arrays. An answer: unanswerable, yes_no, evidence, highlighted_evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType
from pyspark.sql.window import Window

from corpusloom.functions.python_text import nfkc

#: The mark of evidence in figures and tables, and bounds of a claim pool.
VISUAL = "FLOAT SELECTED"
MAX_CLAIMS, MAX_CLAIM_CHARS = 4, 900
TASKS = ("report", "critic_positive", "critic_negative", "action_reselect")


def records(value: Column, kind: DataType) -> Column:
    """An array of structs, of one or of a struct of arrays; arrays of unequal lengths are an error."""
    if isinstance(kind, ArrayType):
        return value
    assert isinstance(kind, StructType)
    arrays = [f.name for f in kind.fields if isinstance(f.dataType, ArrayType)]
    if not arrays:
        return F.when(value.isNotNull(), F.array(value))
    sizes = [F.size(value[a]) for a in arrays]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.arrays_zip(*[value[a].alias(a) for a in arrays])
    return F.when(value.isNull(), F.lit(None)).when(same, zipped).otherwise(F.raise_error(F.lit("columns differ in length")))


def answers(value: Column, kind: DataType) -> Column:
    """The answers of a question, whichever layout ``kind`` has."""
    inner = kind.elementType if isinstance(kind, ArrayType) else kind
    assert isinstance(inner, StructType)
    if "answer" not in inner.fieldNames():
        return records(value, kind)
    wrapped = inner["answer"].dataType
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda w: w["answer"])
    return records(value["answer"], wrapped)


def questions(papers: DataFrame) -> DataFrame:
    """(paper_id, q_no from 0, question_id, question, answers); an id that is missing is the number."""
    qas = records(F.col("qas"), papers.schema["qas"].dataType)
    q = papers.select("paper_id", F.posexplode(qas).alias("q_no", "q"))
    kind = q.schema["q"].dataType["answers"].dataType
    return q.select("paper_id", "q_no", F.coalesce(F.nullif(F.col("q.question_id"), F.lit("")), F.col("q_no").cast("string")).alias("question_id"), F.col("q.question").alias("question"), answers(F.col("q.answers"), kind).alias("answers"))


def answer_metadata(asked: DataFrame) -> DataFrame:
    """``asked`` with contradictory (answers differ in answerability or in yes or no) and all_unanswerable; false isn't missing."""
    no = F.transform("answers", lambda a: F.coalesce(a["unanswerable"], F.lit(False)))
    said = F.array_distinct(F.filter(F.transform("answers", lambda a: a["yes_no"]), lambda y: y.isNotNull()))
    some = F.coalesce(F.size("answers") > 0, F.lit(False))
    return asked.withColumn("contradictory", some & ((F.size(F.array_distinct(no)) > 1) | (F.size(said) > 1))).withColumn("all_unanswerable", some & F.forall(no, lambda x: x))


def paragraphs(papers: DataFrame) -> DataFrame:
    """(paper_id, p_no from 0 over all sections, text); nulls have no number, blank paragraphs have one."""
    sections = records(F.col("full_text"), papers.schema["full_text"].dataType)
    texts = F.filter(F.flatten(F.transform(sections, lambda s: F.coalesce(s["paragraphs"], F.array().cast("array<string>")))), lambda t: t.isNotNull())
    return papers.select("paper_id", F.posexplode(texts).alias("p_no", "text"))


def _visual(text: Column) -> Column:
    return F.ltrim(text).startswith(VISUAL)


def extract_claims(papers: DataFrame, max_claims: int = MAX_CLAIMS, max_chars: int = MAX_CLAIM_CHARS) -> DataFrame:
    """(paper_id, q_no, question_id, question, claims, dropped_visual, dropped_unmatched, dropped_long, cap_reached).

    claims: (claim_id, text, evidence, source_id) of evidence that equals a paragraph, or of its highlights where there are
    any, without repeats, ``max_claims`` at most, in order; what comes after the last of them isn't counted. A question
    whose answers contradict each other or are all missing has none.
    """
    asked = answer_metadata(questions(papers))
    open_ = asked.where("not contradictory and not all_unanswerable").select("paper_id", "q_no", F.posexplode("answers").alias("a_no", "a")).where(~F.coalesce(F.col("a.unanswerable"), F.lit(False)))
    ev = open_.select("paper_id", "q_no", "a_no", F.coalesce("a.highlighted_evidence", F.array().cast("array<string>")).alias("lit"), F.posexplode("a.evidence").alias("e_no", "evidence")).where("evidence is not null")
    # Equal paragraphs and evidence meet by a hash, so that texts aren't compared before they are known to be near equal.
    first = paragraphs(papers).groupBy("paper_id", F.sha2("text", 256).alias("h")).agg(F.min("p_no").alias("p_no"))
    ev = ev.withColumn("h", F.sha2("evidence", 256)).join(first, ["paper_id", "h"], "left")
    chosen = F.filter("lit", lambda x: F.contains(F.col("evidence"), x) & ~_visual(x))
    usable = F.when(_visual(F.col("evidence")) | F.col("p_no").isNull(), F.array(F.lit(None).cast("string"))).when(F.size(chosen) > 0, chosen).otherwise(F.array("evidence"))
    rows = ev.select("paper_id", "q_no", "a_no", "e_no", "evidence", "p_no", F.posexplode(usable).alias("t_no", "text"))
    event = F.when(_visual(F.col("evidence")), "visual").when(F.col("p_no").isNull(), "unmatched").when(F.length("text") > max_chars, "long").otherwise("text")
    rows = rows.withColumn("event", event)
    q = ["paper_id", "q_no"]
    order = ["a_no", "e_no", "t_no"]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*q, "event", "text").orderBy(*order)))
    new = (F.col("event") == "text") & (F.col("nth") == 1)
    earlier = F.coalesce(F.sum(new.cast("int")).over(Window.partitionBy(*q).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("new", new).withColumn("earlier", earlier).where(F.col("earlier") < max_claims)
    ident = F.concat(F.lit("qasper_"), F.substring(F.sha2(F.concat("paper_id", F.lit("\0"), "text"), 256), 1, 16))
    source = F.concat(F.lit("qasper:"), "paper_id", F.lit(":paragraph:"), F.col("p_no").cast("string"))
    claim = F.struct(F.col("earlier").alias("n"), ident.alias("claim_id"), "text", "evidence", source.alias("source_id"))
    per = rows.groupBy(*q).agg(
        F.array_sort(F.collect_list(F.when(F.col("new"), claim))).alias("c"),
        *[F.count_if(F.col("event") == e).alias(f"dropped_{e}") for e in ("visual", "unmatched", "long")],
    )
    claims = F.transform("c", lambda x: F.struct(x["claim_id"].alias("claim_id"), x["text"].alias("text"), x["evidence"].alias("evidence"), x["source_id"].alias("source_id")))
    out = asked.join(per.select(*q, claims.alias("claims"), "dropped_visual", "dropped_unmatched", "dropped_long"), q, "left")
    none = F.array().cast("array<struct<claim_id:string,text:string,evidence:string,source_id:string>>")
    return out.select(*q, "question_id", "question", F.coalesce("claims", none).alias("claims"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dropped_visual", "dropped_unmatched", "dropped_long")], (F.size(F.coalesce("claims", none)) == max_claims).alias("cap_reached"))


def training_rows(pools: DataFrame, split: Column) -> DataFrame:
    """(example_id, task, paper_id, split, question_id, label_origin, sentence_texts, cited, verdict): each question's rows.

    A report of the first two claims and its review; with a claim, a report with an invented sentence and its review; with
    two, the choice of the second claim in its place.
    """
    key = F.substring(F.sha2(F.concat("paper_id", F.lit("\0"), "question_id"), 256), 1, 20)
    n = F.size("claims")
    two = F.slice("claims", 1, 2)
    marker = F.concat(F.lit("The paper reports WRITER_SYNTHETIC_UNSUPPORTED_"), F.upper(key), F.lit(" as an established finding."))
    texts, ids = F.transform(two, lambda c: c["text"]), F.transform(two, lambda c: c["claim_id"])
    fake, one = F.array(marker), F.transform(F.slice("claims", 1, 1), lambda c: c["claim_id"])
    row = lambda task, kind, origin, t, i, verdict: F.struct(F.lit(task).alias("suffix"), F.lit(kind).alias("task"), F.lit(origin).alias("label_origin"), t.alias("sentence_texts"), i.alias("cited"), F.lit(verdict).alias("verdict"))
    second = F.transform(F.slice("claims", 2, 1), lambda c: c["text"]), F.transform(F.slice("claims", 2, 1), lambda c: c["claim_id"])
    rows = F.array(
        row(TASKS[0], "report", "derived_evidence_quote", texts, ids, "supported"), row(TASKS[1], "critic", "derived_evidence_quote", texts, ids, "supported"),
        F.when(n > 0, row(TASKS[2], "critic", "synthetic_unsupported", fake, one, "unsupported")), F.when(n > 1, row(TASKS[3], "action", "synthetic_reselection", *second, "unsupported")),
    )
    out = pools.select("paper_id", "question_id", split.alias("split"), key.alias("k"), F.explode(F.array_compact(rows)).alias("x"))
    return out.select(F.concat("k", F.lit(":"), "x.suffix").alias("example_id"), "x.task", "paper_id", "split", "question_id", "x.label_origin", "x.sentence_texts", "x.cited", "x.verdict")


def split_papers(papers: DataFrame, most: int | None = None) -> DataFrame:
    """``papers`` (with split), the first ``most`` of each split by id; a paper in two splits is an error, in whichever rows stay."""
    seen = papers.groupBy("paper_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    if not seen.isEmpty():
        raise ValueError("a paper is in more than one split")
    if most is None:
        return papers
    return papers.withColumn("__r", F.row_number().over(Window.partitionBy("split").orderBy("paper_id"))).where(F.col("__r") <= most).drop("__r")


def relevance(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus, judged): (doc_id, paper_id, p_no, text) of paragraphs that aren't blank, and each question with its relevant ones or a reason.

    judged: (paper_id, question_id, query, relevant, reason); texts are compared in NFKC with blanks squeezed. A question needs
    answers that agree, are all there, and whose evidence is all found.
    """
    ident = F.concat(F.lit("qasper:"), "paper_id", F.lit(":paragraph:"), F.col("p_no").cast("string"))
    corpus = paragraphs(papers).where(F.trim("text") != "").select(ident.alias("doc_id"), "paper_id", "p_no", "text", nfkc(F.col("text")).alias("norm")).where("norm <> ''")
    asked = questions(papers)
    some = F.coalesce(F.size("answers") > 0, F.lit(False))
    open_ = some & ~F.exists("answers", lambda a: F.coalesce(a["unanswerable"], F.lit(False)))
    said = F.array_distinct(F.filter(F.transform("answers", lambda a: a["yes_no"]), lambda y: y.isNotNull()))
    asked = asked.withColumn("reason", F.when(~open_, "unanswerable_or_disagreement").when(F.size(said) > 1, "answer_disagreement"))
    wanted = asked.where("reason is null").select("paper_id", "q_no", F.explode(F.flatten(F.transform("answers", lambda a: F.coalesce(a["evidence"], F.array().cast("array<string>"))))).alias("e"))
    wanted = wanted.select("paper_id", "q_no", nfkc(F.col("e")).alias("norm")).where("norm <> ''").distinct()
    found = wanted.join(corpus.select("paper_id", "norm", "doc_id"), ["paper_id", "norm"], "left")
    per = found.groupBy("paper_id", "q_no").agg(F.array_sort(F.collect_set("doc_id")).alias("relevant"), F.bool_and(F.col("doc_id").isNotNull()).alias("all"))
    j = asked.join(per, ["paper_id", "q_no"], "left").join(papers.select("paper_id", "title"), "paper_id")
    reason = F.coalesce("reason", F.when(~F.coalesce("all", F.lit(False)), "missing_visual_or_unmatched_evidence"))
    query = F.concat(F.lit("In the paper '"), "title", F.lit("', "), "question")
    judged = j.withColumn("reason", reason).select("paper_id", "question_id", query.alias("query"), F.when(F.col("reason").isNull(), F.col("relevant")).alias("relevant"), "reason")
    return corpus.drop("norm"), judged
