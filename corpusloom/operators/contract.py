"""The contract of answers: whether each claim is a whole statement, and whether its sources are there and hold its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.grammar import ITEM_MARK, LIST_ITEM, evidence_numbers
from corpusloom.functions.text import let, once
from corpusloom.session import materialize, shuffled

#: Where claims end, words that name nothing, predicates that are whole by themselves, and predicates.
CLAIM_END = r"(?iU)(?<!\be\.g\.)(?<!\bi\.e\.)(?<!\bvs\.)(?<!\bal\.)(?<!\bDr\.)(?<!\bFig\.)(?<!\bEq\.)(?<=[.!?;])\s+(?=[^\W_])"
FUNCTION = (
    "a an the and or but not no all some none every each any both one another others it its they them their this that these those we our i you he she which what who there here after"
    " before during in on at to of for with by from as than also only already approximately roughly about nó họ chúng tôi này đó đã đang sẽ bị được chỉ cũng không một các những của"
    " vào về trên dưới bằng với từ khi bao tất cả mọi"
).split()
INTRANSITIVE = "failed fails fail converged converges converge disagree disagrees disagreed work works worked exist exists existed run runs ran stopped stop stops".split()
IRREGULAR = (
    "am is are was were be been being has have had do does did can could may might must shall should will would found finds find took takes take gave gives give became becomes become"
    " built builds build ran runs run shown shows show known knows know led leads lead cost costs put choose chooses chose là có đạt gồm chứa giảm tăng dùng được tuyển thu"
).split()
REGULAR = (
    "achieve improve reduce increase decrease use compare provide require describe observe exclude include measure remove retain align contain report evaluate enroll train test predict"
    " label assign collect sample select cover last return learn distinguish gain yield fail pass work outperform lag precede follow employ detect demonstrate support refute identify"
    " obtain match perform represent record establish count differ disagree converge stop list account"
).split()
#: Predicates of more than one word.
COMPOUND = (("sử", "dụng"),)
WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"


def _forms(verb: str) -> tuple[str, str, str]:
    """A regular verb, its third person and its past."""
    return verb, verb + ("es" if verb.endswith(("s", "sh", "ch", "o")) else "s"), verb + ("d" if verb.endswith("e") else "ed")


PREDICATES = sorted({*IRREGULAR, *(f for v in REGULAR for f in _forms(v))})


def whole_claims(answer: Column) -> Column:
    """The claims of an answer: items of a list, cut after . ! ? and ; before a letter or digit, but for common abbreviations."""
    sections = F.split(F.trim(answer), LIST_ITEM)
    parts = F.flatten(F.transform(sections, lambda s: F.split(F.regexp_replace(s, ITEM_MARK, ""), CLAIM_END)))
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def claim_issue(claim: Column) -> Column:
    """Why a claim is no whole statement, or null: empty_claim, question_not_claim, bare_quantity (no word),
    metric_or_relation_missing (no predicate), entity_missing (nothing before one, since the last comma), predicate_incomplete
    (nothing after one that needs it). Text in NFKC is expected.
    """
    text = F.trim(F.coalesce(claim, F.lit("")))
    marks_of = lambda t: F.transform(F.regexp_extract_all(t, F.lit(rf"(?U){WORD}|,|\d"), F.lit(0)), F.lower)
    kinds = lambda ms: F.transform(ms, lambda m: F.struct(m.alias("m"), (m == ",").alias("comma"), m.rlike(r"^\d$").alias("digit"), (m.rlike(r"^\p{L}") & ~m.isin(*FUNCTION)).alias("names")))
    return let(text, lambda t: let(marks_of(t), lambda ms: let(kinds(ms), lambda ks: _judgement(t, ms, ks))))


def _judgement(text: Column, marks: Column, kinds: Column) -> Column:
    """``claim_issue`` of a text, its marks, and what each of them is."""
    at = F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1)))

    def predicate(i: Column) -> Column:
        """(place, words) of a predicate that begins at a mark; no words where none does."""
        size = F.when(F.try_element_at(marks, i).isin(*PREDICATES), 1).otherwise(0)
        for first, second in COMPOUND:
            size = F.when((F.try_element_at(marks, i) == first) & (F.try_element_at(marks, i + 1) == second), 2).otherwise(size)
        return F.struct(i.alias("at"), size.alias("size"))


    def judged(p: Column) -> Column:
        before = F.slice(kinds, 1, p["at"] - 1)
        commas = F.filter(F.transform(before, lambda k, i: F.when(k["comma"], i + 1).otherwise(0)), lambda i: i > 0)
        own = F.slice(before, F.coalesce(F.array_max(commas), F.lit(0)) + 1, F.greatest(F.size(before), F.lit(1)))
        after = F.slice(kinds, p["at"] + p["size"], F.greatest(F.size(kinds), F.lit(1)))
        whole = F.exists(after, lambda k: k["names"] | k["digit"]) | F.element_at(marks, p["at"]).isin(*INTRANSITIVE)
        return F.struct(F.exists(own, lambda k: k["names"]).alias("subject"), whole.alias("whole"))

    words = F.exists(kinds, lambda k: ~k["comma"] & ~k["digit"])
    verdicts = F.transform(F.filter(F.transform(at, predicate), lambda p: p["size"] > 0), judged)
    decided = lambda vs: (
        F.when(F.size(vs) == 0, "metric_or_relation_missing")
        .when(F.exists(vs, lambda v: v["subject"] & v["whole"]), F.lit(None).cast("string"))
        .when(F.exists(vs, lambda v: v["subject"]), "predicate_incomplete")
        .otherwise("entity_missing")
    )
    return F.when(text == "", "empty_claim").when(text.endswith("?"), "question_not_claim").when(~words, "bare_quantity").otherwise(let(verdicts, decided))


def answer_issues(answers: DataFrame, answer_id: str = "answer_id", text: str = "text") -> DataFrame:
    """(answer_id, claim_index, code): the issues of each answer's claims; an answer without text has empty_answer at 0."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    each = answers.where(~blank).select(answer_id, F.posexplode_outer(whole_claims(F.col(text))).alias("claim_index", "claim")).where("claim is not null")
    issues = each.select(answer_id, "claim_index", once(claim_issue(F.col("claim"))).alias("code")).where("code is not null")
    return issues.union(answers.where(blank).select(answer_id, F.lit(0), F.lit("empty_answer")))


def resolve_sources(claims: DataFrame, units: DataFrame, case: str = "case_id", most: int = 4) -> DataFrame:
    """(case, at, text, source_ids, issue, missing, candidates): whether each claim of a case is bound to sources that hold its values.

    claims: (case, at, text, source_ids: array); units: (case, source_id, text). Issues, first of: indistinct_claim (not one whole
    statement, or said twice in the case), unfinished_claim (no full stop or exclamation mark), unknown_source (an id twice, none,
    more than ``most``, or one that the case hasn't), value_absent: ``missing`` are the claim's values that none of its sources has,
    ``candidates`` the first ``most`` sources, by id, that have one of them.
    """
    c = claims.select(case, "at", F.trim("text").alias("text"), "source_ids")
    again = c.groupBy(case, "text").count().where("count > 1").select(case, "text", F.lit(True).alias("again"))
    numbers = units.select(case, "source_id", evidence_numbers(F.col("text")).alias("numbers"))
    cited = c.select(case, "at", F.explode(F.array_distinct("source_ids")).alias("source_id")).join(numbers, [case, "source_id"])
    held = cited.groupBy(case, "at").agg(F.count("*").alias("known"), F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("held"))
    j = c.join(again, [case, "text"], "left").join(held, [case, "at"], "left")
    missing = F.array_sort(F.array_except(evidence_numbers(F.col("text")), F.coalesce("held", F.array().cast("array<string>"))))
    one = (whole_claims(F.col("text")) == F.array("text")) & claim_issue(F.col("text")).isNull() & F.col("again").isNull()
    n = F.size("source_ids")
    bound = (n >= 1) & (n <= most) & (F.size(F.array_distinct("source_ids")) == n) & (F.coalesce("known", F.lit(0)) == n)
    j = j.withColumn("missing", missing).withColumn("one", one)
    issue = F.when(~F.col("one"), "indistinct_claim").when(~F.col("text").rlike(r"[.!]$"), "unfinished_claim").when(~F.coalesce(bound, F.lit(False)), "unknown_source").when(F.size("missing") > 0, "value_absent")
    # Read twice below, so judged once and written.
    j = shuffled(materialize(j.select(case, "at", "text", "source_ids", "missing", issue.alias("issue")), "judged"))
    # Only values that are absent look for other sources, by the value.
    lost = j.where("issue = 'value_absent'").select(case, "at", F.explode("missing").alias("number"))
    where = lost.join(numbers.select(case, "source_id", F.explode("numbers").alias("number")), [case, "number"]).groupBy(case, "at").agg(F.slice(F.array_sort(F.collect_set("source_id")), 1, most).alias("candidates"))
    none = F.array().cast("array<string>")
    return j.join(where, [case, "at"], "left").select(case, "at", "text", "source_ids", "issue", F.when(F.col("issue") == "value_absent", F.col("missing")).otherwise(none).alias("missing"), F.coalesce("candidates", none).alias("candidates"))
