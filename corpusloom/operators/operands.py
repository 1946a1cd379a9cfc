"""Numeric requirements of claims against operands of passages: grounding, enumeration of decisive choices, ledgers of slots.

A case's requirements and operands meet by unit, after equal operands have become one row, so that nothing is a product of
all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import grammar as G
from corpusloom.functions.spans import NO_UNIT, quantity_spans
from corpusloom.operators import skew
from corpusloom.session import shuffled

#: Words that make a passage no evidence.
UNCERTAIN = r"(?i)\b(?:false|incorrect|denied|disputed|retracted|planned|intended|wanted|aimed|hoped|attempted|proposed|alleged|claimed|that)\b"
#: Operands that a task makes distinct, about so many.
TASK_OPERANDS = 1_000_000
#: Cells of a hash in which operands are counted to find the keys that have very many.
CELLS = 65_536


def unit_key(unit: Column) -> Column:
    """One spelling of a unit: percent signs and words are one, case doesn't count, none is empty."""
    low = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.when(low.isin("percent", "per cent"), "%").otherwise(low)


def numeric_rows(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, at, start, end, quote, value, unit, kind): a row for each quantity of a text, numbered from 0."""
    return texts.select(*keys, F.posexplode(quantity_spans(F.col(text))).alias("at", "q")).select(*keys, "at", "q.*")


def operand_issue(value: Column, unit: Column, quote: Column, source: Column) -> Column:
    """Why a stated operand isn't grounded in its source, or null.

    numeric_operand_schema: a null part; numeric_source_membership: the quote is blank, too long or nowhere whole in the source;
    numeric_value_format; numeric_value_not_grounded: the quote's one quantity isn't the value; numeric_unit_not_grounded: the
    unit isn't in the quote, or is a percentage where that is none; numeric_unit_required: words in the quote, or a unit right
    after it in the source, and no unit stated.
    """
    found = G.quantities(quote)
    one = F.get(found, F.lit(0))
    percent = F.coalesce(one["kind"] == "percent", F.lit(False))
    literal = F.concat(F.lit("(?i)(?<![\\p{L}\\p{N}_])"), F.regexp_replace(unit, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1"), F.lit("(?![\\p{L}\\p{N}_])"))
    in_quote = ((unit == "%") & quote.contains("%")) | (F.regexp_count(quote, literal) > 0)
    words = F.array_except(G.plain_words(quote), F.array(*[F.lit(w) for w in G.CARDINALS]))
    aligned = F.regexp_replace(quote, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")
    tail = F.concat(F.lit("(?<![\\p{L}\\p{N}])"), aligned, F.lit(rf"(?![\p{{L}}\p{{N}}]|[.,]\d)\s*+(?:%|(?!(?i:{'|'.join(w for w in NO_UNIT if w != 'or')})(?![A-Za-z]))[A-Za-z])"))
    return (
        F.when(value.isNull() | unit.isNull() | quote.isNull() | source.isNull(), "numeric_operand_schema")
        .when((F.trim(quote) == "") | (F.length(quote) > 2000) | (F.length(unit) > 40) | (G.token_aligned(quote, source) == 0), "numeric_source_membership")
        .when(~value.rlike(r"^[+-]?\d+(?:\.\d+)?$") | (F.length(value) > 60), "numeric_value_format")
        .when((F.size(found) != 1) | (one["exact"] != G.canonical(value)), "numeric_value_not_grounded")
        .when(percent != unit.isin("%", "percent"), "numeric_unit_not_grounded")
        .when((unit != "") & ~in_quote, "numeric_unit_not_grounded")
        .when((unit == "") & (F.size(words) > 0), "numeric_unit_required")
        .when((unit == "") & (F.regexp_count(source, tail) > 0), "numeric_unit_required")
    )


def _hot_keys(stated: DataFrame, case: str) -> tuple[int, DataFrame | None]:
    """The number of operands, and the (case, unit) with very many distinct values (``skew.MOST_HOT`` at most), or None.

    Only the keys of cells that are full are counted one by one.
    """
    cell = F.pmod(F.xxhash64(case, "unit"), F.lit(CELLS)).alias("cell")
    held = stated.groupBy(cell).agg(F.count("*").alias("n"))
    total, full = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_list(F.when(F.col("n") >= skew.HOT_ROWS, F.struct("cell", "n")))).first()
    least = max(skew.HOT_ROWS, -(-total // skew.MOST_HOT))
    full = [(r.cell,) for r in full if r.n >= least]
    if not full:
        return total, None
    spark = stated.sparkSession
    within = stated.select("*", cell).join(F.broadcast(spark.createDataFrame(full, "cell long")), "cell")
    keys = within.groupBy(case, "unit").agg(F.count_distinct("o_value").alias("n")).where(F.col("n") >= least).select(case, "unit")
    found = keys.collect()
    return total, spark.createDataFrame(found, keys.schema) if found else None


def operand_choices(requirements: DataFrame, operands: DataFrame, case: str, most: int | None = None) -> DataFrame:
    """(case, req, r_value, unit, o_value, truth, n_passages, first_passage, issue): the decisive choices of each requirement.

    requirements: (case, req, relation, value, unit); operands: (case, passage, value, unit), whose passages are those that may
    serve as evidence (``UNCERTAIN`` and the case's scope are the caller's filter). Distinct values of a case and unit are
    compared once, whatever number of passages state them; truth is what ``compare_bounds`` decides, and choices that it leaves
    open are none. All values are compared, however many there are; requirements that meet very many come to where these are
    dealt. One without a decisive choice gives one row with no_decisive_operand. Only a caller that sets ``most`` gets one row
    with too_many_operands and no choice for a requirement whose case and unit have more distinct values.
    """
    stated = operands.where(F.col(case).isNotNull() & F.col("value").isNotNull()).select(case, unit_key(F.col("unit")).alias("unit"), F.col("value").alias("o_value"), "passage")
    total, hot = _hot_keys(stated, case)
    # Few operands are equal, so they are dealt before they are counted: counting before the shuffle would hold all that a task reads.
    parts = max(int(operands.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_OPERANDS))
    seen = stated.repartition(parts, case, "unit", "o_value").groupBy(case, "unit", "o_value").agg(F.count_distinct("passage").alias("n_passages"), F.min("passage").alias("first_passage"))
    over = F.lit(False)
    if most is not None:
        of = Window.partitionBy(case, "unit")
        seen = seen.withColumn("over", F.count("*").over(of) > most).withColumn("least_value", F.min("o_value").over(of))
        # Of too many values one stands for all.
        seen = seen.where(~F.col("over") | (F.col("o_value") == F.col("least_value"))).drop("least_value")
        over = F.coalesce(F.col("over"), F.lit(False))
    asked = requirements.select(case, "req", "relation", F.col("value").alias("r_value"), unit_key(F.col("unit")).alias("unit"))
    asked = asked.withColumn("alone", F.count("*").over(Window.partitionBy(case, "req")) == 1).distinct()
    # A known relation decides every value, so an unknown one needs to meet none.
    asked = asked.withColumn("known", F.coalesce(F.col("relation").isin("eq", "only", "gt", "ge", "lt", "le"), F.lit(False)))

    def meet(asked: DataFrame, seen: DataFrame, how: str) -> DataFrame:
        seen = seen.withColumnRenamed("unit", "__unit").withColumnRenamed(case, "__case")
        return asked.join(seen, (F.col(case) == F.col("__case")) & (F.col("unit") == F.col("__unit")) & (F.col("known") | over), how)

    if hot is None or most is not None:
        met = meet(asked, shuffled(seen), "left")
    else:
        mark = F.broadcast(hot.withColumn("hot", F.lit(True)))
        asked, seen = (t.join(mark, [case, "unit"], "left").withColumn("hot", F.col("hot").isNotNull()) for t in (asked, seen))
        # Each of these requirements has a choice for every value of a hot key, so they are few beside the result.
        few = F.broadcast(asked.where("hot and known").drop("hot"))
        met = meet(asked.where("not (hot and known)").drop("hot"), shuffled(seen.where("not hot").drop("hot")), "left").unionByName(meet(few, seen.where("hot").drop("hot"), "inner"))
    truth = F.when(F.col("known") & ~over & F.col("o_value").isNotNull(), G.compare_bounds(G.bound(F.col("relation"), F.col("r_value")), G.bound(F.lit("eq"), F.col("o_value"))))
    met = met.withColumn("over", over).withColumn("truth", truth)
    columns, shown = [case, "req", "r_value", "unit"], ["o_value", "truth", "n_passages", "first_passage"]
    met = met.select(*columns, "relation", "alone", "over", "truth", *[F.when(F.col("truth").isNotNull(), F.col(c)).alias(c) for c in shown if c != "truth"])
    issue = F.when(F.col("truth").isNull(), F.when(F.col("over"), "too_many_operands").otherwise("no_decisive_operand")).alias("issue")
    found = met.where("alone or truth is not null").select(*columns, *shown, issue)
    # Requirements that share their number are open only if none of them has a choice. The columns of choices are null then; taken
    # from the choices they leave both parts with one shuffle.
    several = met.where("not alone").groupBy(*columns, "relation").agg(F.max("over").alias("over"), *[F.max(c).alias(c) for c in shown])
    several = several.withColumn("decided", F.max(F.col("truth").isNotNull()).over(Window.partitionBy(case, "req"))).where("not decided")
    return found.union(several.select(*columns, *shown, issue))


def requirement_verdicts(choices: DataFrame, case: str) -> DataFrame:
    """(case, truth, n_req, n_open): false where some requirement's choices are all false, true where all are all true, else null.

    Every requirement must have a choice, and each one's choices must agree; otherwise the case stays open.
    """
    per = choices.groupBy(case, "req").agg(F.when(F.min("truth") == F.max("truth"), F.min("truth")).alias("t"))
    all_ = per.groupBy(case).agg(F.count("*").alias("n_req"), F.count_if(F.col("t").isNull()).alias("n_open"), F.bool_and("t").alias("t"))
    return all_.select(case, F.when(F.col("n_open") == 0, F.col("t")).alias("truth"), "n_req", "n_open")


def slot_ledger(requirements: DataFrame, records: DataFrame, case: str) -> DataFrame:
    """(case, issue, filled, n_slots): whether records fill a case's slots, one at most for each requirement.

    requirements: (case, req, value, unit, quote); records: (case, req, kind, value, unit, quote). Issues, first of:
    numeric_requirement_ledger_schema (a slot without a requirement, or used twice), numeric_requirement_slot_binding (a record
    of another kind than value, or whose operand isn't the requirement's).
    """
    r = requirements.select(case, "req", *[F.col(c).alias(f"r_{c}") for c in ("value", "unit", "quote")], F.lit(True).alias("asked"))
    n = records.groupBy(case, "req").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("kind", "value", "unit", "quote")])
    j = r.join(n, [case, "req"], "full_outer")
    bound = (F.col("kind") == "value") & F.col("value").eqNullSafe(F.col("r_value")) & F.col("unit").eqNullSafe(F.col("r_unit")) & F.col("quote").eqNullSafe(F.col("r_quote"))
    bad_slot = F.col("asked").isNull() | F.coalesce(F.col("n") > 1, F.lit(False))
    per = j.groupBy(case).agg(
        F.bool_or(bad_slot).alias("bad"), F.bool_or(F.col("n").isNotNull() & ~bad_slot & ~F.coalesce(bound, F.lit(False))).alias("off"), F.count_if(F.col("n").isNotNull() & F.coalesce(bound, F.lit(False))).alias("filled"), F.count_if(F.col("asked")).alias("n_slots")
    )
    return per.select(case, F.when(F.col("bad"), "numeric_requirement_ledger_schema").when(F.col("off"), "numeric_requirement_slot_binding").alias("issue"), "filled", "n_slots")
