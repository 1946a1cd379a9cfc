"""The part of a page that a question's table reference asks for: its caption with the blocks around, and cells of audited tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.cells import count_header

#: How far above a caption blocks belong to it, how far below, how near a header must be there, and cells at most.
ABOVE, BELOW, HEADER, MOST_CELLS = 180, 110, 28, 8
REFERENCE = r"(?i)\btable\s+(\d+[a-z]?)\b"


def table_reference(question: Column) -> Column:
    """The one table that a question names, in lower case; null for none or several."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(REFERENCE), F.lit(1)), F.lower))
    return F.when(F.size(names) == 1, F.get(names, F.lit(0)))


def referenced_table_context(questions: DataFrame, hits: DataFrame, chunks: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, rank from 0, chunk): the caption of the table that a question names, and the blocks near it, in reading order.

    questions: (case, question); hits: (case, page) that retrieval found; chunks: (case, page, chunk, x0, y0, x1, y1, text), audited
    cells left out. A case needs one reference, one caption of it with a box, and a hit on its page. Blocks above it, ABOVE
    points at most and over its width, belong to it; where none of them is a count header but there is one header HEADER
    points at most below it, the blocks up to BELOW points below do instead.
    """
    asked = questions.select(case, table_reference(F.col("question")).alias("table")).where("table is not null")
    boxed = chunks.where(F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull())
    named = boxed.withColumn("named", F.lower(F.regexp_extract("text", r"(?i)^\s*table\s+(\d+[a-z]?)\s*[:.]", 1))).where("named <> ''")
    captions = named.join(asked, case).where("named = table").groupBy(case).agg(F.count("*").alias("n"), F.first(F.struct("page", "chunk", "x0", "y0", "x1", "y1")).alias("c")).where("n = 1")
    captions = captions.select(case, F.col("c.page").alias("page"), F.col("c.chunk").alias("caption"), *[F.col(f"c.{k}").alias(f"c_{k}") for k in ("x0", "y0", "x1", "y1")])
    captions = captions.join(hits.select(case, "page"), [case, "page"], "left_semi")
    over = (F.col("x0") < F.col("c_x1")) & (F.col("x1") > F.col("c_x0"))
    up, down = F.col("c_y0") - F.col("y1"), F.col("y0") - F.col("c_y1")
    near = boxed.join(captions, [case, "page"]).where(over & (up.between(0, ABOVE) | down.between(0, BELOW)))
    near = near.select(case, "chunk", "x0", "y0", up.between(0, ABOVE).alias("above"), down.between(0, BELOW).alias("below"), (down.between(0, HEADER) & count_header(F.col("text"))).alias("head_below"), (up.between(0, ABOVE) & count_header(F.col("text"))).alias("head_above"))
    # The blocks around one caption are a bounded piece of a page.
    per = near.groupBy(case).agg(F.collect_list(F.struct("y0", "x0", "chunk", "above", "below")).alias("b"), F.count_if("head_above").alias("ha"), F.count_if("head_below").alias("hb"))
    both = captions.join(per, case, "left")
    turn = (F.col("ha") == 0) & (F.col("hb") == 1)
    chosen = F.filter("b", lambda x: F.when(turn, x["below"]).otherwise(x["above"]))
    ordered = F.transform(F.array_sort(chosen), lambda x: x["chunk"])
    rows = F.concat(F.array("caption"), F.when(F.col("b").isNotNull(), ordered).otherwise(F.slice(F.array("caption"), 1, 0)))
    return both.select(case, F.posexplode(rows).alias("rank", "chunk"))


def relevant_cells(questions: DataFrame, cells: DataFrame, case: str = "case_id", most: int = MOST_CELLS) -> DataFrame:
    """(case, rank from 1, cell): the cells of the one table that a question names whose column it names and whose row it shares a word with.

    cells: (case, cell, at: their order, table_number, column, row_label, row_group). Rows that agree but for signs come first, then
    by words; equals in their order, ``most`` at most.
    """
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)[+−-]?\w+"), F.lit(0)))
    bare = lambda a: F.array_distinct(F.transform(a, lambda t: F.regexp_replace(t, "^[+−-]+", "")))
    asked = questions.select(case, table_reference(F.col("question")).alias("table"), terms(F.col("question")).alias("q")).where("table is not null")
    j = cells.join(asked, case).where(F.lower("table_number") == F.col("table")).withColumns({"c": terms(F.col("column")), "r": terms(F.col("row_label")), "g": terms(F.col("row_group"))})
    j = j.where((F.size("c") > 0) & (F.size(F.array_except("c", "q")) == 0) & F.arrays_overlap("r", "q"))
    near = F.size(F.array_intersect(bare(F.col("r")), bare(F.col("q")))) + F.size(F.array_intersect("g", "q"))
    w = Window.partitionBy(case).orderBy(F.desc(near), F.desc(F.size(F.array_intersect("r", "q"))), "at")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(case, "rank", "cell")
