"""Tables in texts: cells of pipe tables, and claims about two rows, a leader or a preference checked against them.

A verdict needs exactly one table that decides; everything else abstains. Tables, rows and columns meet claims by joins on the
text's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.grammar import CARDINALS, cell_value, names

#: The form of a comparison, its directions, words round a row's name, and metrics of which less is better.
COMPARISON = r"(?i)\b(higher|greater|more|lower|less|fewer|equal)\b([^,;.!?]*?)\b(?:than|to)\s+"
ABOVE, BELOW = ("higher", "greater", "more"), ("lower", "less", "fewer")
WRAPPERS = ("contains", "contained", "has", "had", "achieved", "obtained", "recorded", "scored", "model", "classifier")
REFUSED = ("not", "without", "but", "only", "except")
JOINED = r"(?i)\b(?:and|or|but)\b"
ROSTER = rf"(?i)^Among (?:the )?(\d+|{'|'.join(CARDINALS)}) ([\w -]+?) in (?:([\w.-]+)[’']s )?Table (\d+)$"
LESS_IS_BETTER = {"mae": True, "mse": True, "rmse": True, "icc": False, "accuracy": False, "f1": False}
LONG_NAMES = {"mean absolute error": "mae", "mean squared error": "mse", "root mean squared error": "rmse", "intraclass correlation coefficient": "icc", "intraclass correlation": "icc"}


def table_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, caption, width, row, col, header, name, cell): cells of runs of two lines or more that hold a bar.

    The first line is the header, lines of dashes are none, name is the row's first cell, caption the paragraph before the
    table. Tables need two columns, distinct headers with a word, rows, and rows of the header's length.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text_col, r"\r?\n")).alias("at", "line"))
    by = Window.partitionBy(id_col).orderBy("at")
    bar = F.contains("line", F.lit("|"))
    marked = lines.withColumn("bar", bar).withColumn("block", F.sum((bar != F.coalesce(F.lag(bar).over(by), F.lit(False))).cast("int")).over(by))
    last_blank = F.max(F.when(F.trim("line") == "", F.col("at"))).over(by)
    marked = marked.withColumn("para", F.coalesce(last_blank, F.lit(-1)))
    inner = F.regexp_replace(F.trim("line"), r"^\|+|\|+$", "")
    rows = marked.where("bar").select(id_col, "block", "at", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))
    rule = F.forall("cells", lambda c: c.rlike("^:?-+:?$"))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy(id_col, "block").orderBy("at")) == 1)
    head = rows.where("first").select(id_col, "block", F.col("at").alias("top"), F.col("cells").alias("head"))
    body = rows.where(~F.col("first") & ~rule).select(id_col, "block", "at", "cells")
    words = F.transform("head", lambda h: F.array_join(names(h), " "))
    fine = (F.size("head") >= 2) & (F.size(F.array_distinct(words)) == F.size("head")) & F.forall(words, lambda w: w != "")
    head = head.where(fine)
    ragged = body.join(head, [id_col, "block"]).where(F.size("cells") != F.size("head")).select(id_col, "block").distinct()
    whole = body.join(head, [id_col, "block"]).join(ragged, [id_col, "block"], "left_anti")
    # The caption: what stands between the last blank line before the table, or the text's start, and the table.
    tops = head.select(id_col, F.col("block").alias("b"), "top")
    # Blank lines just before the table don't cut it off.
    above = marked.where(~F.col("bar") & (F.trim("line") != "")).select(id_col, "at", "line", "para", F.col("block").alias("lb"))
    spoken = above.join(tops, id_col).where((F.col("lb") == F.col("b") - 1))
    nearest = spoken.groupBy(id_col, "b").agg(F.max_by("para", "at").alias("para"))
    caption = spoken.join(nearest, [id_col, "b", "para"]).groupBy(id_col, "b").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    caption = caption.select(id_col, F.col("b").alias("block"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("caption"))
    out = whole.join(caption, [id_col, "block"], "left").withColumn("row", F.row_number().over(Window.partitionBy(id_col, "block").orderBy("at")))
    out = out.select(id_col, "block", F.coalesce("caption", F.lit("")).alias("caption"), F.size("head").alias("width"), "row", F.get("cells", F.lit(0)).alias("name"), F.posexplode(F.arrays_zip("head", "cells")).alias("col", "x"))
    return out.select(id_col, "block", "caption", "width", "row", "col", F.col("x.head").alias("header"), "name", F.col("x.cells").alias("cell"))


def named_row(rows: DataFrame, by: list[str], side: str, name: str = "name") -> DataFrame:
    """The row of each group whose name's words are all in ``side`` (words), the one of most words; none if another such name isn't part of it."""
    own = F.array_distinct(names(F.col(name)))
    hit = rows.withColumn("__w", own).where((F.size("__w") > 0) & (F.size(F.array_except("__w", F.col(side))) == 0))
    w = Window.partitionBy(*by).orderBy(F.desc(F.size("__w")), F.desc("row"))
    best = hit.withColumn("__r", F.row_number().over(w)).withColumn("__b", F.first("__w").over(w))
    clear = F.bool_and((F.col("__r") == 1) | ((F.size(F.array_except("__w", "__b")) == 0) & (F.size("__w") < F.size("__b")))).over(Window.partitionBy(*by))
    return best.withColumn("__c", clear).where("__c and __r = 1").drop("__r", "__b", "__c")


def compare_rows(claims: DataFrame, cells: DataFrame, id_col: str = "doc_id", claim_id: str = "claim_id", claim_col: str = "claim") -> DataFrame:
    """(claim_id, label): support or contradict for claims like 'A has a higher metric than B', from the one table that holds both rows and the column; others give no row.

    Both rows are found by their names, one column by the metric's words, or, where the caption has these, by words before the
    claim's last comma; other words of the claim must be in the caption, cells must be numbers of one unit. What stands before
    the comma may be a roster (Among the three models in Table 2), which the table must match: its number, as many rows of
    different names, and the noun that heads its first column. A second row, joined by and, or or but, isn't compared.
    """
    c = claims.withColumn("__n", F.regexp_count(claim_col, F.lit(COMPARISON))).where("__n = 1")
    c = c.where(~F.arrays_overlap(names(F.col(claim_col)), F.array(*[F.lit(w) for w in REFUSED])))
    parts = F.split(claim_col, COMPARISON, 2)
    words = lambda col: F.array_distinct(names(col))
    lead = F.substring_index(parts[0], ",", -1)
    metric = F.array_except(words(F.regexp_extract(claim_col, COMPARISON, 2)), F.array(F.lit("score"), F.lit("scores")))
    before = F.when(F.contains(parts[0], F.lit(",")), F.substring(parts[0], F.lit(1), F.length(parts[0]) - F.length(lead) - 1)).otherwise("")
    c = c.where(~parts[1].rlike(JOINED))
    c = c.select(
        id_col, claim_id, F.lower(F.regexp_extract(claim_col, COMPARISON, 1)).alias("dir"), metric.alias("metric"), words(parts[0]).alias("left"), words(parts[1]).alias("right"), words(lead).alias("subject"),
        words(before).alias("prefix"), before.alias("before"), F.get(F.regexp_extract_all(F.col(claim_col), F.lit(r"(?i)\btable\s+(\d+)\b"), F.lit(1)), F.lit(0)).alias("table"),
    ).where(F.size("metric") > 0)
    rows = cells.select(id_col, "block", "caption", "row", "name").distinct().join(c, id_col)
    named = (F.col("table").isNull()) | F.regexp_like("caption", F.concat(F.lit(r"(?i)\btable\s+"), "table", F.lit(r"\b")))
    rows = rows.where(named)
    by = [claim_id, "block"]
    a = named_row(rows, by, "left").select(*by, F.col("row").alias("ra"), F.col("__w").alias("wa"))
    b = named_row(rows, by, "right").select(*by, F.col("row").alias("rb"), F.col("__w").alias("wb"))
    pair = a.join(b, by).where("ra <> rb").join(rows.select(*by, id_col, "caption", "dir", "metric", "subject", "right", "prefix", "before").distinct(), by)
    scope = words(F.col("caption"))
    rest = F.array_union(F.array_except(F.array_except("subject", "wa"), F.array(*[F.lit(w) for w in WRAPPERS])), F.array_except("right", "wb"))
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    sizes = cells.where("col = 0").groupBy(id_col, "block").agg(F.count("*").alias("rows"), F.count_distinct(F.array_join(names(F.col("name")), " ")).alias("different"), F.first(words(F.col("header"))).alias("noun"))
    pair = pair.join(sizes, [id_col, "block"]).withColumn("scope", scope).where(inside(rest, F.col("scope")))
    of = lambda g: F.regexp_extract("before", ROSTER, g)
    roster, group = F.col("before").rlike(ROSTER), names(of(2))
    number = F.coalesce(of(1).try_cast("int"), F.try_element_at(F.create_map(*[F.lit(x) for i, w in enumerate(CARDINALS) for x in (w, i)]), F.lower(of(1))))
    last = F.try_element_at(group, F.lit(-1))
    fits = (F.size("noun") == 1) & last.endswith("s") & (F.regexp_replace(last, "s$", "") == F.get("noun", F.lit(0))) & (F.col("rows") == number) & (F.col("different") == number)
    fits = fits & inside(F.slice(group, 1, F.greatest(F.size(group) - 1, F.lit(0))), F.col("scope")) & inside(words(of(3)), F.col("scope")) & F.regexp_like("caption", F.concat(F.lit(r"(?i)\btable\s+"), of(4), F.lit(r"\b")))
    pair = pair.where(~roster | F.coalesce(fits, F.lit(False)))
    plain = F.array_except("prefix", F.array(*[F.lit(w) for w in ("split", "set", "benchmark", "evaluation")]))
    pair = pair.withColumn("qualifiers", F.when(roster, F.slice(plain, 1, 0)).otherwise(plain))
    heads = cells.where("col > 0").select(id_col, "block", "col", words(F.col("header")).alias("hw")).distinct()
    met = pair.join(heads, [id_col, "block"])
    direct = inside("hw", F.col("metric")) & inside("metric", F.col("hw")) & inside("qualifiers", F.col("scope"))
    by_scope = (F.size("hw") > 0) & inside("metric", F.col("scope")) & inside("hw", F.col("qualifiers")) & inside("qualifiers", F.array_union("scope", "hw"))
    met = met.withColumn("direct", direct).withColumn("any_direct", F.bool_or("direct").over(Window.partitionBy(*by)))
    column = met.where(F.col("direct") | (~F.col("any_direct") & by_scope))
    column = column.withColumn("__k", F.count("*").over(Window.partitionBy(*by))).where("__k = 1")
    value = cells.select(id_col, "block", "row", "col", cell_value(F.col("cell")).alias("v"))
    both = column.join(value.select(id_col, "block", "col", F.col("row").alias("ra"), F.col("v").alias("x")), [id_col, "block", "col", "ra"]).join(value.select(id_col, "block", "col", F.col("row").alias("rb"), F.col("v").alias("y")), [id_col, "block", "col", "rb"])
    both = both.where("x.unit = y.unit")
    holds = F.when(F.col("dir").isin(*ABOVE), F.col("x.value") > F.col("y.value")).when(F.col("dir").isin(*BELOW), F.col("x.value") < F.col("y.value")).otherwise(F.col("x.value") == F.col("y.value"))
    return both.groupBy(claim_id).agg(F.count("*").alias("n"), F.min(F.when(holds, "support").otherwise("contradict")).alias("label")).where("n = 1").select(claim_id, "label")


def metric_column(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, block, col, row, name, value) of columns all of whose cells are plain numbers of one unit; a spread or a scale makes a column none."""
    plain = F.col("cell").rlike(r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*%?$")
    v = cells.where("col > 0").withColumn("v", F.when(plain, cell_value(F.col("cell"))))
    w = Window.partitionBy(id_col, "block", "col")
    v = v.withColumn("all", F.bool_and(F.col("v").isNotNull()).over(w)).withColumn("lo", F.min("v.unit").over(w)).withColumn("hi", F.max("v.unit").over(w))
    return v.where("all and lo = hi").select(id_col, "block", "col", "header", "row", "name", F.col("v.value").alias("value"))


def refute_lead(claims: DataFrame, cells: DataFrame, id_col: str = "doc_id", claim_id: str = "claim_id") -> DataFrame:
    """(claim_id, label, leader) of claims (id, claim_id, member, metric, count) that a member leads all ``count`` rows in a metric: contradict where another has more; a lead isn't proved, so others give no row."""
    col = metric_column(cells, id_col)
    low = lambda c: F.lower(F.trim(c))
    j = claims.join(col, id_col).where(low(F.col("header")) == low(F.col("metric")))
    per = j.groupBy(claim_id, "block", "col").agg(F.count("*").alias("n"), F.count_distinct(low(F.col("name"))).alias("names"), F.max("value").alias("top"), F.max_by("name", F.struct("value", (-F.col("row")).alias("r"))).alias("leader"), F.max(F.when(low(F.col("name")) == low(F.col("member")), F.col("value"))).alias("own"), F.first("count").alias("asked"))
    good = per.where("n = asked and names = n and own is not null")
    one = good.withColumn("k", F.count("*").over(Window.partitionBy(claim_id))).where("k = 1 and top > own")
    return one.select(claim_id, F.lit("contradict").alias("label"), F.lower("leader").alias("leader"))


def metric_key(name: Column) -> Column:
    """The short name of a metric; a name that has none is itself."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), "^the ", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LONG_NAMES.items() for x in p]), plain), plain)


def compare_preferences(claims: DataFrame, cells: DataFrame, id_col: str = "doc_id", claim_id: str = "claim_id") -> DataFrame:
    """(claim_id, label) of claims (id, claim_id, subject, baseline, metrics) that a subject beats a baseline on each metric, by the metric's own order: support if all hold, contradict if one doesn't; no row where a row, a column or a value isn't there once."""
    low = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^the ", "")
    asked = claims.select(id_col, claim_id, low(F.col("subject")).alias("s"), low(F.col("baseline")).alias("b"), F.size("metrics").alias("many"), F.explode("metrics").alias("m")).withColumn("m", metric_key(F.col("m"))).where("s <> b")
    less = F.try_element_at(F.create_map(*[F.lit(x) for p in LESS_IS_BETTER.items() for x in p]), F.col("m"))
    value = cells.where("col > 0").select(id_col, "block", metric_key(F.col("header")).alias("m"), low(F.col("name")).alias("name"), cell_value(F.col("cell")).alias("v"))
    j = asked.withColumn("less", less).join(value, [id_col, "m"])
    of = lambda who: F.collect_list(F.when(F.col("name") == F.col(who), F.col("v")))
    hits = lambda who: F.count_if(F.col("name") == F.col(who))
    per = j.groupBy(claim_id, "block", "m", "less", "many").agg(of("s").alias("x"), of("b").alias("y"), hits("s").alias("nx"), hits("b").alias("ny"))
    x, y = F.get("x", F.lit(0)), F.get("y", F.lit(0))
    good = (F.col("nx") == 1) & (F.col("ny") == 1) & (F.size("x") == 1) & (F.size("y") == 1) & F.col("less").isNotNull() & (x["unit"] == y["unit"])
    won = F.when(F.col("less"), x["value"] < y["value"]).otherwise(x["value"] > y["value"])
    tables = per.select(claim_id, "block", "many", F.coalesce(good, F.lit(False)).alias("good"), won.alias("won")).groupBy(claim_id, "block", "many").agg(F.count("*").alias("n"), F.bool_and("good").alias("good"), F.bool_and("won").alias("won")).where("good and n = many")
    return tables.groupBy(claim_id).agg(F.count("*").alias("k"), F.first("won").alias("won")).where("k = 1").select(claim_id, F.when(F.col("won"), "support").otherwise("contradict").alias("label"))
