"""Words and boxes of pages: which box holds which word, table cells by alignment with headers, and claims about cells.

A box is given by its left, top, right and bottom (x0, y0, x1, y1), y growing downwards. Boxes and words of a page meet in the
squares of a grid whose size follows each box, so a page may hold any number of both.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.grammar import canonical
from corpusloom.functions.text import once
from corpusloom.session import materialize, shuffled

#: Headers of labels and of splits, captions, and how far aligned edges, lines and centres may be apart.
LABEL_HEADERS = ("type", "category", "label")
STATISTIC, VALUE = ("statistic", "statistics"), "value"
SPLITS = ("train", "training", "val", "validation", "dev", "development", "test", "testing")
CAPTION = r"(?i)^\s*Table\s+(\d+[A-Za-z]?)\s*[:.]"
INTEGER, PERCENT = r"^(?:\d{1,3}(?:,\d{3})+|\d+)$", r"^[+-]?\d+(?:\.\d+)?\s*%$"
EDGE, LINE, CENTRE, INSIDE, BELOW_HEADER = 2, 2, 4, 1, 72
COUNT_CLAIM = r"(?i)^In Table (\d+[A-Za-z]?), the count for ([^,;\n]+?) in the ([^,;\n]+?) column is ((?:\d{1,3}(?:,\d{3})+|\d+))\.$"
PERCENT_CLAIM = r"(?i)^In Table (\d+[A-Za-z]?), the percentage for ([^,;\n]+?) is ([+-]?\d+(?:\.\d+)?\s*%)\.$"
#: Sides of the smallest squares, a power of two.
LEAST_LEVEL = 3
#: Words and blocks of a page that may all meet; those of larger pages meet in the squares of a grid.
HELD = 1000


def points_in_boxes(points: DataFrame, boxes: DataFrame, page: str, closed: float | None = None) -> DataFrame:
    """``points`` (page, x, y, ...) joined with the ``boxes`` (page, x0, y0, x1, y1, ...) that hold them.

    A box holds its left and top edge but not the others; closed: all four, and so much around. A box lies in four squares at
    most of the grid whose squares are as large as its longer side; a point looks up one square of each size that boxes have.
    Boxes that are empty or have a null edge hold nothing. Columns of the two must differ but for the page.
    """
    room = F.lit(float(closed or 0))
    b = boxes.withColumns({"__l": F.col("x0") - room, "__t": F.col("y0") - room, "__r": F.col("x1") + room, "__b": F.col("y1") + room})
    fine = (F.col("__l") <= F.col("__r")) & (F.col("__t") <= F.col("__b")) if closed is not None else (F.col("__l") < F.col("__r")) & (F.col("__t") < F.col("__b"))
    side = F.greatest(F.col("__r") - F.col("__l"), F.col("__b") - F.col("__t"), F.lit(1.0))
    b = b.where(fine).withColumn("__level", F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(side)).cast("int")))
    # Sizes are few: at most the logarithm of the largest box.
    levels = [r[0] for r in b.select("__level").distinct().collect()]
    squares = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.pow(F.lit(2.0), "__level")), F.floor(F.col(hi) / F.pow(F.lit(2.0), "__level"))))
    b = b.withColumn("__gx", squares("__l", "__r")).withColumn("__gy", squares("__t", "__b"))
    p = points.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    for g, c in (("__gx", "x"), ("__gy", "y")):
        p = p.withColumn(g, F.floor(F.col(c) / F.pow(F.lit(2.0), "__level")))
    x, y = F.col("x"), F.col("y")
    far = (x <= F.col("__r")) & (y <= F.col("__b")) if closed is not None else (x < F.col("__r")) & (y < F.col("__b"))
    j = p.join(b, [page, "__level", "__gx", "__gy"]).where((x >= F.col("__l")) & (y >= F.col("__t")) & far)
    return j.drop("__level", "__gx", "__gy", "__l", "__t", "__r", "__b")


def count_in_boxes(points: DataFrame, boxes: DataFrame, page: str, box_id: str) -> DataFrame:
    """(box_id, n): how many ``points`` (page, x, y) each box (page, box_id, x0, y0, x1, y1) holds, as ``points_in_boxes`` has it; empty boxes are left out.

    Points of one place are one point that counts as often, equal boxes are one box: what meets are places and shapes.
    """
    edges = [page, "x0", "y0", "x1", "y1"]
    held = points_in_boxes(points.groupBy(page, "x", "y").agg(F.count("*").alias("__n")), boxes.select(*edges).distinct(), page)
    held = held.groupBy(*edges).agg(F.sum("__n").alias("__n"))
    return boxes.select(box_id, *edges).join(held, edges).groupBy(box_id).agg(F.sum("__n").alias("n"))


def read_boxes(words: DataFrame, boxes: DataFrame, page: str, box_id: str) -> DataFrame:
    """(page, box_id, text): the words (page, at, x0, y0, x1, y1, word) whose centre lies in each box, in their order ``at``; boxes without a word have an empty text."""
    centres = words.select(page, "at", "word", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    held = points_in_boxes(centres, boxes.select(page, box_id, "x0", "y0", "x1", "y1"), page)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    return boxes.select(page, box_id).join(held.groupBy(page, box_id).agg(text.alias("text")), [page, box_id], "left").withColumn("text", F.coalesce("text", F.lit("")))


def words_in_blocks(words: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """Words (page, at, w0, t0, w1, t1, word) of each block (page, block, x0, y0, x1, y1): those whose whole box lies in it, give or take INSIDE."""
    p = words.select(page, "at", "word", F.col("x0").alias("w0"), F.col("y0").alias("t0"), F.col("x1").alias("w1"), F.col("y1").alias("t1"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    b = blocks.select(page, "block", "x0", "y0", "x1", "y1")
    held = points_in_boxes(p, b, page, INSIDE)
    return held.where((F.col("w1") <= F.col("x1") + INSIDE) & (F.col("t1") <= F.col("y1") + INSIDE)).select(page, "block", "at", "word", "w0", "t0", "w1", "t1")


def _squeezed(text: Column) -> Column:
    """Blanks as one space each; most texts are so already and go by no pattern."""
    wide = functools.reduce(operator.or_, (F.contains(text, F.lit(b)) for b in ("  ", "\t", "\n", "\x0b", "\f", "\r")))
    return F.when(wide, F.regexp_replace(text, r"\s+", " ")).otherwise(text)


def count_header(text: Column) -> Column:
    """Whether a block's words are a statistic and its value, or a statistic and two or more different splits."""
    words = F.split(F.trim(F.lower(text)), r"\s+")
    columns = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    splits = (F.size(columns) >= 2) & (F.size(F.array_distinct(columns)) == F.size(columns)) & (F.size(F.array_except(columns, F.array(*[F.lit(s) for s in SPLITS]))) == 0)
    return F.get(words, F.lit(0)).isin(*STATISTIC) & ((columns == F.array(F.lit(VALUE))) | splits)


def _same_line(rows: DataFrame, anchors: DataFrame, keys: list[str], near: Column) -> DataFrame:
    """``rows`` (keys, t0, ...) joined with ``anchors`` (keys, a_t, ...) whose tops are LINE apart at most, by lines of the page."""
    line = lambda c: F.floor(F.col(c) / LINE)
    a = anchors.withColumn("__line", F.explode(F.array(line("a_t") - 1, line("a_t"), line("a_t") + 1)))
    return rows.withColumn("__line", line("t0")).join(a, [*keys, "__line"]).where((F.abs(F.col("t0") - F.col("a_t")) <= LINE) & near).drop("__line")


#: A word in a list, in the order of a line.
_WORD = ("w0", "at", "t0", "w1", "t1", "word")


def _upper(cap_y: Column, bottom: Column) -> Column:
    return F.when(cap_y > bottom, cap_y).otherwise(bottom + BELOW_HEADER)


def _header_fits(ws: Column, text: Column) -> Column:
    """Whether the words of a header block are those of its text, on one line."""
    return (F.transform(ws, lambda w: F.lower(w["word"])) == F.split(F.trim(F.lower(text)), r"\s+")) & F.forall(ws, lambda w: F.abs(w["t0"] - F.get(ws, F.lit(0))["t0"]) <= LINE)


def _near_rows(words: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """(page, table_id, header_block, block, body, cols, a_t, a_b, ws): lines of words that start at the label header's left edge, for pages whose words and blocks may all meet.

    All steps are by page, so that words and blocks are dealt once, and not at all if they come by page.
    """
    by = Window.partitionBy(page)
    table_id = F.when(F.col("kind") == "caption", F.regexp_extract("text", CAPTION, 1))
    heads = blocks.withColumns({"__caption": F.when(table_id != "", F.struct(table_id.alias("table_id"), F.col("y0").alias("y"))), "__head": F.when((F.col("kind") != "caption") & F.col("text").rlike(rf"(?i){STATISTIC[0]}") & count_header(F.col("text")), F.struct("block", "y1"))})
    alone = lambda c: F.when(F.count(c).over(by) == 1, F.max(c).over(by))
    heads = heads.withColumns({"__caption": alone("__caption"), "__head": alone("__head")}).where((F.col("kind") != "caption") & F.col("__caption").isNotNull() & F.col("__head").isNotNull())
    upper = _upper(F.col("__caption.y"), F.col("__head.y1"))
    # The words of a header that fits aren't integers, so its block has no cells of its own.
    is_head = F.col("block") == F.col("__head.block")
    asked = heads.where(is_head | ((F.col("y0") > F.col("__head.y1")) & (F.col("y0") < upper))).select(
        page, "block", *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")],
        F.when(~is_head, upper).alias("__upper"),
        F.struct(is_head.alias("is_head"), F.col("text").alias("body"), F.col("__caption.table_id").alias("table_id"), F.col("__head.block").alias("header_block")).alias("b"),
    )
    word = words.select(page, "x0", "y0", "x1", "y1", F.struct(*[F.col(c).alias(n) for c, n in zip(("x0", "at", "y0", "x1", "y1", "word"), _WORD)]).alias("w"))
    inside = (F.col("x0") >= F.col("__x0") - INSIDE) & (F.col("y0") >= F.col("__y0") - INSIDE)
    for c, edge in (("x0", "__x1"), ("y0", "__y1"), ("x1", "__x1"), ("y1", "__y1")):
        inside = inside & (F.col(c) <= F.col(edge) + INSIDE)
    inside = inside & (F.col("__upper").isNull() | (F.col("y1") < F.col("__upper")))
    held = shuffled(word).join(shuffled(asked), page).where(inside).groupBy(page, "block").agg(F.first("b").alias("b"), F.sort_array(F.collect_list("w")).alias("ws"))
    header = F.when(F.col("b.is_head") & _header_fits(F.col("ws"), F.col("b.body")), F.struct(F.get("ws", F.lit(0)).alias("label"), F.slice("ws", 2, F.size("ws") - 1).alias("cols")))
    held = held.withColumn("h", F.max(header).over(by)).where(F.col("h").isNotNull() & ~F.col("b.is_head"))
    local = held.select(page, "b.table_id", "b.header_block", "block", "b.body", "h.cols", once(F.filter("ws", lambda w: F.abs(w["w0"] - F.col("h.label.w0")) <= EDGE)).alias("starts"), "ws").where(F.size("starts") > 0)
    line = lambda s: F.struct(s["t0"].alias("a_t"), s["t1"].alias("a_b"), F.filter("ws", lambda w: F.abs(w["t0"] - s["t0"]) <= LINE).alias("ws"))
    return local.select(page, "table_id", "header_block", "block", "body", "cols", F.inline(F.transform("starts", line)))


def _far_rows(words: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """What ``_near_rows`` gives, for pages with any number of words and blocks: they meet in squares, lines and blocks."""
    caption = blocks.where("kind = 'caption'").withColumn("table_id", F.regexp_extract("text", CAPTION, 1)).where("table_id <> ''")
    caption = caption.groupBy(page).agg(F.count("*").alias("n"), F.first("table_id").alias("table_id"), F.first("y0").alias("cap_y")).where("n = 1").drop("n")
    heads = blocks.where((F.col("kind") != "caption") & count_header(F.col("text"))).groupBy(page).agg(F.count("*").alias("n"), F.first(F.struct("block", "text", "x0", "y0", "x1", "y1")).alias("h")).where("n = 1")
    head = caption.join(heads, page).select(page, "table_id", "cap_y", "h.block", "h.text", "h.x0", "h.y0", "h.x1", "h.y1")
    # Read by the header and by the rows.
    inside = shuffled(materialize(words_in_blocks(words, blocks.where("kind <> 'caption'").join(head.select(page), page, "left_semi"), page), "inside"))
    own = inside.join(head.select(page, "block"), [page, "block"], "left_semi").groupBy(page).agg(F.array_sort(F.collect_list(F.struct("w0", "at", "t0", "w1", "t1", "word"))).alias("ws"))
    head = head.join(own, page).where(_header_fits(F.col("ws"), F.col("text")))
    upper = _upper(F.col("cap_y"), F.col("y1"))
    head = head.select(page, "table_id", F.col("block").alias("header_block"), F.col("y1").alias("head_bottom"), upper.alias("upper"), F.get("ws", F.lit(0)).alias("label_head"), F.slice("ws", 2, F.size("ws") - 1).alias("cols"))
    bodies = blocks.where("kind <> 'caption'").select(page, "block", F.col("y0").alias("top"), F.col("text").alias("body")).join(head, page).where("top > head_bottom and top < upper")
    bodies = shuffled(materialize(bodies, "bodies"))
    local = inside.join(bodies.select(page, "block", "upper", F.col("label_head.w0").alias("left")), [page, "block"]).where("t1 < upper").drop("upper")
    starts = local.where(F.abs(F.col("w0") - F.col("left")) <= EDGE).select(page, "block", F.col("at").alias("row"), F.col("t0").alias("a_t"), F.col("t1").alias("a_b"))
    rows = _same_line(local.drop("left"), starts, [page, "block"], F.lit(True)).groupBy(page, "block", "row", "a_t", "a_b").agg(F.array_sort(F.collect_list(F.struct("w0", "at", "t0", "w1", "t1", "word"))).alias("ws"))
    return rows.join(bodies, [page, "block"]).select(page, "table_id", "header_block", "block", "body", "cols", "a_t", "a_b", "ws")


def count_cells(words: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """Integer cells of tables under explicit headers: (page, table_id, block, row_label, column_header, cell_text, and boxes).

    words: (page, at, x0, y0, x1, y1, word); blocks: (page, block, kind: caption or other, x0, y0, x1, y1, text). A page needs one
    caption and one header block (``count_header``), whose words must be the header's text on one line. A row of a block below the
    header (above a caption that is below it, else within BELOW_HEADER) starts at the label header's left edge; it counts if each
    column has one integer centred under its header, and its label and integers stand in the block's text so. A label and column
    that come twice, whatever their case, are ambiguous, and all their cells go.
    """
    words, blocks = words.where(F.col(page).isNotNull()), blocks.where(F.col(page).isNotNull())
    large = materialize(words.select(page).union(blocks.select(page)).groupBy(page).count().where(F.col("count") > HELD).select(page), "large")
    if large.isEmpty():
        rows = _near_rows(words, blocks, page)
    else:
        part = lambda how: (words.join(shuffled(large), page, how), blocks.join(shuffled(large), page, how), page)
        rows = _near_rows(*part("left_anti")).unionByName(_far_rows(*part("left_semi")))
    centre = lambda w: (w["w0"] + w["w1"]) / 2
    under = F.transform("cols", lambda c: F.filter("ws", lambda w: (F.abs(centre(w) - centre(c)) <= CENTRE) & w["word"].rlike(INTEGER)))
    rows = rows.withColumn("under", once(under)).where(F.forall("under", lambda v: F.size(v) == 1)).withColumn("values", F.transform("under", lambda v: F.get(v, F.lit(0))))
    labels = F.filter("ws", lambda w: w["w1"] < F.get(F.col("values"), F.lit(0))["w0"])
    rows = rows.withColumn("labels", once(labels)).where(F.size("labels") > 0).withColumn("row_label", F.array_join(F.transform("labels", lambda w: w["word"]), " "))
    stated = F.concat_ws(" ", "row_label", F.array_join(F.transform("values", lambda w: w["word"]), " "))
    rows = rows.where(F.contains(_squeezed(F.trim("body")), stated))
    cells = rows.select(page, "table_id", "header_block", "block", "row_label", "labels", "a_t", "a_b", F.explode(F.arrays_zip("cols", "values")).alias("x"))
    box = lambda w: F.array(*[w[c] for c in ("w0", "t0", "w1", "t1")])
    cells = cells.select(
        page, "table_id", "header_block", "block", "row_label", F.col("x.cols.word").alias("column_header"), F.col("x.values.word").alias("cell_text"), box(F.col("x.cols")).alias("column_box"),
        F.array(F.get("labels", F.lit(0))["w0"], F.col("a_t"), F.element_at("labels", -1)["w1"], F.col("a_b")).alias("label_box"), box(F.col("x.values")).alias("cell_box"),
    )
    again = F.count("*").over(Window.partitionBy(page, F.lower("row_label"), F.lower("column_header")))
    return cells.withColumn("__again", again).where("__again = 1").drop("__again")


def percentage_cells(words: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """(page, table_id, header_block, block, row_label, column_header, cell_text, and boxes): one percentage of each row under the lowest header.

    The header is the last block (by ``block``) with a line % and a line of a label header; it needs one of either, on one line, the
    label to the left. A row is a block below it with one percentage at the column's left edge that ends before the next column;
    its label begins at the label header's left edge. Labels that come twice, whatever their case, go.
    """
    caption = blocks.where("kind = 'caption'").withColumn("table_id", F.regexp_extract("text", CAPTION, 1)).where("table_id <> ''")
    caption = caption.groupBy(page).agg(F.count("*").alias("n"), F.first("table_id").alias("table_id")).where("n = 1").drop("n")
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.lower(F.trim(x)))
    fits = F.array_contains(lines, "%") & F.arrays_overlap(lines, F.array(*[F.lit(h) for h in LABEL_HEADERS]))
    head = blocks.where((F.col("kind") != "caption") & fits).groupBy(page).agg(F.max_by(F.struct("block", "x0", "y0", "x1", "y1"), "block").alias("h"))
    head = caption.join(head, page).select(page, "table_id", F.col("h.block").alias("header_block"), F.col("h.x1").alias("head_right"), F.col("h.y1").alias("head_bottom"))
    inside = words_in_blocks(words.join(head.select(page), page, "left_semi"), blocks.where("kind <> 'caption'"), page)
    own = inside.join(head.select(page, F.col("header_block").alias("block")), [page, "block"], "left_semi").groupBy(page).agg(F.collect_list(F.struct("w0", "t0", "w1", "t1", "word")).alias("ws"))
    head = head.join(own, page).withColumn("cs", F.filter("ws", lambda w: w["word"] == "%")).withColumn("ls", F.filter("ws", lambda w: F.lower(w["word"]).isin(*LABEL_HEADERS)))
    head = head.where("size(cs) = 1 and size(ls) = 1").withColumn("c", F.get("cs", F.lit(0))).withColumn("l", F.get("ls", F.lit(0))).where((F.abs(F.col("c.t0") - F.col("l.t0")) <= LINE) & (F.col("l.w1") < F.col("c.w0")))
    after = F.array_min(F.transform(F.filter("ws", lambda w: (w["w0"] > F.col("c.w0")) & (F.abs(w["t0"] - F.col("c.t0")) <= LINE)), lambda w: w["w0"]))
    head = head.select(page, "table_id", "header_block", "head_bottom", "c", "l", F.coalesce(after, F.col("head_right")).alias("limit"))
    bodies = blocks.where("kind <> 'caption'").select(page, "block", F.col("y0").alias("top"), F.col("text").alias("body")).join(head, page).where("top > head_bottom")
    rows = inside.join(bodies, [page, "block"]).groupBy(page, "block").agg(F.collect_list(F.struct("w0", "at", "t0", "w1", "t1", "word")).alias("ws"), *[F.first(c).alias(c) for c in ("table_id", "header_block", "body", "c", "l", "limit")])
    values = F.filter("ws", lambda w: (F.abs(w["w0"] - F.col("c.w0")) <= EDGE) & (w["w1"] <= F.col("limit") + INSIDE) & w["word"].rlike(PERCENT))
    rows = rows.withColumn("vs", values).where("size(vs) = 1").withColumn("v", F.get("vs", F.lit(0)))
    labels = F.array_sort(F.filter("ws", lambda w: (F.abs(w["t0"] - F.col("v.t0")) <= LINE) & (w["w0"] >= F.col("l.w0") - EDGE) & (w["w1"] < F.col("c.w0"))))
    rows = rows.withColumn("labels", labels).where((F.size("labels") > 0) & (F.abs(F.get("labels", F.lit(0))["w0"] - F.col("l.w0")) <= EDGE)).withColumn("row_label", F.array_join(F.transform("labels", lambda w: w["word"]), " "))
    source = F.split(F.trim("body"), r"\s+")
    rows = rows.where(F.contains(F.concat(F.lit(" "), F.array_join(source, " "), F.lit(" ")), F.concat(F.lit(" "), "row_label", F.lit(" "))) & (F.size(F.filter(source, lambda t: t == F.col("v.word"))) == 1))
    box = lambda w: F.array(*[F.col(f"{w}.{c}") for c in ("w0", "t0", "w1", "t1")])
    edge = lambda f, c: f(F.transform("labels", lambda w: w[c]))
    cells = rows.select(
        page, "table_id", "header_block", "block", "row_label", F.col("l.word").alias("label_header"), F.col("c.word").alias("column_header"), F.col("v.word").alias("cell_text"), box("c").alias("column_box"),
        F.array(edge(F.array_min, "w0"), edge(F.array_min, "t0"), edge(F.array_max, "w1"), edge(F.array_max, "t1")).alias("label_box"), box("v").alias("cell_box"),
    )
    once = cells.groupBy(page, F.lower("row_label").alias("k_row")).count().where("count = 1").select(page, "k_row")
    return cells.join(once, (cells[page] == once[page]) & (F.lower(cells["row_label"]) == once["k_row"]), "left_semi")


def cell_claim_verdict(claim: Column, context: Column, cell: Column, percent: bool = False) -> Column:
    """(label, reason) of a claim about one cell (a row of ``count_cells`` or ``percentage_cells`` as a struct); null where the claim has another form.

    label: support, contradict or not_enough_info.
    """
    form = PERCENT_CLAIM if percent else COUNT_CLAIM
    part = lambda g: F.regexp_extract(F.trim(claim), form, g)
    value = part(3 if percent else 4)
    words = F.split(F.trim(F.coalesce(context, F.lit(""))), r"\s+")
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    label, text = cell["row_label"], cell["cell_text"]
    named = lambda t: F.contains(spaced, F.concat(F.lit(" "), t, F.lit(" ")))
    a, v, h = cell["label_box"], cell["cell_box"], cell["column_box"]
    at = lambda b, i: F.get(b, F.lit(i))
    scope = (F.lower(part(1)) == F.lower(cell["table_id"])) & (part(2) == label)
    if percent:
        scope = scope & (cell["column_header"] == "%") & F.lower(cell["label_header"]).isin(*LABEL_HEADERS)
        there = text.rlike(PERCENT) & (F.size(F.filter(words, lambda w: w == F.replace(text, F.lit(" "), F.lit("")))) == 1) & named(label)
        off = F.abs(at(v, 0) - at(h, 0)) > EDGE
    else:
        scope = scope & (part(3) == cell["column_header"]) & text.rlike(INTEGER)
        there = named(label) & named(text)
        off = F.abs((at(h, 0) + at(h, 2)) / 2 - (at(v, 0) + at(v, 2)) / 2) > CENTRE
    geometry = (F.abs(at(a, 1) - at(v, 1)) > LINE) | (at(a, 2) >= at(v, 0)) | off | (at(v, 1) <= at(h, 3))
    plain = lambda t: canonical(F.replace(t, F.lit("%"), F.lit("")))
    stated, seen = plain(value), plain(text)
    same = stated == seen
    kind = "percentage" if percent else "count"
    pair = lambda x, r: F.struct(F.lit(x).alias("label"), F.lit(r).alias("reason"))
    out = F.when(cell.isNull(), pair("not_enough_info", "table_row_source_mismatch")).when(~F.coalesce(scope, F.lit(False)), pair("not_enough_info", "table_scope_mismatch"))
    out = out.when(~there, pair("not_enough_info", "table_cell_absent_from_source")).when(geometry, pair("not_enough_info", "table_cell_geometry_mismatch"))
    if percent:
        share = lambda t: t.try_cast("decimal(38,10)").between(0, 100)
        out = out.when(~F.coalesce(share(stated) & share(seen), F.lit(False)), pair("not_enough_info", "table_percentage_out_of_range"))
    out = out.when(same, pair("support", f"table_{kind}_matches")).otherwise(pair("contradict", f"table_{kind}_differs"))
    return F.when(F.trim(claim).rlike(form), out)
