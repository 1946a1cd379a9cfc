"""Queries on requirements and their proof: interval cover, grounded quantities, operand choices, cells, ledgers and populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import clauses as C
from corpusloom.functions import spans
from corpusloom.functions.grammar import CARDINALS
from corpusloom.operators import assessment, cells, context, contract, ledger, operands, populations, requirements, rules
from corpusloom.session import materialize, shuffled, table
from corpusloom.streaming import budgets

FIRST_DAY = "1990-01-01"
#: Lines of a table whose words are made and sorted in one task.
PART_LINES = 100_000


def interval_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Days of 450 that no line of an order covers; a line covers as many days from its shipping day as it has pieces."""
    day = F.datediff("l_shipdate", F.lit(FIRST_DAY)) % 400
    lines = table(spark, sf, "lineitem").select("l_orderkey", day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"))
    whole = lines.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("start"), F.lit(450).alias("end"))
    g = requirements.gaps(lines, whole, ["l_orderkey"])
    return g.groupBy("l_orderkey").agg(F.count("*").alias("n_gaps"), F.sum(F.col("end") - F.col("start")).cast("long").alias("days"))


def _item_quotes(items: DataFrame) -> DataFrame:
    """A stand-in for quoted requirements: of each eight tokens the first six, as one quote."""
    t = items.select("item_id", "text", spans.token_spans(F.col("text")).alias("ts")).where("size(ts) > 0")
    first = F.sequence(F.lit(1), F.size("ts"), F.lit(8))
    at = t.select("item_id", "text", "ts", F.explode(first).alias("i"))
    own = F.slice("ts", F.col("i"), 6)
    lo, hi = F.get(own, F.lit(0))["start"], F.element_at(own, -1)["end"]
    return at.select("item_id", F.substring("text", lo + 1, hi - lo).alias("quote"))


def claim_cover(spark: SparkSession, sf: str) -> DataFrame:
    """What an item's quotes leave uncovered of its content, and how many of them are bound to one place."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    bound = materialize(requirements.bind_quotes(items, _item_quotes(items), "item_id"), "bound")
    found = requirements.claim_coverage(items, bound.where("issue is null"), "item_id")
    counts = bound.groupBy("item_id").agg(F.count_if(F.col("issue").isNull()).alias("n_bound"))
    return found.join(counts, "item_id", "left").select(
        "item_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.coalesce("n_bound", F.lit(0)).alias("n_bound"), F.size("uncovered").cast("long").alias("n_uncovered"), F.get("uncovered", F.lit(0))["start"].cast("long").alias("first_uncovered"), "issue"
    )


def quantity_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Every quantity of a sentence on each order, with offsets and unit."""
    k = F.col("o_orderkey")
    word = F.element_at(F.array(*[F.lit(w) for w in CARDINALS]), (k % 21 + 1).cast("int"))
    text = F.concat(F.lit("Order "), k, F.lit(" had "), 1000 + k % 9000, F.lit(" parcels, "), k % 100, F.lit("% off and "), word, F.lit(" boxes"))
    q = operands.numeric_rows(table(spark, sf, "orders").select("o_orderkey", text.alias("text")), ["o_orderkey"])
    return q.select("o_orderkey", "start", "end", "quote", "value", "unit", "kind")


def _operands(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Of each order at least 30 pieces in a line, and a tax of its own percentage; a line states its pieces and its tax."""
    o = table(spark, sf, "orders").select("o_orderkey")
    asked = o.select("o_orderkey", F.lit(0).alias("req"), F.lit("ge").alias("relation"), F.lit(30).cast("long").alias("value"), F.lit("pieces").alias("unit"))
    asked = asked.union(o.select("o_orderkey", F.lit(1), F.lit("eq"), F.col("o_orderkey") % 9, F.lit("percent")))
    line = table(spark, sf, "lineitem")
    stated = line.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("passage"), F.explode(F.array(F.struct(F.col("l_quantity").cast("long").alias("value"), F.lit("Pieces").alias("unit")), F.struct(F.round(F.col("l_tax") * 100).cast("long").alias("value"), F.lit("%").alias("unit")))).alias("x"))
    return asked, stated.select("o_orderkey", "passage", "x.value", "x.unit")


def operand_choices(spark: SparkSession, sf: str) -> DataFrame:
    return operands.operand_choices(*_operands(spark, sf), "o_orderkey")


def requirement_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return operands.requirement_verdicts(operand_choices(spark, sf), "o_orderkey")


def slot_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Two slots of each order; records leave some out, hold another value, come twice or use a third slot, by the key's divisors."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("req"))
    full = o.select("o_orderkey", "req", (k % 5 + F.col("req")).cast("string").alias("value"), F.lit("boxes").alias("unit"), F.lit("q").alias("quote"))
    made = full.withColumn("kind", F.lit("value")).withColumn("value", F.when((k % 7 == 0) & (F.col("req") == 1), "none").otherwise(F.col("value")))
    made = made.where(~((k % 3 == 0) & (F.col("req") == 0)) & ((F.col("req") < 2) | (k % 13 == 0)))
    records = made.union(made.where((k % 11 == 0) & (F.col("req") == 1)))
    return operands.slot_ledger(full.where("req < 2"), records, "o_orderkey").groupBy("issue", "filled", "n_slots").agg(F.count("*").alias("n"))


def box_words(spark: SparkSession, sf: str) -> DataFrame:
    """How many of a page's points each box holds: a page for each supplier, a point for each line, boxes made from parts."""
    page = F.col("l_suppkey") % 100
    points = table(spark, sf, "lineitem").select(page.alias("page"), (F.col("l_partkey") * 7 % 1000).cast("double").alias("x"), (F.col("l_orderkey") * 13 % 1400).cast("double").alias("y"))
    p = F.col("p_partkey")
    boxes = table(spark, sf, "part").select((p % 100).alias("page"), "p_partkey", (p * 37 % 900).cast("double").alias("x0"), (p * 53 % 1300).cast("double").alias("y0"), "p_size")
    boxes = boxes.select("page", "p_partkey", "x0", "y0", (F.col("x0") + F.col("p_size") * 4).alias("x1"), (F.col("y0") + F.col("p_size")).alias("y1"))
    return cells.count_in_boxes(points, boxes, "page", "p_partkey")


def _word(page: str, at: Column, x0: Column, x1: Column, y: Column, word: Column) -> list[Column]:
    return [F.col(page), at.cast("int").alias("at"), x0.cast("double").alias("x0"), y.cast("double").alias("y0"), x1.cast("double").alias("x1"), (y + 6).cast("double").alias("y1"), word.cast("string").alias("word")]


def _block(page: str, block: Column, kind: str, x0: int, x1: int, y: Column, text: Column) -> list[Column]:
    return [F.col(page), block.cast("int").alias("block"), F.lit(kind).alias("kind"), F.lit(float(x0)).alias("x0"), y.cast("double").alias("y0"), F.lit(float(x1)).alias("x1"), (y + 6).cast("double").alias("y1"), text.alias("text")]


def count_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A table on each order's page, with a row for each line number: pieces under Train, supplier under Test.

    Four labels serve all lines, so that some are ambiguous; every seventh supplier's pieces stand beside their column.
    """
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("long").alias("q"), F.min("l_suppkey").alias("s"))
    rows = materialize(rows.withColumn("label", F.concat(F.lit("line"), F.col("l_linenumber") % 4)).withColumn("y", 30 + 8 * F.col("l_linenumber")), "rows")
    page, at = "l_orderkey", F.col("l_linenumber") * 10
    # Words and blocks are made where the page is, in parts that hold about as many lines; the page's own come with its first line.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_LINES)
    rows = rows.repartition(parts, page).withColumn("first", F.row_number().over(Window.partitionBy(page).orderBy("l_linenumber")) == 1)
    beside = F.when(F.col("s") % 7 == 0, 9).otherwise(0)
    made = lambda own, each: rows.select(page, F.inline(F.when(F.col("first"), F.array(*own, *each)).otherwise(F.array(*each))))
    head = [F.struct(*_word(page, F.lit(k), F.lit(x0), F.lit(x1), F.lit(20), F.lit(word))[1:]) for k, (x0, x1, word) in enumerate(((10, 60, "Statistic"), (100, 130, "Train"), (200, 220, "Test")))]
    line = [F.struct(*_word(page, at + k, x0, x1, F.col("y"), word)[1:]) for k, (x0, x1, word) in enumerate(((F.lit(10), F.lit(40), F.col("label")), (105 + beside, 125 + beside, F.col("q")), (F.lit(200), F.lit(220), F.col("s"))))]
    top = [F.struct(*_block(page, F.lit(0), "caption", 0, 300, F.lit(0), F.lit("Table 1: counts"))[1:]), F.struct(*_block(page, F.lit(1), "text", 0, 300, F.lit(20), F.lit("Statistic Train Test"))[1:])]
    body = [F.struct(*_block(page, at, "text", 0, 300, F.col("y"), F.concat_ws(" ", "label", F.col("q").cast("string"), F.col("s").cast("string")))[1:])]
    words, blocks = made(head, line), made(top, body)
    return cells.count_cells(words, blocks, page).select(page, "table_id", "row_label", "column_header", "cell_text")


def percentage_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A table of eight parts on a page: names under Type, sizes as percentages; every fifth part's stand beside the column."""
    parts = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 8).alias("page"), "p_partkey", "p_name", "p_size", (30 + 10 * (F.col("p_partkey") % 8)).alias("y"))
    pages, page = parts.select("page").distinct(), "page"
    words = None
    for k, (x0, x1, word) in enumerate(((10, 40, "Type"), (100, 106, "%"), (150, 180, "Count"))):
        part = pages.select(*_word(page, F.lit(k), F.lit(x0), F.lit(x1), F.lit(20), F.lit(word)))
        words = part if words is None else words.union(part)
    named = parts.select("*", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    words = words.union(named.select(*_word(page, 10 + F.col("i"), 10 + 35 * F.col("i"), 40 + 35 * F.col("i"), F.col("y"), F.col("w"))))
    left = 100 + F.when(F.col("p_partkey") % 5 == 0, 5).otherwise(0)
    words = words.union(parts.select(*_word(page, F.lit(50), left, left + 20, F.col("y"), F.concat(F.col("p_size"), F.lit("%")))))
    blocks = pages.select(*_block(page, F.lit(0), "caption", 0, 300, F.lit(0), F.lit("Table 2. Shares"))).union(pages.select(*_block(page, F.lit(1), "text", 0, 300, F.lit(20), F.lit("Type\n%\nCount"))))
    blocks = blocks.union(parts.select(*_block(page, F.col("p_partkey") % 8 + 2, "text", 0, 300, F.col("y"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_size"), F.lit("% "), F.col("p_partkey")))))
    return cells.percentage_cells(words, blocks, page).select(page, "table_id", "row_label", "cell_text")


def evidence_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A tree for each region: all nations (every fifth turned round), of which any customer, all of whose orders are over 150000.

    An order of a key that ten divides isn't observed. Orders themselves are left out of the result.
    """
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("tree"), "n_nationkey")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("tree", "n_nationkey", "c_custkey")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("tree", "c_custkey", "o_orderkey", "o_totalprice")
    name = lambda mark, col: F.concat(F.lit(mark), F.col(col))
    node = lambda df, this, above, op, turned=F.lit(False): df.select("tree", this.alias("node"), above.cast("string").alias("parent"), F.lit(op).alias("op"), turned.alias("negated"))
    nodes = node(table(spark, sf, "region").select(F.col("r_regionkey").alias("tree")), F.lit("r"), F.lit(None), "and")
    nodes = nodes.union(node(n, name("n", "n_nationkey"), F.lit("r"), "or", F.col("n_nationkey") % 5 == 0)).union(node(c, name("c", "c_custkey"), name("n", "n_nationkey"), "and")).union(node(o, name("o", "o_orderkey"), name("c", "c_custkey"), "leaf"))
    seen = o.where("o_orderkey % 10 <> 0").select("tree", name("o", "o_orderkey").alias("node"), (F.col("o_totalprice") > 150000).alias("truth"))
    return ledger.evaluate_trees(nodes, seen).where("depth < 3").select("tree", "node", F.col("depth").cast("long").alias("depth"), "truth", "known", "leaves")


def claim_labels(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as parts of a claim: returned ones refute, others entail, unless the tax leaves them open; every ninth order's are alternatives."""
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_tax").alias("t"), F.min("l_suppkey").alias("s"))
    relation = F.when(F.col("t") > 0.07, "unresolved").when(F.col("f") == "R", "refutes").otherwise("entails")
    parts = line.select("l_orderkey", F.col("l_linenumber").alias("part"), relation.alias("relation"), F.array(F.concat(F.lit("S"), F.col("s") % 6)).alias("evidence_ids"), (F.col("l_orderkey") % 9 == 0).alias("disjunction"))
    found = ledger.claim_labels(parts, "l_orderkey")
    return found.groupBy("label", "reason", F.size("evidence_ids").cast("long").alias("n_ids")).agg(F.count("*").alias("n"), F.sum("n_parts").alias("parts"))


def closed_population(spark: SparkSession, sf: str) -> DataFrame:
    """A nation's customers as a population, stated by a roster (odd nations) or a count; orders over 100000 observe a customer.

    The roster of every third nation lacks a customer whose orders are known.
    """
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name")
    seen = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("case_id"), F.col("c_name").alias("member"), (F.col("o_totalprice") > 100000).alias("truth"))
    odd = F.col("c_nationkey") % 2 == 1
    lost = (F.col("c_nationkey") % 3 == 0) & (F.col("c_custkey") % 11 == 0)
    stated = c.groupBy(F.col("c_nationkey").alias("case_id")).agg(F.count("*").alias("n_members"), F.collect_list(F.when(odd & ~lost, F.col("c_name"))).alias("names"))
    q = F.element_at(F.array(F.lit("all"), F.lit("some"), F.lit("none")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    cases = table(spark, sf, "nation").select(F.col("n_nationkey").alias("case_id"), q.alias("quantifier"))
    return populations.closed_truth(cases, stated.where("case_id % 7 <> 6"), seen)


def stated_population(spark: SparkSession, sf: str) -> DataFrame:
    """The population that three sentences on each order state, if they state one."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("The audit covered exactly "), k % 20, F.lit(" certified stores. Results were filed later."), F.when(k % 4 == 0, " It named exactly 3 certified stores.").when(k % 5 == 0, " All stores opened in May.").otherwise(""))
    o = table(spark, sf, "orders").select(k.alias("case_id"), text.alias("text"))
    parts = o.select("case_id", F.lit("certified stores").alias("entity"), F.lit("in June").alias("time"), F.lit("").alias("condition"))
    parts = parts.withColumn("time", F.when(F.col("case_id") % 5 == 0, F.col("time")).otherwise(""))
    return populations.stated_populations(parts, o).select("case_id", "n_members", "anchor", F.length("text").cast("long").alias("n_chars"))


def scope_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of a claim on each order with their restrictions; the third form mixes two times in a part."""
    k = F.col("o_orderkey")
    tail = F.when(k % 3 == 0, "costs fell on the store dataset").when(k % 3 == 1, "costs fell").otherwise("costs fell during winter")
    text = F.concat(F.lit("After May "), k % 28 + 1, F.lit(", sales rose and "), tail)
    parts = table(spark, sf, "orders").select("o_orderkey", F.explode(C.scope_clauses(text)).alias("p"))
    return parts.select("o_orderkey", F.col("p.start").cast("long").alias("start"), F.col("p.end").cast("long").alias("end"), F.array_join("p.time", "|").alias("time"), F.array_join("p.condition", "|").alias("condition"), "p.source")


def table_context(spark: SparkSession, sf: str) -> DataFrame:
    """How many blocks of an order's page belong to the table that a question names: lines lie about, a caption is in the middle.

    Every fifth question names two tables, every seventh page has two captions, every third a header below its caption.
    """
    k = F.col("case_id")
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("chunk"), (F.col("l_partkey") % 200).alias("x0"), (F.col("l_suppkey") * 7 % 700).alias("y0"), F.lit(60).alias("w"), F.lit("a line").alias("text"))
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    block = lambda df, name, x, y, text: df.select("case_id", F.lit(name).alias("chunk"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(100).alias("w"), F.lit(text).alias("text"))
    chunks = line.unionByName(block(cases, "caption", 100, 400, "Table 2: lines")).unionByName(block(cases.where(k % 7 == 0), "second", 100, 600, "Table 2: more")).unionByName(block(cases.where(k % 3 == 0), "header", 100, 420, "Statistic value"))
    chunks = chunks.select("case_id", F.lit(1).alias("page"), "chunk", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + 10).alias("y1"), "text")
    questions = cases.select("case_id", F.when(k % 5 == 0, "Do Table 2 and Table 3 agree?").otherwise("What does table 2 say?").alias("question"))
    found = context.referenced_table_context(questions, cases.select("case_id", F.lit(1).alias("page")), chunks)
    return found.groupBy("case_id").agg(F.count("*").alias("n"))


def explicit_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Claims on each order in one of two forms that sources decide, or in none; every fourth differs from its source."""
    k = F.col("case_id")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    n, m, off = (1000 + k % 50).cast("string"), (k % 90).cast("string"), k % 4 == 0
    text = F.when(k % 3 == 0, F.concat(F.lit("The Alpha corpus contains "), n, F.lit(" documents."))).when(k % 3 == 1, F.concat(F.lit("The lexicon covered "), m, F.lit(".5% of all words in the "), F.when(off, "Blue").otherwise("Red"), F.lit(" dataset."))).otherwise("Orders were counted.")
    source = F.when(k % 3 == 0, F.concat(F.lit("One corpus (named 'Alpha') contained "), (1000 + k % 50 + off.cast("int")).cast("string"), F.lit(" documents."))).otherwise(F.concat(F.lit("The lexicon covers "), m, F.lit(".50% and 3% of all words in Red and Blue, respectively.")))
    claims = o.select("case_id", k.alias("claim_id"), text.alias("text"))
    segments = o.select("case_id", F.lit(0).alias("n"), F.lit("Some words come first.").alias("text")).union(o.select("case_id", F.lit(1), source))
    windows = o.select(k.alias("claim_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), F.lit(True).alias("selected"))
    return rules.explicit_verdicts(claims, windows, segments).select("claim_id", "label", "rule", F.array_join(F.transform("citations", lambda c: c.cast("string")), ",").alias("citations"))


def source_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The original words on each order that a quote with plain blanks and letters copies; every sixth quote has another number."""
    k = F.col("o_orderkey")
    number = (k % 1000).cast("string")
    text = F.concat(F.lit("Row  "), k.cast("string"), F.lit("\n\nhas  a ﬁne\tvalue "), number, F.lit(" \n."))
    quote = F.concat(F.lit(" has a fine value "), F.when(k % 6 == 0, F.concat(number, F.lit("7"))).otherwise(number))
    s = table(spark, sf, "orders").select("o_orderkey", spans.source_slice(quote, text).alias("s")).where("s is not null")
    return s.select("o_orderkey", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.slice")


def claim_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The issues of an answer of two claims on each order, by its key's remainder."""
    forms = ("Is it true?", "12.5 %", "Large orders of Alpha.", "Were 5 items.", "Alpha improved.", "Alpha failed.", "Alpha improved recall.")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Order "), k.cast("string"), F.lit(" has lines. "), F.element_at(F.array(*[F.lit(x) for x in forms]), (k % 7 + 1).cast("int")))
    return contract.answer_issues(table(spark, sf, "orders").select("o_orderkey", F.when(k % 11 > 0, text).alias("text")), "o_orderkey")


def resolved_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A claim on each order and its sources: the right one, one without its values, one twice, or an unknown one."""
    k = F.col("case_id")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    said = F.concat(F.lit("Order "), k.cast("string"), F.lit(" has "), (k % 50).cast("string"), F.lit(" pieces"))
    ids = F.when(k % 4 == 0, F.array(F.lit("s1"))).when(k % 4 == 1, F.array(F.lit("s0"), F.lit("s0"))).when(k % 4 == 2, F.array(F.lit("s9"))).otherwise(F.array(F.lit("s0")))
    claims = o.select("case_id", F.lit(0).alias("at"), F.concat(said, F.lit(".")).alias("text"), ids.alias("source_ids"))
    units = o.select("case_id", F.lit("s0").alias("source_id"), F.concat(said, F.lit(" in all.")).alias("text")).union(o.select("case_id", F.lit("s1"), F.lit("Nothing else.")))
    return contract.resolve_sources(claims, units).select("case_id", "issue", F.array_join("candidates", ",").alias("candidates"))


def member_quantifiers(spark: SparkSession, sf: str) -> DataFrame:
    """From a text on each order to a quantifier: its stated population, what its clauses say of each member, and the truth of all."""
    k = F.col("case_id")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    beta = F.when(k % 4 == 0, "leaked").when(k % 4 == 1, "never leaked").otherwise("was closed")
    contexts = o.select("case_id", F.concat(F.lit("The stores were Alpha and Beta. Alpha leaked; Beta "), beta, F.lit(".")).alias("text"))
    parts = o.select("case_id", F.lit("stores").alias("entity"), F.lit("").alias("time"), F.lit("").alias("condition"), F.lit("leaked").alias("metric"), F.lit("stores leaked").alias("quote"))
    stated = shuffled(materialize(populations.stated_populations(parts, contexts), "stated"))
    seen = assessment.member_truths(parts, stated)
    cases = o.select("case_id", F.element_at(F.array(F.lit("all"), F.lit("some"), F.lit("none")), (k % 3 + 1).cast("int")).alias("quantifier"))
    return populations.closed_truth(cases, stated, seen).select("case_id", "quantifier", "closed", "truth", "issue")


LIMITS = budgets.Limits(seconds=1_000_000, steps=20, cost=4000.0, searches=5)


def session_stops(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as a session: views are searches, values are costs; where it stops and why."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cost"), (F.col("event_type") == "view").alias("search"), F.col("props").alias("request"))
    return budgets.session_stops(e, LIMITS).select("session", "steps", "spent", "searches", "reason", F.unix_micros("at").alias("at"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_gaps, claim_cover, quantity_offsets, operand_choices, requirement_verdicts, slot_ledger, box_words, count_cells, percentage_cells, evidence_tree, claim_labels, closed_population, stated_population, scope_clauses, table_context, session_stops, explicit_numbers, source_slices, claim_issues, resolved_sources, member_quantifiers,
    )
}
_TOKEN = r"[+−-]?[0-9]+(?:[.,/][0-9]+)*|\p{L}+(?:[-‐‑]\p{L}+)*|[^\s\p{L}\p{N}_]"
_STOP = "'a', 'an', 'the', 'of', 'in', 'on', 'at', 'by', 'as', 'is', 'are', 'was', 'were', 'be', 'been', 'to', 'for', 'and', 'or', 'that', 'this', 'here'"
_CHOICES = """op AS (SELECT l_orderkey AS k, 'pieces' AS unit, l_quantity::BIGINT AS v, l_linenumber AS p FROM lineitem UNION ALL SELECT l_orderkey, '%', round(l_tax * 100)::BIGINT, l_linenumber FROM lineitem),
seen AS (SELECT k, unit, v, count(DISTINCT p) AS n_passages, min(p) AS first_passage FROM op GROUP BY ALL),
asked AS (SELECT o_orderkey AS k, 0 AS req, 30::BIGINT AS r, 'pieces' AS unit FROM orders UNION ALL SELECT o_orderkey, 1, o_orderkey % 9, '%' FROM orders),
choices AS (SELECT a.k AS o_orderkey, req, r AS r_value, a.unit, v AS o_value, CASE WHEN req = 0 THEN v >= r ELSE v = r END AS truth, n_passages, first_passage, CASE WHEN v IS NULL THEN 'no_decisive_operand' END AS issue
FROM asked a LEFT JOIN seen s ON s.k = a.k AND s.unit = a.unit)"""
SQL = {
    "interval_gaps": f"""WITH s AS (SELECT l_orderkey AS k, date_diff('day', DATE '{FIRST_DAY}', l_shipdate::DATE) % 400 AS a, date_diff('day', DATE '{FIRST_DAY}', l_shipdate::DATE) % 400 + l_quantity::INT AS b FROM lineitem),
m AS (SELECT k, a, coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM s),
g AS (SELECT k, a - reach AS d FROM m WHERE a > reach UNION ALL SELECT k, 450 - max(b) FROM s GROUP BY k HAVING max(b) < 450)
SELECT k AS l_orderkey, count(*) AS n_gaps, sum(d)::BIGINT AS days FROM g GROUP BY k""",
    "claim_cover": rf"""WITH p AS (SELECT item_id, text, regexp_extract_all(text, '([\s_]*)({_TOKEN})', 1) AS g, regexp_extract_all(text, '([\s_]*)({_TOKEN})', 2) AS t FROM benchmark),
u AS (SELECT item_id, text, unnest(range(0, len(t))) AS i, unnest(g) AS gap, unnest(t) AS token FROM p),
o AS (SELECT *, sum(length(gap) + length(token)) OVER (PARTITION BY item_id ORDER BY i) AS e FROM u),
q AS (SELECT item_id, i // 8 AS k, min(e - length(token)) AS s, max(e) AS e, any_value(text) AS text FROM o WHERE i % 8 < 6 GROUP BY 1, 2),
b AS (SELECT item_id, k FROM (SELECT *, substr(text, s::BIGINT + 1, (e - s)::BIGINT) AS quote FROM q) WHERE strpos(substr(text, strpos(text, quote) + 1), quote) = 0),
x AS (SELECT o.item_id, o.e - length(token) AS s, NOT (b.k IS NOT NULL AND i % 8 < 6) AND lower(token) NOT IN ({_STOP}) AND (regexp_matches(token, '[\p{{L}}\p{{N}}]') OR token IN ('%', '≥', '≤')) AS bare
FROM o LEFT JOIN b ON b.item_id = o.item_id AND b.k = i // 8),
c AS (SELECT item_id, count(*) AS n, count(*) FILTER (bare) AS u, min(s) FILTER (bare) AS f FROM x GROUP BY 1)
SELECT item_id, coalesce(n, 0) AS n_tokens, coalesce((SELECT count(*) FROM b WHERE b.item_id = k.item_id), 0) AS n_bound, coalesce(u, 0) AS n_uncovered, f::BIGINT AS first_uncovered, CASE WHEN u > 0 THEN 'uncovered_claim_content' END AS issue
FROM benchmark k LEFT JOIN c USING (item_id)""",
    "quantity_offsets": f"""WITH o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, (1000 + o_orderkey % 9000)::VARCHAR AS n, (o_orderkey % 100)::VARCHAR AS p, ([{', '.join(repr(w) for w in CARDINALS)}])[o_orderkey % 21 + 1] AS w, o_orderkey % 21 AS v FROM orders),
s AS (SELECT *, 6 AS a, 11 + length(k) AS b, 21 + length(k) + length(n) AS c, 31 + length(k) + length(n) + length(p) AS d FROM o)
SELECT o_orderkey, a AS start, (a + length(k) + 4)::INT AS "end", k || ' had' AS quote, k AS value, 'had' AS unit, 'number' AS kind FROM s
UNION ALL SELECT o_orderkey, b, (b + length(n) + 8)::INT, n || ' parcels', n, 'parcels', 'number' FROM s
UNION ALL SELECT o_orderkey, c, (c + length(p) + 1)::INT, p || '%', p, '%', 'percent' FROM s
UNION ALL SELECT o_orderkey, d, (d + length(w) + 6)::INT, w || ' boxes', v::VARCHAR, 'boxes', 'number' FROM s""",
    "operand_choices": f"WITH {_CHOICES} SELECT * FROM choices",
    "requirement_verdicts": f"""WITH {_CHOICES}, r AS (SELECT o_orderkey, req, CASE WHEN bool_and(truth) = bool_or(truth) THEN bool_and(truth) END AS t FROM choices GROUP BY ALL)
SELECT o_orderkey, CASE WHEN count(*) = count(t) THEN bool_and(t) END AS truth, count(*) AS n_req, count(*) - count(t) AS n_open FROM r GROUP BY 1""",
    "slot_ledger": """SELECT CASE WHEN k % 13 = 0 OR k % 11 = 0 THEN 'numeric_requirement_ledger_schema' WHEN k % 7 = 0 THEN 'numeric_requirement_slot_binding' END AS issue,
(CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END)::BIGINT AS filled, 2::BIGINT AS n_slots, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY ALL""",
    "box_words": """SELECT p_partkey, count(*) AS n FROM (SELECT p_partkey % 100 AS page, p_partkey, p_partkey * 37 % 900 AS x0, p_partkey * 53 % 1300 AS y0, p_size FROM part)
JOIN (SELECT l_suppkey % 100 AS q, l_partkey * 7 % 1000 AS x, l_orderkey * 13 % 1400 AS y FROM lineitem) ON page = q AND x >= x0 AND x < x0 + p_size * 4 AND y >= y0 AND y < y0 + p_size GROUP BY 1""",
    "count_cells": """WITH r AS (SELECT l_orderkey, 'line' || (l_linenumber % 4) AS label, min(l_quantity)::BIGINT AS q, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING min(l_suppkey) % 7 <> 0),
u AS (SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY l_orderkey, label) = 1)
SELECT l_orderkey, '1' AS table_id, label AS row_label, 'Train' AS column_header, q::VARCHAR AS cell_text FROM u UNION ALL SELECT l_orderkey, '1', label, 'Test', s::VARCHAR FROM u""",
    "percentage_cells": """SELECT p_partkey // 8 AS page, '2' AS table_id, p_name AS row_label, p_size || '%' AS cell_text FROM part WHERE p_partkey % 5 <> 0 QUALIFY count(*) OVER (PARTITION BY p_partkey // 8, lower(p_name)) = 1""",
    "evidence_tree": """WITH c AS (SELECT n_regionkey AS tree, n_nationkey, c_custkey, count(o_orderkey) AS orders, count(*) FILTER (o_orderkey % 10 <> 0) AS seen,
bool_or(o_orderkey % 10 <> 0 AND o_totalprice <= 150000) AS low FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
cs AS (SELECT tree, n_nationkey, 'c' || c_custkey AS node, CASE WHEN orders = 0 THEN NULL WHEN low THEN false WHEN seen = orders THEN true END AS truth, seen AS known, greatest(orders, 1) AS leaves FROM c),
ns AS (SELECT n_regionkey AS tree, n.n_nationkey AS k, CASE WHEN bool_or(truth) THEN true WHEN count(*) = count(truth) AND count(node) > 0 THEN false END AS t, coalesce(sum(known), 0)::BIGINT AS known, coalesce(sum(leaves), 1)::BIGINT AS leaves
FROM nation n LEFT JOIN cs ON cs.n_nationkey = n.n_nationkey GROUP BY ALL),
nt AS (SELECT tree, 'n' || k AS node, CASE WHEN k % 5 = 0 THEN NOT t ELSE t END AS truth, known, leaves FROM ns)
SELECT tree, node, 2::BIGINT AS depth, truth, known, leaves FROM cs UNION ALL SELECT tree, node, 1, truth, known, leaves FROM nt
UNION ALL SELECT r_regionkey, 'r', 0, CASE WHEN bool_or(NOT truth) THEN false WHEN count(*) = count(truth) AND count(node) > 0 THEN true END, coalesce(sum(known), 0)::BIGINT, coalesce(sum(leaves), 1)::BIGINT FROM region LEFT JOIN nt ON tree = r_regionkey GROUP BY r_regionkey""",
    "claim_labels": """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS part, CASE WHEN min(l_tax) > 0.07 THEN 'u' WHEN min(l_returnflag) = 'R' THEN 'r' ELSE 'e' END AS rel, min(l_suppkey) % 6 AS s FROM lineitem GROUP BY ALL),
c AS (SELECT k, count(*) AS parts, count(*) FILTER (rel = 'r') AS r, count(*) FILTER (rel = 'e') AS e, count(DISTINCT s) AS ids, k % 9 <> 0 OR count(*) = 1 AS alone FROM p GROUP BY k),
l AS (SELECT *, CASE WHEN r > 0 AND alone THEN 'contradict' WHEN e = parts AND alone THEN 'support' ELSE 'not_enough_info' END AS lab FROM c)
SELECT CASE WHEN lab = 'support' AND ids > 4 THEN 'not_enough_info' ELSE lab END AS label, CASE WHEN lab = 'support' AND ids > 4 THEN 'too_many_citations' END AS reason,
(CASE lab WHEN 'contradict' THEN 1 WHEN 'support' THEN CASE WHEN ids > 4 THEN 0 ELSE ids END ELSE 0 END)::BIGINT AS n_ids, count(*) AS n, sum(parts)::BIGINT AS parts FROM l GROUP BY 1, 2, 3""",
    "closed_population": """WITH m AS (SELECT c_nationkey AS n, c_custkey, CASE WHEN min(o_totalprice > 100000) = max(o_totalprice > 100000) THEN min(o_totalprice > 100000) END AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT n, count(*) AS members, count(t) AS seen, count(*) FILTER (t) AS yes, count(*) FILTER (NOT t) AS no, n % 2 = 1 AS by_roster,
count(*) FILTER (NOT (n % 3 = 0 AND c_custkey % 11 = 0) AND t IS NULL) AS unseen, count(*) FILTER (n % 3 = 0 AND c_custkey % 11 = 0 AND t IS NOT NULL) AS outside FROM m GROUP BY n),
s AS (SELECT n_nationkey AS case_id, ['all', 'some', 'none'][n_nationkey % 3 + 1] AS quantifier, CASE WHEN n_nationkey % 7 <> 6 THEN members END AS n_members, coalesce(seen, 0) AS n_observed, g.* FROM nation LEFT JOIN g ON n = n_nationkey),
d AS (SELECT *, n_members IS NOT NULL AND CASE WHEN by_roster THEN unseen = 0 AND outside = 0 ELSE seen = members END AS closed, n_members IS NOT NULL AND by_roster AND outside > 0 AS beyond FROM s),
e AS (SELECT *, CASE WHEN n_members IS NULL OR beyond THEN NULL WHEN quantifier = 'all' THEN CASE WHEN no > 0 THEN false WHEN closed THEN true END
WHEN quantifier = 'some' THEN CASE WHEN yes > 0 THEN true WHEN closed THEN false END ELSE CASE WHEN yes > 0 THEN false WHEN closed THEN true END END AS truth FROM d)
SELECT case_id, quantifier, n_members, n_observed, closed, truth, CASE WHEN n_members IS NULL THEN 'no_population' WHEN beyond THEN 'outside_member' WHEN truth IS NULL THEN 'population_closure_required' END AS issue FROM e""",
    "stated_population": """SELECT o_orderkey AS case_id, (o_orderkey % 20)::INT AS n_members, (o_orderkey % 20) || ' certified stores' AS anchor, (length('The audit covered exactly ' || (o_orderkey % 20) || ' certified stores.') + 26)::BIGINT AS n_chars
FROM orders WHERE o_orderkey % 20 BETWEEN 1 AND 16 AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0""",
    "member_quantifiers": """SELECT o_orderkey AS case_id, (['all', 'some', 'none'])[o_orderkey % 3 + 1] AS quantifier, o_orderkey % 4 < 2 AS closed,
CASE o_orderkey % 3 WHEN 0 THEN CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END WHEN 1 THEN true ELSE false END AS truth,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 > 1 THEN 'population_closure_required' END AS issue FROM orders""",
    "claim_issues": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS claim_index, CASE WHEN o_orderkey % 11 = 0 THEN 'empty_answer'
ELSE (['question_not_claim', 'bare_quantity', 'metric_or_relation_missing', 'entity_missing', 'predicate_incomplete'])[o_orderkey % 7 + 1] END AS code FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 < 5""",
    "resolved_sources": """SELECT o_orderkey AS case_id, CASE o_orderkey % 4 WHEN 0 THEN 'value_absent' WHEN 3 THEN NULL ELSE 'unknown_source' END AS issue, CASE o_orderkey % 4 WHEN 0 THEN 's0' ELSE '' END AS candidates FROM orders""",
    "source_slices": r"""WITH o AS (SELECT o_orderkey, length(o_orderkey::VARCHAR) AS n, 'has  a ﬁne' || chr(9) || 'value ' || (o_orderkey % 1000) AS slice FROM orders WHERE o_orderkey % 6 <> 0)
SELECT o_orderkey, (7 + n)::BIGINT AS start, (7 + n + length(slice))::BIGINT AS "end", slice FROM o""",
    "explicit_numbers": """SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 4 = 0 THEN 'contradict' ELSE 'support' END AS label,
CASE o_orderkey % 3 WHEN 0 THEN 'named corpus count' ELSE 'ordered percentage' END AS rule, '1' AS citations FROM orders WHERE o_orderkey % 3 < 2""",
    "table_context": """WITH l AS (SELECT l_orderkey AS k, l_partkey % 200 AS x, l_suppkey * 7 % 700 AS y FROM lineitem),
g AS (SELECT k, count(*) FILTER (y BETWEEN 210 AND 390) AS up, count(*) FILTER (y BETWEEN 410 AND 520) AS down FROM l WHERE x < 200 AND x + 60 > 100 GROUP BY k)
SELECT o_orderkey AS case_id, 1 + CASE WHEN o_orderkey % 3 = 0 THEN coalesce(down, 0) + 1 ELSE coalesce(up, 0) END AS n FROM orders LEFT JOIN g ON k = o_orderkey WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""",
    "session_stops": f"""WITH e AS (SELECT user_id::VARCHAR AS session, event_id, ts, value, event_type = 'view' AS search, min(ts) OVER (PARTITION BY user_id) + INTERVAL {LIMITS.seconds} SECOND AS deadline,
count(*) OVER w AS n, coalesce(sum(value) OVER w, 0) AS c, count(*) FILTER (event_type = 'view') OVER w AS s, row_number() OVER (PARTITION BY user_id, event_type = 'view', props ORDER BY ts, event_id) > 1 AS again
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN ts >= deadline THEN '{budgets.REASONS[0]}' WHEN n >= {LIMITS.steps} THEN '{budgets.REASONS[1]}' WHEN c + value > {LIMITS.cost} THEN '{budgets.REASONS[2]}'
WHEN search AND s >= {LIMITS.searches} THEN '{budgets.REASONS[3]}' WHEN search AND again THEN '{budgets.REASONS[4]}' END AS reason FROM e),
f AS (SELECT * FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts, event_id) = 1),
t AS (SELECT session, count(*) AS n, sum(value) AS c, count(*) FILTER (search) AS s FROM e GROUP BY 1)
SELECT t.session, coalesce(f.n, t.n) AS steps, round(coalesce(f.c, t.c), 6) AS spent, coalesce(f.s, t.s) AS searches, reason, epoch_us(CASE WHEN reason = '{budgets.REASONS[0]}' THEN deadline ELSE ts END) AS at FROM t LEFT JOIN f USING (session)""",
    "scope_clauses": """WITH o AS (SELECT o_orderkey, 'After May ' || (o_orderkey % 28 + 1) AS t, o_orderkey % 3 AS m FROM orders WHERE o_orderkey % 3 < 2)
SELECT o_orderkey, 0::BIGINT AS start, (length(t) + 13)::BIGINT AS "end", t AS time, '' AS condition, t || ', sales rose ' AS source FROM o
UNION ALL SELECT o_orderkey, length(t) + 13, length(t) + 13 + CASE m WHEN 0 THEN 35 ELSE 14 END, t, CASE m WHEN 0 THEN 'on the store dataset' ELSE '' END, t || ', and costs fell' || CASE m WHEN 0 THEN ' on the store dataset' ELSE '' END FROM o""",
}
