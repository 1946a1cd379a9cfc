"""Verification queries on the numeric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import verification as V
from corpusloom.session import table


def bound_compare(spark: SparkSession, sf: str) -> DataFrame:
    """A line's [discount, discount + tax] against the asked [0.02, 0.10], in hundredths."""
    lo, hi = F.round(F.col("l_discount") * 100).cast("int"), F.round((F.col("l_discount") + F.col("l_tax")) * 100).cast("int")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", V.compare_bounds(F.lit(2), F.lit(10), lo, hi).alias("truth")).agg(F.count("*").alias("n"))


def unit_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes written with a suffix by their remainder, and read again; others aren't numbers."""
    mark = F.element_at(F.array(F.lit("k"), F.lit("M"), F.lit("%"), F.lit(""), F.lit(" items")), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = table(spark, sf, "part").select("p_brand", V.scaled_number(F.concat(F.col("p_size").cast("string"), mark)).alias("x"))
    return p.groupBy("p_brand", "x.unit").agg(F.count("x.value").alias("numbers"), F.count_if(F.col("x.value").isNull()).alias("rejected"), F.sum("x.value").alias("total"))


def value_direction(spark: SparkSession, sf: str) -> DataFrame:
    """How a user's values go from event to event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("way", V.direction(F.col("value"), F.lag("value").over(w)))
    return e.groupBy("user_id", "way").agg(F.count("*").alias("n"))


def unique_leader(spark: SparkSession, sf: str) -> DataFrame:
    return V.unique_leader(table(spark, sf, "part"), ["p_brand"], "p_size", "p_partkey")


def group_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Whether open orders of a priority are worth more than twice as much as pending ones."""
    o = table(spark, sf, "orders")
    g = o.groupBy("o_orderpriority").agg(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("a"), F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("b"))
    return g.select("o_orderpriority", F.round(F.try_divide("a", "b"), 6).alias("ratio"), (F.col("a") > F.col("b") * 2).alias("over_twice"))


def quantity_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that a document states and no benchmark item does."""
    numbers = lambda n, i: table(spark, sf, n).select(i, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0)))).alias("number"))
    return numbers("documents", "doc_id").join(numbers("benchmark", "item_id").select("number").distinct(), "number", "left_anti").groupBy("doc_id").agg(F.count("*").alias("missing"), F.min("number").alias("first"))


def metric_column(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of a supplier's lines that hold one status throughout, all or nothing."""
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus")).alias("status"), F.bool_and(F.col("l_tax") >= 0.01).alias("taxed"), F.count("*").alias("n")
    )


def population_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a nation as a closed population; a finding is an order of theirs over 200000."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice") > 200000).alias("truth"))
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    return V.population_truth(o.join(c, "c_custkey"), c, "c_nationkey", "c_custkey", "truth")


def before_after(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's first and last order, and whether the price rose."""
    at = F.struct("o_orderdate", "o_orderkey")
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", at).alias("was"), F.max_by("o_totalprice", at).alias("now"), F.count("*").alias("n"))
    return g.where("n > 1").select("o_custkey", "was", "now", V.direction(F.col("now"), F.col("was")).alias("way"))


def rule_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule, in order of priority, that decides on a line."""
    rule = F.coalesce(
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30), F.lit("1:contradict")), F.when(F.col("l_discount") == 0, F.lit("2:support")),
        F.when(F.col("l_linestatus") == "F", F.lit("3:support")), F.lit("9:not_enough_info"),
    )
    return table(spark, sf, "lineitem").groupBy(rule.alias("rule")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


QUERIES = {f.__name__: f for f in (bound_compare, unit_scale, value_direction, unique_leader, group_ratio, quantity_diff, metric_column, population_truth, before_after, rule_dispatch)}
SQL = {
    "bound_compare": "SELECT l_returnflag, CASE WHEN lo >= 2 AND hi <= 10 THEN true WHEN hi < 2 OR lo > 10 THEN false END AS truth, count(*) AS n FROM (SELECT l_returnflag, round(l_discount * 100)::INT AS lo, round((l_discount + l_tax) * 100)::INT AS hi FROM lineitem) GROUP BY ALL",
    "unit_scale": """SELECT p_brand, CASE WHEN m = 2 THEN 'percent' ELSE 'number' END AS unit, count(*) FILTER (m < 4) AS numbers, count(*) FILTER (m = 4) AS rejected,
sum(CASE m WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1000000.0 WHEN 2 THEN p_size WHEN 3 THEN p_size END)::DOUBLE AS total FROM (SELECT *, p_partkey % 5 AS m FROM part) GROUP BY ALL""",
    "value_direction": """SELECT user_id, CASE WHEN p IS NULL OR value IS NULL THEN NULL WHEN value > p THEN 'increase' WHEN value < p THEN 'decrease' ELSE 'unchanged' END AS way, count(*) AS n
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY ALL""",
    "unique_leader": "SELECT p_brand, min(p_partkey) AS p_partkey, max(p_size) AS p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r = 1 GROUP BY p_brand HAVING count(*) = 1",
    "group_ratio": "SELECT o_orderpriority, round(a / b, 6) AS ratio, a > b * 2 AS over_twice FROM (SELECT o_orderpriority, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS a, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS b FROM orders GROUP BY 1)",
    "quantity_diff": r"""SELECT doc_id, count(*) AS missing, min(number) AS first FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'))) AS number FROM documents)
WHERE number NOT IN (SELECT unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) FROM benchmark) GROUP BY doc_id""",
    "metric_column": "SELECT l_suppkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS status, bool_and(l_tax >= 0.01) AS taxed, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    "population_truth": """WITH f AS (SELECT o_custkey, CASE WHEN min(o_totalprice > 200000) = max(o_totalprice > 200000) THEN min(o_totalprice > 200000) END AS t FROM orders GROUP BY 1),
g AS (SELECT c_nationkey, count(*) AS members, count(t) AS known, count(*) FILTER (t) AS yes, count(*) FILTER (NOT t) AS no FROM customer LEFT JOIN f ON c_custkey = o_custkey GROUP BY 1)
SELECT c_nationkey, members, known, CASE WHEN no > 0 THEN false WHEN known = members THEN true END AS all_true, CASE WHEN yes > 0 THEN true WHEN known = members THEN false END AS some_true, CASE WHEN yes > 0 THEN false WHEN known = members THEN true END AS none_true FROM g""",
    "before_after": """SELECT o_custkey, was, now, CASE WHEN now > was THEN 'increase' WHEN now < was THEN 'decrease' ELSE 'unchanged' END AS way FROM (
SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS was, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS now, count(*) AS n FROM orders GROUP BY 1) WHERE n > 1""",
    "rule_dispatch": """SELECT CASE WHEN l_returnflag = 'R' AND l_quantity > 30 THEN '1:contradict' WHEN l_discount = 0 THEN '2:support' WHEN l_linestatus = 'F' THEN '3:support' ELSE '9:not_enough_info' END AS rule,
count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""",
}
