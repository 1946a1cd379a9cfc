"""Evidence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import evidence as E
from corpusloom.session import table

BUDGET, SECONDS = 1500, 300


def sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    return E.sentence_units(table(spark, sf, "documents")).select("doc_id", "pos", F.length("sentence").alias("size"), F.md5("sentence").alias("digest"))


def adjacent_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn's role with those before and after it."""
    return E.neighbours_in_order(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return E.pack(c, "conv_id", "turn", "size", BUDGET).select("conv_id", F.array_join("kept", ",").alias("kept"), "used")


def citation_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that event properties cite, against the parts there are."""
    cited = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("p_partkey"))
    broken = cited.join(table(spark, sf, "part").select("p_partkey"), "p_partkey", "left_anti")
    return cited.groupBy("event_type").agg(F.count("*").alias("cited")).join(broken.groupBy("event_type").agg(F.count("*").alias("broken")), "event_type", "left").select("event_type", "cited", F.coalesce("broken", F.lit(0)).alias("broken"))


def lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Line to order to customer to nation to region; rows that break off are not counted."""
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def band_join(spark: SparkSession, sf: str) -> DataFrame:
    """A user's pairs of events at most five minutes apart."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    other = e.select(F.col("event_id").alias("other"), "user_id", F.col("at").alias("then"))
    return E.band_join(e, other, "user_id", "at", "then", SECONDS).where("event_id < other").groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum(F.abs(F.col("at") - F.col("then"))).alias("seconds"))


def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's pairs of orders whose thirty days overlap: dates less than thirty days apart, as a band join."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.datediff(F.col("o_orderdate"), F.lit("1990-01-01")).alias("day"))
    other = o.select(F.col("o_orderkey").alias("other"), "o_custkey", F.col("day").alias("then"))
    return E.band_join(o, other, "o_custkey", "day", "then", 29).where("o_orderkey < other").groupBy("o_custkey").agg(F.count("*").alias("pairs"))


def point_in_box(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as points in half-open boxes of size: each nation holds [2k, 2k + 2)."""
    boxes = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("cell"), (F.col("n_nationkey") * 2).alias("lo"), (F.col("n_nationkey") * 2 + 2).alias("hi"))
    p = table(spark, sf, "part").select("p_size", "p_retailprice", F.floor(F.col("p_size") / 2).cast("int").alias("cell"))
    return p.join(boxes, "cell").where("p_size >= lo and p_size < hi").groupBy("n_name").agg(F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("price"))


def unique_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Values of cells (brand, type, size) that one part alone fills; ambiguous cells go."""
    w = Window.partitionBy("p_brand", "p_type", "p_size")
    return table(spark, sf, "part").withColumn("n", F.count("*").over(w)).where("n = 1").select("p_brand", "p_type", "p_size", "p_partkey", "p_retailprice")


def table_axis_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all (brand, type) axes with the size of their one largest part; ties give none."""
    g = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("top"), F.max_by("p_size", F.struct("p_retailprice", "p_partkey")).alias("size"), F.count("*").alias("parts"))
    ties = table(spark, sf, "part").join(g.select("p_brand", "p_type", "top"), ["p_brand", "p_type"]).where("p_retailprice = top").groupBy("p_brand", "p_type").agg(F.count("*").alias("at_top"))
    return g.join(ties.where("at_top = 1"), ["p_brand", "p_type"]).select("p_brand", "p_type", "size", "parts")


def span_containment(spark: SparkSession, sf: str) -> DataFrame:
    return E.span_containment(table(spark, sf, "benchmark"), table(spark, sf, "documents").select("doc_id", "text"), "item_id", "doc_id")


def member_spans(spark: SparkSession, sf: str) -> DataFrame:
    """How many distinct spans of one to eight words each item has."""
    from corpusloom.functions.text import squeeze

    w = table(spark, sf, "benchmark").select("item_id", F.split(squeeze(F.lower(F.col("text"))), " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    return w.select("item_id", F.size("w").alias("words"), F.size(F.array_distinct(spans)).alias("spans"))


QUERIES = {f.__name__: f for f in (sentence_units, adjacent_pair, context_pack, citation_integrity, lineage, band_join, interval_overlap, point_in_box, unique_cell, table_axis_lookup, span_containment, member_spans)}
_SQ = "trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
SQL = {
    "sentence_units": r"""SELECT doc_id, i - 1 AS pos, length(s[i]) AS size, md5(s[i]) AS digest FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)) WHERE trim(s[i]) <> ''""",
    "adjacent_pair": "SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "context_pack": """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
p AS (SELECT conv_id, 0 AS k, ''::VARCHAR AS kept, 0::BIGINT AS used FROM (SELECT DISTINCT conv_id FROM c)
UNION ALL SELECT p.conv_id, c.k, CASE WHEN used + size <= 1500 THEN kept || CASE WHEN kept = '' THEN '' ELSE ',' END || turn ELSE kept END, CASE WHEN used + size <= 1500 THEN used + size ELSE used END FROM p JOIN c ON c.conv_id = p.conv_id AND c.k = p.k + 1)
SELECT conv_id, arg_max(kept, k) AS kept, arg_max(used, k) AS used FROM p GROUP BY conv_id""",
    "citation_integrity": "SELECT event_type, count(*) AS cited, count(*) FILTER (p_partkey IS NULL) AS broken FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) LEFT JOIN (SELECT p_partkey FROM part) ON k = p_partkey GROUP BY event_type",
    "lineage": """SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "band_join": """WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS at FROM events)
SELECT a.user_id, count(*) AS pairs, sum(abs(a.at - b.at))::BIGINT AS seconds FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.at - b.at) <= 300 GROUP BY a.user_id""",
    "interval_overlap": """SELECT a.o_custkey, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
AND a.o_orderdate::DATE < b.o_orderdate::DATE + 30 AND b.o_orderdate::DATE < a.o_orderdate::DATE + 30 GROUP BY a.o_custkey""",
    "point_in_box": "SELECT n_name, count(*) AS parts, round(avg(p_retailprice), 4) AS price FROM part JOIN nation ON p_size >= n_nationkey * 2 AND p_size < n_nationkey * 2 + 2 GROUP BY n_name",
    "unique_cell": "SELECT p_brand, p_type, p_size, p_partkey, p_retailprice FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_type, p_size) = 1",
    "table_axis_lookup": """SELECT p_brand, p_type, any_value(p_size) AS size, any_value(parts) AS parts FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type) AS parts, rank() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC) AS r FROM part)
WHERE r = 1 GROUP BY p_brand, p_type HAVING count(*) = 1""",
    "span_containment": f"SELECT item_id, doc_id FROM (SELECT item_id, {_SQ} AS span FROM benchmark) JOIN (SELECT doc_id, {_SQ} AS doc FROM documents) ON contains(doc, span)",
    "member_spans": f"""SELECT item_id, len(w) AS words, len(list_distinct(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(1, least(8, len(w) - i + 1) + 1), lambda n: array_to_string(w[i:i + n - 1], ' ')))))) AS spans
FROM (SELECT item_id, string_split({_SQ}, ' ') AS w FROM benchmark)""",
}
