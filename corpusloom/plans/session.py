"""Session queries on events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import session as S
from corpusloom.session import table

MAX_STEPS, MAX_COST = 40, 2500.0


def plan_ready(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as tasks by date, each needing the one before; filled orders are done."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = table(spark, sf, "orders").select("o_custkey", F.row_number().over(w).alias("pos"), (F.col("o_orderstatus") == "F").alias("done"))
    return S.ready_tasks(t.withColumn("needs", F.when(F.col("pos") > 1, F.col("pos") - 1)), "o_custkey", "pos", "done", "needs")


def budget_enforce(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return S.enforce_budget(e, "user_id", ["ts", "event_id"], "value", MAX_STEPS, MAX_COST).select("event_id", "step", "stop")


def action_counts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.round(F.sum("value"), 4).alias("value"))


def event_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return S.gaps(table(spark, sf, "events"), "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")), ["ts", "event_id"])


def attempt_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation as a call, its turns as attempts."""
    return S.attempt_summary(table(spark, sf, "conversations"), "conv_id", "turn", 6)


def tool_route(spark: SparkSession, sf: str) -> DataFrame:
    """Which reader a page goes to, by ordered rules on its source."""
    h = F.lower(F.col("html"))
    tool = F.when(F.contains(h, F.lit("<table")), "tables").when(F.contains(h, F.lit("<pre")) | F.contains(h, F.lit("<code")), "code").when(F.length("html") < 1500, "short").otherwise("text")
    return table(spark, sf, "pages").groupBy(tool.alias("tool")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("size"))


def choose_action(spark: SparkSession, sf: str) -> DataFrame:
    """The next action of each user's session."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    s = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("step"), n("view").alias("seen"), n("purchase").alias("verified"), (n("error") / 8).cast("int").alias("failed"))
    return s.select("user_id", "step", S.next_action(F.col("step"), F.col("seen"), F.col("verified"), F.col("failed")).alias("action"))


def hourly_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each kind an hour: the batch form of the streaming count."""
    e = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def turn_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns that repeat the words of the turn before, blanks and case aside."""
    c = table(spark, sf, "conversations").withColumn("flat", F.lower(F.regexp_replace("text", "[ \\t\\n\\r\\f]+", " ")))
    c = c.withColumn("before", F.lag("flat").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("flat") == F.col("before")).alias("copies"))


QUERIES = {f.__name__: f for f in (plan_ready, budget_enforce, action_counts, event_gaps, attempt_budget, tool_route, choose_action, hourly_actions, turn_reviews)}
SQL = {
    "plan_ready": """WITH t AS (SELECT o_custkey, o_orderstatus = 'F' AS done, row_number() OVER w AS pos, lag(o_orderstatus = 'F') OVER w AS met FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, min(pos)::INT AS pos FROM t WHERE NOT done AND (pos = 1 OR met) GROUP BY o_custkey""",
    "budget_enforce": """SELECT event_id, step, CASE WHEN step > 40 THEN 'steps' WHEN round(spent, 6) > 2500 THEN 'cost' END AS stop FROM (
SELECT event_id, count(*) OVER w AS step, sum(value) OVER w AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""",
    "action_counts": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + ", round(sum(value), 4) AS value FROM events GROUP BY user_id",
    "event_gaps": """SELECT user_id, count(*) AS n, round(avg(sec - p), 6) AS mean_gap, max(sec - p) AS longest_gap FROM (SELECT user_id, sec, lag(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
FROM (SELECT *, floor(epoch(ts))::BIGINT AS sec FROM events)) GROUP BY user_id""",
    "attempt_budget": "SELECT conv_id, count(*) AS attempts, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous, count(*) <= 6 AS within_budget FROM conversations GROUP BY conv_id",
    "tool_route": """SELECT CASE WHEN contains(lower(html), '<table') THEN 'tables' WHEN contains(lower(html), '<pre') OR contains(lower(html), '<code') THEN 'code' WHEN length(html) < 1500 THEN 'short' ELSE 'text' END AS tool,
count(*) AS n, sum(length(html))::BIGINT AS size FROM pages GROUP BY 1""",
    "choose_action": """SELECT user_id, step, CASE WHEN failed >= 3 THEN 'stop' WHEN seen = 0 THEN 'retrieve' WHEN verified = 0 THEN 'verify' WHEN step >= 10 THEN 'write' ELSE 'continue' END AS action FROM (
SELECT user_id, count(*) AS step, count(*) FILTER (event_type = 'view') AS seen, count(*) FILTER (event_type = 'purchase') AS verified, count(*) FILTER (event_type = 'error') // 8 AS failed FROM events GROUP BY user_id)""",
    "hourly_actions": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "turn_reviews": """SELECT conv_id, count(*) AS turns, count(*) FILTER (flat = before) AS copies FROM (SELECT *, lag(flat) OVER (PARTITION BY conv_id ORDER BY turn) AS before
FROM (SELECT *, lower(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS flat FROM conversations)) WHERE role = 'assistant' GROUP BY conv_id""",
}
