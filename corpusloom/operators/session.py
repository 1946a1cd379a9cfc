"""Session logic over many sessions at once: plans, budgets, attempts and telemetry as window and group operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ready_tasks(tasks: DataFrame, session: str, pos: str, done: str, needs: str) -> DataFrame:
    """(session, pos): each session's first open task whose needed earlier task (``needs``, null if none) is done."""
    need = tasks.select(F.col(session).alias("s"), F.col(pos).alias("p"), F.col(done).alias("met"))
    j = tasks.where(~F.col(done)).join(need, (F.col(session) == F.col("s")) & (F.col(needs) == F.col("p")), "left")
    return j.where(F.col(needs).isNull() | F.col("met")).groupBy(session).agg(F.min(pos).alias(pos))


def enforce_budget(steps: DataFrame, session: str, order: list[str], cost: str, max_steps: int, max_cost: float) -> DataFrame:
    """``steps`` with step, spent (both up to and with the row) and stop, the first reason that forbids it."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = steps.withColumn("step", F.count("*").over(w)).withColumn("spent", F.round(F.sum(cost).over(w), 6))
    return out.withColumn("stop", F.when(F.col("step") > max_steps, "steps").when(F.col("spent") > max_cost, "cost"))


def attempt_summary(attempts: DataFrame, call: str, attempt: str, most: int) -> DataFrame:
    """Each call's attempts, whether they are contiguous from 0, and whether there are no more than ``most``."""
    g = attempts.groupBy(call).agg(F.count("*").alias("attempts"), F.countDistinct(attempt).alias("kinds"), F.min(attempt).alias("lo"), F.max(attempt).alias("hi"))
    contiguous = (F.col("lo") == 0) & (F.col("hi") == F.col("attempts") - 1) & (F.col("kinds") == F.col("attempts"))
    return g.select(call, "attempts", contiguous.alias("contiguous"), (F.col("attempts") <= most).alias("within_budget"))


def gaps(events: DataFrame, session: str, at: Column, order: list[str]) -> DataFrame:
    """Each session's count, and mean and longest gap in seconds between its events."""
    e = events.withColumn("__at", at)
    e = e.withColumn("__gap", F.col("__at") - F.lag("__at").over(Window.partitionBy(session).orderBy(*order)))
    return e.groupBy(session).agg(F.count("*").alias("n"), F.round(F.avg("__gap"), 6).alias("mean_gap"), F.max("__gap").alias("longest_gap"))


def next_action(step: Column, seen: Column, verified: Column, failed: Column) -> Column:
    """The controller's decision table, first rule first."""
    return F.when(failed >= 3, "stop").when(seen == 0, "retrieve").when(verified == 0, "verify").when(step >= 10, "write").otherwise("continue")
