"""Budgets of sessions: time, steps, cost, searches and repeated requests, over a table of events and over a stream of them.

A session is the actions that it asks for. The first that a limit forbids stops it, with the first reason in this order: the
deadline has passed, the steps are used up, its cost would exceed the budget, the searches are used up, the same search was
made before. Both forms give the same stops for the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

REASONS = ("time_budget_exhausted", "step_budget_exhausted", "cost_budget_exhausted", "search_budget_exhausted", "repeated_search_without_progress")


@dataclass(frozen=True)
class Limits:
    seconds: int = 600
    steps: int = 20
    cost: float | None = None
    searches: int = 8


def session_stops(events: DataFrame, limits: Limits, bucket_seconds: int = 3600, until: Column | None = None) -> DataFrame:
    """(session, steps, spent, searches, reason, at): what each session did before it stopped; reason and at are null if it didn't.

    events: (session, event_id, ts, cost, search: whether it is one, request). ``at`` is the stopping event's time, or the deadline
    where time ran out; ``until``: sessions whose deadline isn't after it have stopped too, without a further event. Events come by
    (ts, event_id). Sums by buckets of time tell in which bucket a limit is reached first; only its events are put in order.
    """
    e = events.select("session", "event_id", "ts", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("search", F.lit(False)).alias("search"), "request")
    e = e.withColumn("bucket", F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000)))
    first = e.groupBy("session").agg(F.min("ts").alias("began"))
    deadline = F.timestamp_micros(F.unix_micros("began") + limits.seconds * 1_000_000)
    # The second time that a session makes the same search, which sessions and requests tell without ordering.
    asked = e.where("search").groupBy("session", "request").agg(F.array_sort(F.slice(F.array_sort(F.collect_set(F.struct("ts", "event_id"))), 1, 2)).alias("two"))
    again = asked.where("size(two) > 1").groupBy("session").agg(F.min(F.element_at("two", 2)).alias("again"))
    b = e.groupBy("session", "bucket").agg(F.count("*").alias("n"), F.sum("cost").alias("c"), F.count_if("search").alias("s"), F.max("ts").alias("last"))
    before = Window.partitionBy("session").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumns({f"{k}0": F.coalesce(F.sum(k).over(before), F.lit(0)) for k in ("n", "c", "s")}).join(first, "session").join(again, "session", "left").withColumn("deadline", deadline)
    over = (F.col("last") >= F.col("deadline")) | (F.col("n0") + F.col("n") > limits.steps) | (F.col("s0") + F.col("s") > limits.searches)
    if limits.cost is not None:
        over = over | (F.col("c0") + F.col("c") > limits.cost)
    over = over | F.coalesce(F.col("again.ts") <= F.col("last"), F.lit(False))
    hit = b.where(over).groupBy("session").agg(F.min_by(F.struct("bucket", "n0", "c0", "s0", "deadline", "again"), "bucket").alias("h")).select("session", "h.*")
    w = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = e.join(hit, ["session", "bucket"])
    done = {"n": F.count("*").over(w), "c": F.coalesce(F.sum("cost").over(w), F.lit(0.0)), "s": F.coalesce(F.sum(F.col("search").cast("int")).over(w), F.lit(0))}
    rows = rows.withColumns({k: F.col(f"{k}0") + v for k, v in done.items()})
    too_dear = F.lit(False) if limits.cost is None else F.col("c") + F.col("cost") > limits.cost
    repeated = F.coalesce(F.col("search") & (F.struct("ts", "event_id") >= F.col("again")), F.lit(False))
    reason = F.when(F.col("ts") >= F.col("deadline"), REASONS[0]).when(F.col("n") >= limits.steps, REASONS[1]).when(too_dear, REASONS[2]).when(F.col("search") & (F.col("s") >= limits.searches), REASONS[3]).when(repeated, REASONS[4])
    stops = rows.withColumn("reason", reason).where("reason is not null").groupBy("session").agg(F.min_by(F.struct("n", "c", "s", "reason", F.when(F.col("reason") == REASONS[0], F.col("deadline")).otherwise(F.col("ts")).alias("at")), F.struct("ts", "event_id")).alias("x"))
    total = e.groupBy("session").agg(F.count("*").alias("n"), F.sum("cost").alias("c"), F.count_if("search").alias("s"), F.min("ts").alias("began"))
    out = total.join(stops, "session", "left")
    late = F.lit(False) if until is None else deadline <= until
    stopped = F.col("x").isNotNull()
    pick = lambda k: F.when(stopped, F.col(f"x.{k}")).otherwise(F.col(k))
    return out.select(
        "session", pick("n").alias("steps"), F.round(pick("c"), 6).alias("spent"), pick("s").cast("long").alias("searches"), F.when(stopped, F.col("x.reason")).when(late, REASONS[0]).alias("reason"), F.when(stopped, F.col("x.at")).when(late, deadline).alias("at")
    )


STOP = "session string, steps long, spent double, searches long, reason string, at timestamp"
STATE = "began long, steps long, spent double, searches long, requests array<string>, stopped boolean"


def stop_stream(events: DataFrame, limits: Limits, late: str = "10 minutes") -> DataFrame:
    """A stream of stops (session, steps, spent, searches, reason, at), one for each session that stops, from a stream of events.

    A session whose deadline the watermark has passed stops without another event. Its state is a few numbers and the searches
    made, which their limit bounds. Events of a micro-batch are put in order, those of different ones count as they come.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def stop(reason: str, at: int) -> pd.DataFrame:
            return pd.DataFrame({"session": [key[0]], "steps": [steps], "spent": [round(spent, 6)], "searches": [searches], "reason": [reason], "at": [pd.Timestamp(at, unit="us")]})

        began, steps, spent, searches, requests, stopped = state.get if state.exists else (None, 0, 0.0, 0, [], False)
        requests = list(requests)
        if state.hasTimedOut:
            if not stopped:
                yield stop(REASONS[0], began + limits.seconds * 1_000_000)
            state.remove()
            return
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["ts", "event_id"])
        for r in rows.itertuples(index=False):
            at = r.ts.value // 1000
            began = at if began is None else began
            if stopped:
                break
            end, cost = began + limits.seconds * 1_000_000, 0.0 if pd.isna(r.cost) else float(r.cost)
            search = bool(r.search) if not pd.isna(r.search) else False
            reason = None
            if at >= end:
                reason, at = REASONS[0], end
            elif steps >= limits.steps:
                reason = REASONS[1]
            elif limits.cost is not None and spent + cost > limits.cost:
                reason = REASONS[2]
            elif search and searches >= limits.searches:
                reason = REASONS[3]
            elif search and r.request in requests:
                reason = REASONS[4]
            if reason:
                stopped = True
                yield stop(reason, at)
                break
            steps, spent, searches = steps + 1, spent + cost, searches + search
            if search:
                requests.append(r.request)
        state.update((began, steps, spent, searches, requests, stopped))
        # A session that has stopped is forgotten at its deadline too.
        state.setTimeoutTimestamp(max((began + limits.seconds * 1_000_000) // 1000, state.getCurrentWatermarkMs() + 1))

    keyed = events.select(F.col("session").cast("string").alias("session"), "event_id", "ts", F.col("cost").cast("double").alias("cost"), "search", "request").withWatermark("ts", late)
    return keyed.groupBy("session").applyInPandasWithState(step, STOP, STATE, "append", GroupStateTimeout.EventTimeTimeout)
