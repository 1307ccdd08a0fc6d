"""Lifecycle of nodes: reinforcement of touched ones, decay of others, as folds over a node's ordered log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


STATES = ("encoded", "active", "stabilizing", "consolidated", "fading", "archived")


def start() -> Column:
    return F.struct(F.lit("encoded").alias("state"), F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("stability"), F.lit(1.0).alias("decay"))


def _state(state: Column, count: Column, stability: Column, decay: Column) -> Column:
    return F.struct(state.alias("state"), count.cast("long").alias("count"), F.round(stability, 6).alias("stability"), F.round(decay, 6).alias("decay"))


def reinforce(s: Column) -> Column:
    count, stability = s["count"] + 1, F.least(F.lit(1.0), s["stability"] + 0.2)
    state = F.when((count >= 4) | (stability >= 0.8 - 1e-9), F.lit("consolidated")).when(count >= 2, F.lit("stabilizing")).otherwise(F.lit("active"))
    return _state(state, count, stability, F.least(F.lit(1.0), s["decay"] + 0.02))


def decay(s: Column, steps: float = 1.0) -> Column:
    decayed, stability = F.greatest(F.lit(0.0), s["decay"] - 0.05 * steps), F.greatest(F.lit(0.0), s["stability"] - 0.1 * steps)
    state = F.when(decayed <= 0.2 + 1e-9, F.lit("archived")).when((s["state"] == "consolidated") & (stability < 0.55 - 1e-9), F.lit("fading")).when(s["state"].isin("active", "stabilizing") & (stability <= 1e-9), F.lit("fading")).otherwise(s["state"])
    return _state(state, s["count"], stability, decayed)


def consolidate(s: Column) -> Column:
    """A memory that has been drawn together with others: consolidated, with a stability and a decay factor not under these."""
    return _state(F.lit("consolidated"), s["count"], F.greatest(s["stability"], F.lit(0.85)), F.greatest(s["decay"], F.lit(0.9)))


def policy_reinforce(s: Column) -> Column:
    """A dynamic policy's touch: its own step up of the decay factor, then the lifecycle's."""
    return reinforce(_state(s["state"], s["count"], s["stability"], F.least(F.lit(1.0), s["decay"] + 0.02)))


def policy_decay(s: Column) -> Column:
    """A dynamic policy's decay: by a twentieth but not under a half, then the lifecycle's."""
    return decay(_state(s["state"], s["count"], s["stability"], F.greatest(F.lit(0.5), s["decay"] * 0.95)))


def fold(log: DataFrame, node: str, order: str, touched: str, touch=reinforce, rest=decay) -> DataFrame:
    """The last state of each node, from a log with a row per node and query.

    The log of a node is folded in order, so this gathers a node's own log; nothing else meets in a task.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(touched).alias("t"))))
    rows = log.groupBy(node).agg(steps.alias("_log"))
    last = F.aggregate("_log", start(), lambda s, x: F.when(x["t"], touch(s)).otherwise(rest(s)))
    return rows.select(node, last.alias("_s")).select(node, "_s.*")
