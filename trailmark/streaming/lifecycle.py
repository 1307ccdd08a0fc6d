"""The lifecycle of nodes over a stream of touches: each batch goes on from the state that the last one left."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "state string, count long, stability double, decay double"


def step(state: str, count: int, stability: float, decay: float, touched: bool) -> tuple[str, int, float, float]:
    """One event of a node's log, as operators.state has it for whole logs."""
    if touched:
        count, stability, decay = count + 1, min(1.0, stability + 0.2), min(1.0, decay + 0.02)
        state = "consolidated" if count >= 4 or stability >= 0.8 - 1e-9 else "stabilizing" if count >= 2 else "active"
    else:
        decay, stability = max(0.0, decay - 0.05), max(0.0, stability - 0.1)
        worn = state == "consolidated" and stability < 0.55 - 1e-9 or state in ("active", "stabilizing") and stability <= 1e-9
        state = "archived" if decay <= 0.2 + 1e-9 else "fading" if worn else state
    return state, count, round(stability, 6), round(decay, 6)


def stream_fold(log: DataFrame, node: str, order: str, touched: str) -> DataFrame:
    """A streaming log to a stream of updates: the node, how many events it has had, and its state after each batch.

    Events of a batch count in their order; one that comes in a later batch counts when it comes.  A node's events
    arrive in Arrow batches, and only its four values are kept between them.  A null flag is no touch.
    """
    kind = dict(log.dtypes)[node]
    schema = f"`{node}` {kind}, n_events long, {STATE}"

    def go_on(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        n, *now = kept.get if kept.exists else (0, "encoded", 0, 0.0, 1.0)
        arrived = [(o, not pd.isna(t) and bool(t)) for f in frames for o, t in zip(f["o"], f["t"])]
        for _, t in sorted(arrived):
            now = step(*now, t)
        n += len(arrived)
        kept.update((n, *now))
        yield pd.DataFrame([[key[0], n, *now]], columns=[node, "n_events", "state", "count", "stability", "decay"])

    rows = log.selectExpr(f"`{node}`", f"`{order}` as o", f"`{touched}` as t")
    return rows.groupBy(node).applyInPandasWithState(go_on, schema, f"n_events long, {STATE}", "update", GroupStateTimeout.NoTimeout)
