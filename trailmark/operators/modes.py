"""Retrievers by name, and searches that change the memory they search.

In static modes all questions are one plan.  In dynamic modes every question reinforces the nodes on its paths and lets
the others decay, and the next question meets that state: questions go one after another, in their order, and the
nodes' state is written to the shared folder after each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators import graph, search, state
from trailmark.sources import storage

STATE = ["usage", "decay", "state", "stability", "count"]


@dataclass(frozen=True)
class StatePolicy:
    """How use changes a node.  A dynamic policy may be given other Columns; a static one changes nothing."""

    dynamic: bool = True
    touch: Callable[[Column], Column] = state.policy_reinforce
    rest: Callable[[Column], Column] = state.policy_decay


STATIC = StatePolicy(False)


@dataclass(frozen=True)
class Mode:
    kind: str  # lex, cos, paths or spreading
    policy: StatePolicy = STATIC
    total: search.Total = graph.weighted
    propagation: search.Propagation = field(default_factory=search.Propagation)
    most: int = 12


MODES: dict[str, Mode] = {
    "lexical_baseline": Mode("lex"),
    "embedding_baseline": Mode("cos"),
    "structure_only": Mode("paths", total=graph.structure_only),
    "weighted_graph": Mode("paths", StatePolicy()),
    "activation_spreading_v1": Mode("spreading", StatePolicy()),
    "weighted_graph_static": Mode("paths"),
    "weighted_graph_dynamic": Mode("paths", StatePolicy()),
    "activation_spreading_static": Mode("spreading"),
    "activation_spreading_dynamic": Mode("spreading", StatePolicy()),
}
DEFAULT_MODES = list(MODES)


def mode(name: str) -> Mode:
    if name not in MODES:
        raise ValueError(f"Unknown retriever mode {name!r}. Available: {', '.join(sorted(MODES))}")
    return MODES[name]


def search_once(queries: DataFrame, nodes: DataFrame, edges: DataFrame, how: Mode, k: int = 3, hops: int = 2, sims: DataFrame | graph.Similar | None = None) -> search.Found:
    """All questions against the graph as it stands."""
    p = search.prepare(queries, nodes, edges, how.policy.dynamic, sims)
    if how.kind in ("lex", "cos"):
        return search.top_hits(queries, graph.as_nodes(nodes), p.sims, k, how.kind)
    seeds = storage.keep(graph.seeds(queries, p.nodes, p.sims, k), "seeds")
    if how.kind == "paths":
        return search.search_paths(p, seeds, hops, how.total)
    if how.kind == "spreading":
        return search.search_spreading(p, seeds, hops, how.total, how.propagation, how.most)
    raise ValueError(f"no kind of search {how.kind!r}")


def visited(paths: DataFrame) -> DataFrame:
    """(graph_id, node_id) of the distinct nodes on paths."""
    return paths.select("graph_id", F.explode("steps").alias("_s")).select("graph_id", F.col("_s.node_id").alias("node_id")).distinct()


def read_state(nodes: DataFrame) -> Column:
    """A node's lifecycle; a state that isn't known counts as encoded."""
    known = F.when(F.col("state").isin(list(state.STATES)), F.col("state")).otherwise("encoded")
    return F.struct(known.alias("state"), F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.col("stability").alias("stability"), F.col("decay").alias("decay"))


def after_search(nodes: DataFrame, touched: DataFrame, policy: StatePolicy) -> DataFrame:
    """nodes after a question: those touched (graph_id, node_id) are reinforced and used once more, the others decay once.

    One left join; nodes of graphs that no question searched rest as well, so give only the graphs in use.
    """
    if not policy.dynamic:
        return nodes
    rows = graph.as_nodes(nodes)
    rows = rows if "count" in rows.columns else rows.withColumn("count", F.lit(0).cast("long"))
    rows = rows.join(touched.select("graph_id", "node_id").distinct().withColumn("_hit", F.lit(True)), ["graph_id", "node_id"], "left").withColumn("_s", read_state(rows))
    rows = rows.withColumn("_n", F.when(F.col("_hit"), policy.touch(F.col("_s"))).otherwise(policy.rest(F.col("_s"))))
    new = {"usage": F.col("usage") + F.when(F.col("_hit"), 1).otherwise(0), "decay": F.col("_n.decay"), "state": F.col("_n.state"), "stability": F.round("_n.stability", 6), "count": F.col("_n.count")}
    return rows.withColumns(new).drop("_hit", "_s", "_n")


def search_in_turn(queries: DataFrame, nodes: DataFrame, edges: DataFrame, how: Mode, order: str = "query_id", k: int = 3, hops: int = 2, sims: DataFrame | None = None) -> tuple[search.Found, DataFrame]:
    """Questions one after another, each on the state that the last one left, and the nodes after the last.

    For question logs of a few hundred: every question is a job of its own and its result is stored.  Static modes
    take one plan for all.
    """
    if not how.policy.dynamic:
        return search_once(queries, nodes, edges, how, k, hops, sims), graph.as_nodes(nodes)
    found, now = [], graph.as_nodes(nodes)
    fixed = storage.keep(graph.similarities(queries, now) if sims is None else sims, "turn-sims")
    for row in queries.select(order, "query_id", "graph_id").orderBy(order).collect():
        one = queries.where((F.col("query_id") == F.lit(row["query_id"])) & (F.col("graph_id") == F.lit(row["graph_id"])))
        got = search_once(one, now, edges, how, k, hops, fixed.where(F.col("query_id") == F.lit(row["query_id"])))
        got = search.Found(storage.keep(got.paths, "turn-paths"), storage.keep(got.trace, "turn-trace"))
        found.append(got)
        now = storage.keep(after_search(now, visited(got.paths), how.policy), "turn-nodes")
    if not found:
        return search_once(queries, nodes, edges, replace(how, policy=STATIC), k, hops, sims), now
    every = [f.paths for f in found], [f.trace for f in found]
    joined = [x[0] if len(x) == 1 else _union(x) for x in every]
    return search.Found(*joined), now


def _union(parts: list[DataFrame]) -> DataFrame:
    while len(parts) > 1:  # in pairs, so that the plan stays shallow
        parts = [a.unionByName(b[0]) if b else a for a, *b in _pairs(parts)]
    return parts[0]


def _pairs(parts: list[DataFrame]) -> Iterator[list[DataFrame]]:
    for i in range(0, len(parts), 2):
        yield parts[i : i + 2]


def retriever(name: str, nodes: DataFrame, edges: DataFrame) -> Callable[..., search.Found]:
    """search(queries, k=3, hops=2) of a mode on a graph; dynamic modes remember the state between calls."""
    how = mode(name)
    held = {"nodes": graph.as_nodes(nodes)}

    def run(queries: DataFrame, k: int = 3, hops: int = 2) -> search.Found:
        got, held["nodes"] = search_in_turn(queries, held["nodes"], edges, how, "query_id", k, hops)
        return got

    return run
