"""Running benchmark cases through retrievers by mode, on graphs or palaces."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import benchmark, modes, palace, search
from trailmark.sources import bridge, storage


def run(cases: DataFrame, nodes: DataFrame, edges: DataFrame, mode: str, k: int = 3, hops: int = 2, order: str = "ord") -> DataFrame:
    """Reports of the cases in one mode, on the graph as it is given; in dynamic modes cases go in turn."""
    how, began = modes.mode(mode), time.time()
    found, after = modes.search_in_turn(cases.select("graph_id", "query_id", "text", order), nodes, edges, how, order, k, hops)
    found = search.Found(storage.keep(found.paths, "paths"), storage.keep(found.trace, "traces"))
    each = (time.time() - began) * 1000 / max(1, cases.count())
    seen = storage.keep(benchmark.surfaced(found, storage.keep(after, "after"), edges), "surfaced")
    return storage.keep(benchmark.judge(cases, seen, after).withColumn("mode", F.lit(mode)).withColumn("latency_ms", F.lit(round(each, 3))), "reports")


def run_palace(cases: DataFrame, memories: DataFrame, spaces: DataFrame, links: DataFrame, policy: palace.Policy) -> DataFrame:
    """Reports of the cases through a palace's recall; its routes stand for paths, without edge types or traces."""
    began = time.time()
    got = palace.recall(cases.select("graph_id", "query_id", "text"), memories, spaces, links, policy)
    columns = [*benchmark.Q, "rank", "node_id", "score", "reason", "retrieval_role"]
    top, routes = storage.keep(got.memories.select(*columns), "recalled"), storage.keep(got.routes, "routes")
    each = (time.time() - began) * 1000 / max(1, cases.count())
    paths = search.legacy_paths(top, routes).join(routes.select(*benchmark.Q, "route_id", F.col("rank").alias("seed")), [*benchmark.Q, "route_id"])
    nodes = bridge.to_nodes(memories)
    told = search.answered(paths.join(cases.select(*benchmark.Q, "text"), benchmark.Q).select(*search.KEY, "text", "steps", "final_score"), nodes)
    empty = "graph_id long, query_id string, seed long, step int, node_id string, edge_type string, hop int, is_seed boolean, stopped_reason string"
    kind = dict(cases.dtypes)["query_id"]
    trace = memories.sparkSession.createDataFrame([], empty).withColumn("query_id", F.col("query_id").cast(kind)).withColumn("node_id", F.col("node_id").cast(nodes.schema["node_id"].dataType))
    snapshot = got.snapshot.select(*[F.col(f.name).cast(f.dataType) for f in trace.schema])
    seen = benchmark.surfaced(search.Found(told, trace), nodes, links, top, routes).drop("_snapshot")
    every = benchmark.trace_steps(snapshot, benchmark.Q).withColumnRenamed("_trace", "_snapshot")
    seen = seen.join(every, benchmark.Q, "left")
    judged = benchmark.judge(cases, seen, nodes.withColumn("state", F.col("lifecycle_state")))
    return storage.keep(judged.withColumn("mode", F.lit(f"palace_{policy.mode}")).withColumn("latency_ms", F.lit(round(each, 3))), "reports")


def run_suite(cases: DataFrame, nodes: DataFrame, edges: DataFrame, names: list[str] | None = None, k: int = 3, hops: int = 2, order: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports, summaries by mode, comparison by case) of the modes, each on a fresh copy of the graph."""
    every = reduce(DataFrame.unionByName, [run(cases, nodes, edges, m, k, hops, order) for m in names or modes.DEFAULT_MODES])
    return every, benchmark.mode_report(every, ["mode"]), benchmark.compare(every)


def run_palace_suite(cases: DataFrame, memories: DataFrame, spaces: DataFrame, links: DataFrame, names: list[str] | None = None, top_k: int = 3, max_hops: int = 3, max_spaces: int = 3, max_seeds: int = 5, fallback: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    every = reduce(DataFrame.unionByName, [run_palace(cases, memories, spaces, links, palace.Policy(m, top_k, max_hops, max_spaces, max_seeds, fallback)) for m in names or modes.DEFAULT_MODES])
    return every, benchmark.mode_report(every, ["mode"]), benchmark.compare(every)
