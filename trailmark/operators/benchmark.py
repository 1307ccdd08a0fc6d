"""Benchmarks: what a search has surfaced for each case, held against what the case expects; reports over cases.

cases: (graph_id, query_id, text, evidence, minimum) and any of path, path_scope, route, route_scope, route_sources,
trace, stop_reasons, least_trace, most_trace, snapshot, space_ids, roles, scenario_tags, symbolic_tags, kinds,
edge_types, lifecycle (a map of id to state), contradictions (pairs of ids).  path and route are struct<match_mode,
steps: array<struct<node_id, via_edge_type>>>, trace and snapshot struct<match_mode, steps: array<struct<node_id,
edge_type, hop, is_seed, stopped_reason>>>; fields of a step that are null match anything.  A hit is null where a case
expects nothing of the kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import scores
from trailmark.operators import graph, search

Q = ["graph_id", "query_id"]
HITS = ["path_hit", "route_hit", "space_hit", "trace_hit", "snapshot_hit", "semantic_hit", "contradiction_hit", "lifecycle_hit"]


def shape_hit(found: Column, expected: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Whether expected's steps are found: all of them and no others (exact), at the start (prefix), or in order with gaps."""
    mode, steps = expected["match_mode"], expected["steps"]
    like = lambda a, e: F.coalesce(same(a, e), F.lit(False))
    start = (F.size(found) >= F.size(steps)) & F.forall(F.zip_with(F.slice(found, F.lit(1), F.size(steps)), steps, like), lambda x: x)
    got = F.aggregate(found, F.lit(0), lambda i, a: F.when((i < F.size(steps)) & like(a, F.get(steps, i)), i + 1).otherwise(i))
    return F.when(mode == "exact", start & (F.size(found) == F.size(steps))).when(mode == "prefix", start).otherwise(got == F.size(steps))


def same_step(a: Column, e: Column) -> Column:
    return (a["node_id"] == e["node_id"]) & (e["via_edge_type"].isNull() | a["via_edge_type"].eqNullSafe(e["via_edge_type"]))


def same_trace_step(a: Column, e: Column) -> Column:
    out = a["node_id"] == e["node_id"]
    for c in ("edge_type", "hop", "is_seed", "stopped_reason"):
        out = out & (e[c].isNull() | a[c].eqNullSafe(e[c]))
    return out


def _all_in(cases: DataFrame, name: str, found: str) -> Column:
    """True if found has all that the case requires, null if it requires nothing."""
    if name not in cases.columns:
        return F.lit(None).cast("boolean")
    return F.when(F.size(F.coalesce(name, F.array().cast(cases.schema[name].dataType))) > 0, F.size(F.array_except(name, found)) == 0)


def trace_steps(trace: DataFrame, by: list[str]) -> DataFrame:
    step = F.struct(*([F.col("seed")] if "seed" not in by else []), "step", "node_id", "edge_type", "hop", "is_seed", "stopped_reason")
    return trace.groupBy(*by).agg(F.array_sort(F.collect_list(step)).alias("_trace"))


def surfaced(found: search.Found, nodes: DataFrame, edges: DataFrame, memories: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """What each question surfaced: ids, roles, tags, spaces, kinds, states, route sources, contradictions, and its best path with its trace.

    memories and routes are a recall's; without them they are the view of the paths.
    """
    view, ways = search.recalled(found.paths)
    memories, routes = view if memories is None else memories, ways if routes is None else routes
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    ids = search.returned_ids(found.paths, memories)
    rows = ids.select(*Q, F.explode("node_ids").alias("node_id")).join(nodes, ["graph_id", "node_id"])
    distinct = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))) if c in nodes.columns else F.array().cast("array<string>")
    tags = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(empty(F.col(c)))))) if c in nodes.columns else F.array().cast("array<string>")
    own = rows.groupBy(*Q).agg(distinct("role").alias("roles_found"), tags("scenario_tags").alias("scenarios_found"), tags("symbolic_tags").alias("symbols_found"), distinct("space_id").alias("spaces_found"))
    kinds = memories.select(*Q, "node_id").join(nodes, ["graph_id", "node_id"]).groupBy(*Q).agg(*[distinct(c).alias(f"{c}s_found") for c in ("kind", "consolidation_kind", "state")])
    sources = routes.groupBy(*Q).agg(F.array_sort(F.collect_set("route_source")).alias("sources_found"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "route_id", "steps"))), lambda r: r["steps"]).alias("_routes"))
    best = search.best_path(found.paths)
    hops = F.filter(F.transform("steps", lambda s: s["via_edge_type"]), lambda e: e.isNotNull())
    top = best.select(*Q, "seed", F.col("steps").alias("best_steps"), hops.alias("path_edge_types"), F.greatest(F.lit(0), F.size("steps") - 1).alias("best_path_hops"), F.col("answer").alias("best_answer"))
    top = top.join(trace_steps(found.trace, [*Q, "seed"]), [*Q, "seed"], "left").drop("seed")
    every = trace_steps(found.trace, Q).withColumnRenamed("_trace", "_snapshot")
    paths = found.paths.groupBy(*Q).agg(F.collect_list("steps").alias("_paths"))
    pairs = graph.surfaced_pairs(graph.contradictions(nodes, graph.add_reverse(edges)), rows.select(*Q, "node_id"))
    pairs = pairs.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")))).alias("pairs_found"))
    out = ids
    for part in (own, kinds, sources, top, every, paths, _signals(best, nodes, edges)):
        out = out.join(part, Q, "left")
    return out.join(pairs, "query_id", "left")


def _signals(best: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The largest exception and contradiction scores on each best path, the step before being the source."""
    n, e = graph.mark_contradictions(nodes, graph.add_reverse(edges))
    rows = best.select(*Q, F.posexplode("steps").alias("i", "_s")).select(*Q, "i", F.col("_s.node_id").alias("node_id"))
    rows = rows.withColumn("src", F.lag("node_id").over(Window.partitionBy(*Q).orderBy("i"))).join(n.select("graph_id", "node_id", "role", "in_pair"), ["graph_id", "node_id"])
    joined = e.where("pair").select("graph_id", "src", F.col("dst").alias("node_id")).distinct().withColumn("pair", F.lit(True))
    rows = rows.join(joined, ["graph_id", "src", "node_id"], "left")
    contra = graph.contradiction_score(F.coalesce("pair", F.lit(False)), F.col("in_pair"))
    return rows.groupBy(*Q).agg(F.max(scores.exception_score(F.col("role"))).alias("best_exception"), F.max(contra).alias("best_contradiction"))


def judge(cases: DataFrame, seen: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """A report for each case: its hits, their conjunction, matched and missing evidence, and what was surfaced.

    nodes, after the search, decide about lifecycle states; without them such expectations are not met.
    """
    rows = cases.join(seen.withColumnRenamed("node_ids", "returned"), Q, "left")
    listed = ["returned", "roles_found", "scenarios_found", "symbols_found", "spaces_found", "kinds_found", "consolidation_kinds_found", "states_found", "sources_found", "path_edge_types"]
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(seen.schema["node_ids" if c == "returned" else c].dataType)) for c in listed})
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("_trace", "_snapshot", "_paths", "_routes", "pairs_found")})
    none = F.lit(None).cast("boolean")
    fill = lambda c: F.coalesce(c, F.lit(False))
    matched = F.filter("evidence", lambda x: F.array_contains("returned", x))
    path = none
    if "path" in cases.columns:
        scope = F.col("path_scope") if "path_scope" in cases.columns else F.lit("any_path")
        best = fill(shape_hit(F.col("best_steps"), F.col("path"), same_step))
        path = F.when(F.col("path").isNotNull(), F.when(scope.eqNullSafe(F.lit("best_path")), best).otherwise(F.exists("_paths", lambda p: fill(shape_hit(p, F.col("path"), same_step)))))
    route = none
    if "route" in cases.columns or "route_sources" in cases.columns:
        wanted = F.coalesce("route_sources", F.array().cast("array<string>")) if "route_sources" in cases.columns else F.array().cast("array<string>")
        source = (F.size(wanted) == 0) | F.arrays_overlap(wanted, "sources_found")
        shape = F.lit(True)
        stated = F.size(wanted) > 0
        if "route" in cases.columns:
            scope = F.col("route_scope") if "route_scope" in cases.columns else F.lit("any_route")
            some = F.when(scope.eqNullSafe(F.lit("best_route")), F.slice("_routes", 1, 1)).otherwise(F.col("_routes"))
            fits = F.exists(some, lambda r: fill(shape_hit(F.transform(r, lambda x: F.struct(x.alias("node_id"), F.lit(None).cast("string").alias("via_edge_type"))), F.col("route"), same_step)))
            shape, stated = F.when(F.col("route").isNull(), True).otherwise(fits), stated | F.col("route").isNotNull()
        route = F.when(stated, source & shape)
    reasons = F.array_sort(F.array_distinct(F.filter(F.transform("_trace", lambda s: s["stopped_reason"]), lambda x: x.isNotNull())))
    rows = rows.withColumn("stopped_reasons", reasons).withColumn("trace_length", F.size("_trace"))
    checks = [_all_in(cases, "stop_reasons", "stopped_reasons")]
    if "trace" in cases.columns:
        checks.append(F.when(F.col("trace").isNotNull(), fill(shape_hit(F.col("_trace"), F.col("trace"), same_trace_step))))
    if "least_trace" in cases.columns:
        checks.append(F.col("trace_length") >= F.col("least_trace"))
    if "most_trace" in cases.columns:
        checks.append(F.col("trace_length") <= F.col("most_trace"))
    snapshot = F.when(F.col("snapshot").isNotNull(), fill(shape_hit(F.col("_snapshot"), F.col("snapshot"), same_trace_step))) if "snapshot" in cases.columns else none
    space = _all_in(cases, "space_ids", "spaces_found")
    semantic = [space, *[_all_in(cases, a, b) for a, b in (("roles", "roles_found"), ("scenario_tags", "scenarios_found"), ("symbolic_tags", "symbols_found"), ("kinds", "consolidation_kinds_found"), ("edge_types", "path_edge_types"))]]
    contra = none
    if "contradictions" in cases.columns:
        pairs = F.transform("contradictions", lambda p: F.struct(F.least(p[0], p[1]).alias("a"), F.greatest(p[0], p[1]).alias("b")))
        contra = F.when(F.size(F.coalesce("contradictions", F.array().cast(cases.schema["contradictions"].dataType))) > 0, F.size(F.array_except(pairs, F.coalesce("pairs_found", F.array().cast(rows.schema["pairs_found"].dataType)))) == 0)
    rows = rows.withColumns({"matched": matched, "missing": F.array_except("evidence", "returned"), "path_hit": path, "route_hit": route, "space_hit": space, "trace_hit": _and(checks), "snapshot_hit": snapshot, "semantic_hit": _and(semantic), "contradiction_hit": contra})
    rows = rows.withColumn("evidence_hit", F.size("matched") >= F.col("minimum")).join(_lifecycle(cases, nodes), Q, "left")
    hit = F.col("evidence_hit")
    for c in HITS:
        hit = hit & F.coalesce(F.col(c), F.lit(True))
    keep = [*Q, "text", "evidence_hit", "hit", *HITS, "matched", "missing", *listed, "pairs_found", "activated", "trace_length", "stopped_reasons", "best_path_hops", "best_exception", "best_contradiction", "best_answer"]
    return rows.withColumn("hit", hit).withColumn("activated", F.size("returned")).select(*keep)


def _and(checks: list[Column]) -> Column:
    """The conjunction of those that aren't null, or null if all are."""
    some, good = F.lit(False), F.lit(True)
    for c in checks:
        some, good = some | c.isNotNull(), good & F.coalesce(c, F.lit(True))
    return F.when(some, good)


def _lifecycle(cases: DataFrame, nodes: DataFrame | None) -> DataFrame:
    if "lifecycle" not in cases.columns:
        return cases.select(*Q, F.lit(None).cast("boolean").alias("lifecycle_hit"))
    rows = cases.where(F.size(F.coalesce("lifecycle", F.create_map().cast(cases.schema["lifecycle"].dataType))) > 0).select(*Q, F.explode("lifecycle").alias("node_id", "_want"))
    if nodes is None:
        return rows.select(*Q, F.lit(False).alias("lifecycle_hit")).distinct()
    got = rows.join(nodes.select("graph_id", "node_id", "state"), ["graph_id", "node_id"], "left")
    return got.groupBy(*Q).agg(F.bool_and(F.coalesce(F.col("state") == F.col("_want"), F.lit(False))).alias("lifecycle_hit"))


def mode_report(reports: DataFrame, by: list[str]) -> DataFrame:
    """Of each group of case reports: questions, evidence_hit_rate, evidence_recall (the share of full hits) and the rates of every kind of hit over the cases that it applies to, with their number; 0 and 0 where there are none."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    out = [F.count(F.lit(1)).alias("questions"), rate("evidence_hit").alias("evidence_hit_rate"), rate("hit").alias("evidence_recall")]
    out += [x for c in HITS for x in (rate(c).alias(f"{c}_rate"), F.count(c).alias(f"{c}_cases"))]
    out += [F.coalesce(F.round(F.avg(c), 3), F.lit(0.0)).alias(f"avg_{c}") for c in ("activated", "best_path_hops", "trace_length")]
    if "latency_ms" in reports.columns:
        out.append(F.coalesce(F.round(F.avg("latency_ms"), 3), F.lit(0.0)).alias("avg_latency_ms"))
    return reports.groupBy(*by).agg(*out)


def overall(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Rates of several datasets as one, each weighed by its number of cases: (by, metric, rate, cases) from (by, metric, rate, cases)."""
    total = F.sum("cases")
    return summaries.groupBy(*by, "metric").agg(F.when(total > 0, F.round(F.sum(F.col("rate") * F.col("cases")) / total, 6)).otherwise(0.0).alias("rate"), total.alias("cases"))


def compare(reports: DataFrame) -> DataFrame:
    """Per question of reports of several modes: the modes that hit, by name, and whether all missed."""
    best = F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("mode"))))
    return reports.groupBy(*Q).agg(best.alias("best_modes"), (~F.bool_or("hit")).alias("missed_by_all"))


def kind_counts(memories: DataFrame) -> DataFrame:
    """(graph_id, episodic, semantic, route, spaces): how many memories of each kind and how many spaces a palace has."""
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(kind)
    return memories.groupBy("graph_id").agg(count("episodic"), count("semantic"), count("route"), F.countDistinct(F.when(F.col("kind") != "route", F.col("space_id"))).alias("spaces"))


def public_results(ranked: DataFrame, gold: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """Of each case hit_at_5, hit_at_10, ndcg_at_10 and the ranks of its gold; ranked: (query_id, node_id, rank), gold: (query_id, node_id)."""
    met = gold.select("query_id", "node_id").distinct().join(ranked, ["query_id", "node_id"], "left")
    within = lambda n: F.coalesce(F.max((F.col("rank") <= n).cast("int")), F.lit(0)).cast("double")
    gain = F.coalesce(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0))
    got = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"), within(5).alias("hit_at_5"), within(10).alias("hit_at_10"), gain.alias("_gain"), F.array_sort(F.collect_list("rank")).alias("ranks"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least("gold", F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda a, x: a + x)
    rows = cases.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.withColumns({"hit_at_5": zero(F.col("hit_at_5")), "hit_at_10": zero(F.col("hit_at_10")), "ndcg_at_10": zero(F.round(F.col("_gain") / ideal, 6)), "ranks": F.coalesce("ranks", F.array().cast("array<long>"))}).drop("_gain")


def public_report(results: DataFrame, by: list[str], buckets: list[str] = ()) -> DataFrame:
    """Means of public_results over all cases and over each bucket, six places."""
    mean = [F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit_at_5", "hit_at_10", "ndcg_at_10")]]
    sets = [[*by], *[[*by, b] for b in buckets]]
    return results.groupingSets(sets, *by, *buckets).agg(*mean)
