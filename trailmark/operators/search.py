"""Searches of a graph: simple paths and spreading activation from each question's seeds, with traces and answers.

Both expand level by level, which meets nodes in the order of a queue; every row carries its place in that order, so
ties fall as they do when nodes are visited one at a time.  Levels are plain joins, each stored in the shared folder:
so no level is made twice, plans stay short, and a lost executor costs its level at most.

A search returns ``paths`` (one row per seed) and ``trace`` (rows in the order ``step``), both with graph_id, query_id
and seed.  paths: steps (array of node_id, reason, score, via_edge_type), final_score, answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import text
from trailmark.operators import graph
from trailmark.sources import storage

KEY = ["graph_id", "query_id", "seed"]
FEATURES = ["role", "weight_score", "anomaly", "exc", "role_bonus", "multiplier", "factor", "in_pair"]
FLAGS = ["q_depends", "q_except", "q_next", "q_escalates", "q_shape", "q_remedy"]
MOST_TRACED = 5

Total = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Prepared:
    """A graph made ready for one set of questions."""

    nodes: DataFrame  # with features
    edges: DataFrame  # with reverse edges and pair
    asked: DataFrame  # questions with flags
    sims: DataFrame | graph.Similar


@dataclass(frozen=True)
class Found:
    paths: DataFrame
    trace: DataFrame


@dataclass(frozen=True)
class Reach:
    """Where activation may go: nodes (graph_id, node_id, space_id) in the spaces allowed (graph_id, query_id, space_id; None: all)."""

    nodes: DataFrame
    allowed: DataFrame | None = None

    def mark(self, rows: DataFrame, node: str) -> DataFrame:
        """rows with _inside: true for nodes that may be reached, else null."""
        rows = rows.join(self.nodes.select("graph_id", F.col("node_id").alias(node), F.col("space_id").alias("_space"), F.lit(True).alias("_inside")), ["graph_id", node], "left")
        if self.allowed is not None:
            allowed = self.allowed.select("graph_id", "query_id", F.col("space_id").alias("_space"), F.lit(True).alias("_open")).distinct()
            rows = rows.join(allowed, ["graph_id", "query_id", "_space"], "left").withColumn("_inside", F.col("_inside") & F.col("_open")).drop("_open")
        return rows.drop("_space")


@dataclass(frozen=True)
class Propagation:
    """How activation travels: what is left after an edge, the least that does, and which edges it may take (None: all)."""

    decay: float = 0.75
    threshold: float = 0.15
    allowed: tuple[str, ...] | None = None

    def start(self, similarity: Column) -> Column:
        return F.greatest(F.lit(0.0), similarity)

    def bonus(self) -> Column:
        """Added to what arrives, up to 1: beside it stand the edge and its target."""
        return F.when(F.col("edge_type") == "exception_to", 0.12).otherwise(0.0) + F.col("role_bonus") + graph.contradiction_bonus(F.col("pair"), F.col("in_pair"))


def prepare(queries: DataFrame, nodes: DataFrame, edges: DataFrame, dynamic: bool, sims: DataFrame | graph.Similar | None = None, anomaly: Column | None = None) -> Prepared:
    """nodes and edges (each once, with bidirectional) made ready and stored, so that no level makes them again; sims replaces the built-in similarity, anomaly the built-in thresholds."""
    n, e = graph.mark_contradictions(graph.as_nodes(nodes), graph.add_reverse(edges))
    n = storage.keep(graph.with_features(n, dynamic, anomaly), "features")
    return Prepared(n, storage.keep(e, "edges"), graph.asked(queries), graph.similar(queries, n) if sims is None else sims)


def _scored(rows: DataFrame, p: Prepared, total: Total, hop: int) -> DataFrame:
    """rows (KEY, node_id, similarity of seeds, pair, ...) with their node's features and total at the hop."""
    rows = met = storage.keep(rows, "level")
    rows = graph.few(rows).join(p.nodes.select("graph_id", "node_id", *FEATURES), ["graph_id", "node_id"]).join(p.asked.select("graph_id", "query_id", *FLAGS), ["graph_id", "query_id"])
    if hop:
        rows = rows.join(graph.similarity_of(p.sims, met).select("graph_id", "query_id", "node_id", F.col("sem").alias("_sem")), ["graph_id", "query_id", "node_id"], "left").withColumn("sem", F.coalesce("_sem", F.lit(0.0))).drop("_sem")
    else:
        rows = rows.withColumn("sem", F.col("similarity"))
    return rows.withColumn("total", F.round(total(F.col("sem"), F.lit(float(hop))), 9))


def _outbound(p: Prepared) -> DataFrame:
    return p.edges.select("graph_id", "src", "dst", "edge_type", "weight", F.col("ord").alias("eord"), "pair")


def walk_all(p: Prepared, seeds: DataFrame, hops: int, total: Total) -> DataFrame:
    """All simple paths of up to hops edges from the seeds, in queue order.

    KEY, node_id, hop, place (within the hop), total, chain: an array of node_id, score, via, role, prio, reason.
    """
    level = seeds.select(*KEY, "node_id", "similarity", F.lit(1).cast("long").alias("place"), F.lit(None).cast("string").alias("via"), F.lit(0).alias("prio"), F.lit(False).alias("pair"))
    found, chain = [], None
    for hop in range(hops + 1):
        rows = _scored(level, p, total, hop)
        contra = graph.contradiction_score(F.coalesce("pair", F.lit(False)), F.col("in_pair"))
        reason = F.format_string("seed hit semantic=%.3f", F.col("sem")) if hop == 0 else F.format_string(f"expanded at hop {hop} total=%.3f exception=%.3f contradiction=%.3f", F.col("total"), F.col("exc"), contra)
        entry = F.array(F.struct(F.col("node_id"), F.col("total").alias("score"), F.col("via"), F.col("role"), F.col("prio"), reason.alias("reason")))
        rows = rows.withColumn("chain", entry if hop == 0 else F.concat("chain", entry))
        rows = storage.keep(rows.select(*KEY, "node_id", F.lit(hop).alias("hop"), "place", "total", "chain", *FLAGS), "walk")
        found.append(rows.drop(*FLAGS))
        if hop == hops:
            break
        out = rows.select(*KEY, F.col("node_id").alias("src"), F.col("place").alias("_from"), "chain", *FLAGS).join(_outbound(p), ["graph_id", "src"])
        out = out.where(~F.exists("chain", lambda c: c["node_id"] == F.col("dst"))).withColumn("prio", graph.edge_priority(F.col("edge_type")))
        order = Window.partitionBy(*KEY).orderBy("_from", F.desc("prio"), F.desc("weight"), "dst", "eord")
        level = out.select(*KEY, F.col("dst").alias("node_id"), F.row_number().over(order).cast("long").alias("place"), F.col("edge_type").alias("via"), "prio", "pair", "chain")
    return reduce(DataFrame.unionByName, found)


def route_score(chain: Column) -> Column:
    """Mean of the steps' scores, 0.04 of the mean priority of the hops, and what the roles' order adds for the question."""
    n = F.size(chain)
    base = F.aggregate(chain, F.lit(0.0), lambda a, c: a + c["score"]) / n
    hops = F.aggregate(chain, F.lit(0.0), lambda a, c: a + c["prio"]) / F.greatest(n - 1, F.lit(1))
    role = lambda i: F.get(chain, i)["role"]
    last = F.element_at(chain, -1)["role"]
    shaped = F.when((role(F.lit(0)) == "remedy") & (role(F.lit(1)) == "exception"), 0.08).when((role(F.lit(0)) == "obligation") & (role(F.lit(1)) == "exception"), -0.05).otherwise(0.0) + F.when(last == "exception", 0.03).otherwise(0.0)
    bonus = F.when(F.col("q_shape"), shaped).otherwise(0.0) + F.when(F.col("q_remedy") & (last == "remedy"), 0.04).otherwise(0.0)
    return F.round(base + 0.04 * hops + F.when(n > 1, bonus).otherwise(0.0), 9)


def best_states(walked: DataFrame) -> DataFrame:
    """Of each node its best row (the earliest of equal ones), and first: its place among the nodes as they were met."""
    order = F.struct("hop", "place")
    best = F.max_by(F.struct("total", "chain", "hop"), F.struct(F.col("total"), (-F.col("hop")).alias("h"), (-F.col("place")).alias("p")))
    return walked.groupBy(*KEY, "node_id").agg(best.alias("_b"), F.min(order).alias("first")).select(*KEY, "node_id", "_b.*", "first")


def search_paths(p: Prepared, seeds: DataFrame, hops: int = 2, total: Total = graph.weighted) -> Found:
    """The best chain of each seed by route score, then score of its end, then length, then the end met first; another node than the seed if there is one."""
    best = storage.keep(best_states(walk_all(p, seeds, hops, total)), "walk-best").join(p.asked, ["graph_id", "query_id"]).withColumn("route", route_score(F.col("chain")))
    own = F.col("chain")[0]["node_id"] == F.col("node_id")
    order = Window.partitionBy(*KEY).orderBy(own.cast("int"), F.desc("route"), F.desc("total"), F.desc(F.size("chain")), "first")
    top = storage.keep(best.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r"), "walk-top")
    steps = F.transform("chain", lambda c: F.struct(c["node_id"].alias("node_id"), c["reason"].alias("reason"), c["score"].alias("score"), c["via"].alias("via_edge_type")))
    paths = answered(top.select(*KEY, "text", steps.alias("steps"), F.col("route").alias("final_score")), p.nodes)
    return Found(paths, _path_trace(p, top, best, hops))


def _path_trace(p: Prepared, top: DataFrame, states: DataFrame, hops: int) -> DataFrame:
    """The chosen hops, after each the best edge that wasn't taken, and a look ahead; at most MOST_TRACED rows a seed."""
    n = F.size("chain")
    head = top.select(*KEY, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).alias("at"), F.col("chain")[0]["node_id"].alias("node_id"), F.lit(None).cast(p.edges.schema["src"].dataType).alias("source_id"), F.lit(None).cast("string").alias("edge_type"), F.lit(0).alias("hop"), F.col("chain")[0]["score"].alias("incoming"), F.col("chain")[0]["score"].alias("propagated"), F.col("chain")[0]["score"].alias("activated"), F.lit(None).cast("string").alias("stopped_reason"), F.lit(True).alias("is_seed"))
    # every source from which an edge may be left aside: those of the hops, and the end if hops are left
    path = F.transform("chain", lambda c: c["node_id"])
    hop_rows = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.get("chain", i - 1)["node_id"].alias("src"), F.get("chain", i - 1)["score"].alias("from_score"), F.get("chain", i)["node_id"].alias("chosen"), F.get("chain", i)["score"].alias("chosen_score"), F.get("chain", i)["via"].alias("via")))
    at = top.select(*KEY, "text", *FLAGS, n.alias("n"), path.alias("path"), F.inline(hop_rows)).where((F.col("i") < F.col("n")) | (F.col("n") - 1 < hops))
    out = at.join(_outbound(p), ["graph_id", "src"]).withColumn("prio", graph.edge_priority(F.col("edge_type")))
    order = Window.partitionBy(*KEY, "i").orderBy(F.desc("prio"), F.desc("weight"), "dst", "eord")
    out = out.withColumn("r", F.row_number().over(order))
    ahead = out.where("i = n and r = 1").select(*KEY, "i", F.col("dst").alias("next"), F.col("edge_type").alias("next_type"))
    out = out.join(ahead, [*KEY, "i"], "left").withColumn("chosen", F.coalesce("chosen", "next"))
    taken = (F.col("dst") == F.col("chosen")) & (F.col("edge_type") != "next_unit")
    on_path = (F.col("i") < F.col("n")) & F.array_contains("path", F.col("dst")) & (F.col("dst") != F.col("chosen"))
    left = out.where(~taken & ~on_path).groupBy(*KEY, "i", "src", "from_score").agg(F.min_by(F.struct("dst", "edge_type"), "r").alias("_e"))
    score_of = states.select(*KEY, F.col("node_id").alias("dst"), F.col("total").alias("target"))
    left = left.select(*KEY, "i", "src", "from_score", "_e.*").join(score_of, [*KEY, "dst"], "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    half = F.least(0.5 * F.col("from_score"), F.when(F.col("target") > 0, 0.5 * F.col("target")).otherwise(0.25 * F.col("from_score")))
    row = lambda b, node, source, kind, incoming, value, score, stopped: [F.struct(F.col("i").alias("a"), F.lit(b).alias("b")).alias("at"), node.alias("node_id"), source.alias("source_id"), kind.alias("edge_type"), F.col("i").alias("hop"), incoming.alias("incoming"), value.alias("propagated"), score.alias("activated"), F.lit(stopped).cast("string").alias("stopped_reason"), F.lit(False).alias("is_seed")]
    c = F.col
    chosen = at.where("i < n").select(*KEY, *row(0, c("chosen"), c("src"), c("via"), c("from_score"), c("chosen_score"), c("chosen_score"), None))
    stopped = left.select(*KEY, *row(1, c("dst"), c("src"), c("edge_type"), c("from_score"), F.round(half, 9), F.when(c("target") != 0, c("target")), "below_threshold"))
    going = at.join(ahead, [*KEY, "i"]).join(score_of.withColumnRenamed("dst", "next"), [*KEY, "next"], "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    going = going.select(*KEY, *row(0, c("next"), c("src"), c("next_type"), c("from_score"), c("target"), c("target"), None))
    every = reduce(DataFrame.unionByName, [head, chosen, stopped, going])
    step = F.row_number().over(Window.partitionBy(*KEY).orderBy("at"))
    return every.withColumn("step", step).where(F.col("step") <= MOST_TRACED).drop("at")


def spread(p: Prepared, seeds: DataFrame, hops: int = 2, total: Total = graph.weighted, policy: Propagation = Propagation(), most: int = 12, scope: DataFrame | Reach | None = None) -> tuple[DataFrame, DataFrame]:
    """Activation from each seed: the last accepted row of every activated node, and the trace.

    A row is accepted if it exceeds what its node has had; when ``most`` nodes of a seed are active nothing more is.
    Accepted rows push activation * decay * weight over edges in their ord, dropped under the threshold before and
    after the target's factor, then raised by the bonus; edges to nodes that have pushed aren't looked at.  scope:
    (graph_id, query_id, node_id) of the nodes that activation may reach, their spaces (Reach), or None for all.

    nodes: KEY, node_id, activation, score, hop, source_id, via, first.  trace: KEY, step, node_id, source_id,
    edge_type, hop, incoming, propagated, activated, stopped_reason, is_seed.
    """
    ident = p.edges.schema["src"].dataType
    by_node = Window.partitionBy(*KEY, "node_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    by_seed = Window.partitionBy(*KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    level = seeds.select(*KEY, "node_id", "similarity", F.round(policy.start(F.col("similarity")), 9).alias("activation"), F.lit(None).cast(ident).alias("source_id"), F.lit(None).cast("string").alias("via"), F.lit(False).alias("pair"), F.lit(1).cast("long").alias("place")).where("activation > 0")
    if isinstance(scope, Reach):
        level = scope.mark(level, "node_id").where("_inside").select(*level.columns)
    elif scope is not None:
        level = level.join(scope, ["graph_id", "query_id", "node_id"], "left_semi")
    lit = lambda v, kind: F.lit(v).cast(kind)
    traced = [level.select(*KEY, F.struct(lit(0, "int").alias("hop"), lit(0, "long").alias("place"), lit(0, "long").alias("e")).alias("at"), "node_id", "source_id", F.col("via").alias("edge_type"), lit(0, "int").alias("hop"), F.col("activation").alias("incoming"), F.col("activation").alias("propagated"), lit(None, "string").alias("stopped_reason"), F.lit(True).alias("is_seed"))]
    best = pushed_from = None
    found = []
    for hop in range(hops + 1):
        rows = level if best is None else level.join(best, [*KEY, "node_id"], "left")
        carried = F.lit(-1.0) if best is None else F.coalesce("carried", F.lit(-1.0))
        rows = rows.withColumn("_top", F.greatest(F.coalesce(F.max("activation").over(by_node), F.lit(-1.0)), carried)).where(F.col("activation") > F.col("_top"))
        if best is not None:
            active = best.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_active"))
            fresh = F.coalesce(F.sum((F.col("_top") == -1.0).cast("int")).over(by_seed), F.lit(0))
            rows = rows.withColumn("_fresh", fresh).join(active, KEY, "left").where(F.coalesce("_active", F.lit(0)) + F.col("_fresh") < most)
        rows = _scored(rows.select(*level.columns), p, total, hop)
        accepted = storage.keep(rows.select(*KEY, "node_id", "activation", F.least(F.lit(1.0), F.greatest("activation", "total")).alias("score"), F.lit(hop).alias("hop"), "source_id", "via", "place"), "spread-accepted")
        found.append(accepted)
        every = reduce(DataFrame.unionByName, found)
        if hop == hops:
            break
        now = accepted.groupBy(*KEY, "node_id").agg(F.min("place").alias("_visit")).select(*KEY, F.col("node_id").alias("dst"), "_visit")
        out = accepted.select(*KEY, F.col("node_id").alias("src"), "activation", "place").join(_outbound(p), ["graph_id", "src"])
        if pushed_from is not None:
            out = out.join(pushed_from, [*KEY, "dst"], "left_anti")
        out = out.join(now, [*KEY, "dst"], "left").where(F.col("_visit").isNull() | (F.col("_visit") > F.col("place"))).drop("_visit")
        out = out.join(p.nodes.select("graph_id", F.col("node_id").alias("dst"), "factor", "role_bonus", "in_pair"), ["graph_id", "dst"])
        reason, first = F.when(F.lit(False), F.lit("")), F.round(F.col("activation") * policy.decay * F.col("weight"), 9)
        if scope is not None:
            out = scope.mark(out, "dst") if isinstance(scope, Reach) else out.join(scope.select("graph_id", "query_id", F.col("node_id").alias("dst"), F.lit(True).alias("_inside")), ["graph_id", "query_id", "dst"], "left")
            reason = reason.when(F.col("_inside").isNull(), "outside_space_scope")
        if policy.allowed is not None:
            reason = reason.when(~F.col("edge_type").isin(list(policy.allowed)), "disallowed_edge_type")
        out = out.withColumn("_zero", reason).withColumn("_p", first).withColumn("_q", F.round(F.col("_p") * F.col("factor"), 9))
        stopped = F.coalesce("_zero", F.when((F.col("_p") < policy.threshold) | (F.col("_q") < policy.threshold), F.lit("below_threshold")))
        value = F.when(F.col("_zero").isNotNull(), 0.0).when(F.col("_p") < policy.threshold, F.col("_p")).when(F.col("_q") < policy.threshold, F.col("_q")).otherwise(F.round(F.least(F.lit(1.0), F.col("_q") + policy.bonus()), 9))
        out = out.withColumn("stopped_reason", stopped).withColumn("propagated", value)
        out = storage.keep(out.select(*KEY, "src", "dst", "edge_type", "eord", "pair", "place", "activation", "propagated", "stopped_reason"), "spread-pushed")
        traced.append(out.select(*KEY, F.struct(lit(hop + 1, "int").alias("hop"), F.col("place"), F.col("eord").cast("long").alias("e")).alias("at"), F.col("dst").alias("node_id"), F.col("src").alias("source_id"), "edge_type", lit(hop + 1, "int").alias("hop"), F.col("activation").alias("incoming"), "propagated", "stopped_reason", F.lit(False).alias("is_seed")))
        order = Window.partitionBy(*KEY).orderBy("place", "eord")
        level = out.where("stopped_reason is null").select(*KEY, F.col("dst").alias("node_id"), F.col("propagated").alias("activation"), F.col("src").alias("source_id"), F.col("edge_type").alias("via"), "pair", F.row_number().over(order).cast("long").alias("place"))
        visited = now.select(*KEY, "dst")
        pushed_from = visited if pushed_from is None else pushed_from.unionByName(visited)
        best = every.groupBy(*KEY, "node_id").agg(F.max("activation").alias("carried"))
    last = F.max_by(F.struct("activation", "score", "hop", "source_id", "via"), F.struct("hop", "place"))
    nodes = every.groupBy(*KEY, "node_id").agg(last.alias("_l"), F.min(F.struct("hop", "place")).alias("first")).select(*KEY, "node_id", "_l.*", "first")
    # the k-th accepted row of a (node, source, hop) scores the k-th latest of its trace rows, stopped ones included
    same = [*KEY, "node_id", "source_id", "hop"]
    nth = every.withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy("place"))).select(*[F.col(c).alias(f"_{c}") for c in same], "_k", F.col("score").alias("activated"))
    rows = reduce(DataFrame.unionByName, traced).withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("at"))))
    trace = rows.join(nth, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], F.col("_n") == F.col("_k")], "left")
    trace = trace.withColumn("step", F.row_number().over(Window.partitionBy(*KEY).orderBy("at")))
    return nodes, trace.select(*KEY, "step", "node_id", "source_id", "edge_type", "hop", "incoming", "propagated", "activated", "stopped_reason", "is_seed")


def terminals(active: DataFrame, seeds: DataFrame, far: bool) -> DataFrame:
    """The end of each seed's path: the largest score, then activation, then the furthest (far) or the nearest hop, then the node met first; another node than the seed if there is one."""
    own = seeds.select(*KEY, F.col("node_id").alias("start"))
    hop = F.desc("hop") if far else F.asc("hop")
    order = Window.partitionBy(*KEY).orderBy((F.col("node_id") == F.col("start")).cast("int"), F.desc("score"), F.desc("activation"), hop, "first")
    return active.join(own, KEY).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def trace_back(ends: DataFrame, active: DataFrame, hops: int, says: str) -> DataFrame:
    """KEY and steps from the seed to each end, along the nodes that the activation came from."""
    reason = lambda: F.when(F.col("hop") == 0, F.format_string("seed activation=%.3f", F.col("activation"))).otherwise(F.format_string(f"{says} hop=%d activation=%.3f", F.col("hop"), F.col("activation")))
    step = lambda: F.struct(F.col("node_id"), reason().alias("reason"), F.col("score"), F.col("via").alias("via_edge_type"))
    rows = ends.select(*KEY, "start", F.array(step()).alias("steps"), F.when(F.col("node_id") != F.col("start"), F.col("source_id")).alias("_next"))
    before = active.select(*KEY, F.col("node_id").alias("_next"), step().alias("_step"), F.col("source_id").alias("_source"))
    for _ in range(hops):
        rows = rows.join(before, [*KEY, "_next"], "left")
        steps = F.when(F.col("_step").isNotNull(), F.concat(F.array("_step"), "steps")).otherwise(F.col("steps"))
        rows = rows.select(*KEY, "start", steps.alias("steps"), F.when(F.col("_next") != F.col("start"), F.col("_source")).alias("_next"))
    return rows.select(*KEY, "steps")


def search_spreading(p: Prepared, seeds: DataFrame, hops: int = 2, total: Total = graph.weighted, policy: Propagation = Propagation(), most: int = 12) -> Found:
    """The path to the strongest activated node of each seed."""
    active, trace = spread(p, seeds, hops, total, policy, most)
    steps = trace_back(terminals(active, seeds, True), active, hops, "propagated").join(p.asked.select("graph_id", "query_id", "text", "q_escalates"), ["graph_id", "query_id"])
    top = F.aggregate("steps", F.lit(0.0), lambda a, s: F.greatest(a, s["score"]))
    final = F.when(F.col("q_escalates"), F.element_at("steps", -1)["score"]).otherwise(top)
    return Found(answered(steps.select(*KEY, "text", "steps", final.alias("final_score")), p.nodes), trace)


def answered(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths (KEY, text, steps, final_score) replayed: turned round where the question asks where a chain leads, with answer and evidence.

    answer: the contents of the first three steps; evidence: the steps' source_ref, where nodes have one.
    """
    kinds = F.transform(F.slice("steps", F.lit(2), F.greatest(F.size("steps"), F.lit(1))), lambda s: s["via_edge_type"])
    chain = F.forall(kinds, lambda e: F.coalesce(e == "depends_on", F.lit(False)))
    turned = (F.size("steps") > 1) & chain & text.any_in(F.lower("text"), graph.ESCALATION_WORDS)
    back = F.transform(F.reverse("steps"), lambda s, i: F.struct(s["node_id"].alias("node_id"), s["reason"].alias("reason"), s["score"].alias("score"), F.when(i > 0, F.lit("depends_on")).alias("via_edge_type")))
    paths = paths.withColumn("steps", F.when(turned, back).otherwise(F.col("steps")))
    has_ref = "source_ref" in nodes.columns
    own = nodes.select("graph_id", "node_id", "content", *(["source_ref"] if has_ref else []))
    at = paths.select(*KEY, F.posexplode("steps").alias("_i", "_s")).select(*KEY, "_i", F.col("_s.node_id").alias("node_id")).join(own, ["graph_id", "node_id"])
    ordered = lambda c, most: F.transform(F.array_sort(F.collect_list(F.when(F.col("_i") < most, F.struct("_i", F.col(c).alias("v"))))), lambda x: x["v"])
    evidence = [F.array_compact(ordered("source_ref", 1 << 30)).alias("evidence")] if has_ref else []
    told = at.groupBy(*KEY).agg(F.array_join(ordered("content", 3), " | ").alias("answer"), *evidence)
    return paths.join(told, KEY).drop("text")


def best_path(paths: DataFrame) -> DataFrame:
    """Of each question the path with the largest final score, the earlier seed's of equal ones."""
    order = Window.partitionBy("graph_id", "query_id").orderBy(F.desc("final_score"), "seed")
    return paths.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def no_answer(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, answer) of questions without a path."""
    return queries.join(paths.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.concat(F.lit("No evidence path found for query: "), "text").alias("answer"))


def recalled(paths: DataFrame, how: str = "legacy") -> tuple[DataFrame, DataFrame]:
    """The view of a search's paths as recalled memories and routes, paths by final score.

    memories: query_id, rank, node_id, score, reason, retrieval_role (seed or support), a node once, as first seen.
    routes: query_id, route_id, route_kind, route_source, steps (node ids), score.
    """
    order = Window.partitionBy("graph_id", "query_id").orderBy(F.desc("final_score"), "seed")
    ranked = paths.withColumn("_n", F.row_number().over(order) - 1)
    source = f"{how}_path"
    routes = ranked.select("graph_id", "query_id", F.concat(F.lit(f"{how}-route-"), F.col("_n").cast("string")).alias("route_id"), F.lit(source).alias("route_kind"), F.lit(source).alias("route_source"), F.transform("steps", lambda s: s["node_id"]).alias("steps"), F.col("final_score").alias("score"))
    rows = ranked.select("graph_id", "query_id", "_n", F.posexplode("steps").alias("_i", "_s"))
    first = rows.groupBy("graph_id", "query_id", F.col("_s.node_id").alias("node_id")).agg(F.min(F.struct("_n", "_i", F.col("_s.score").alias("score"), F.col("_s.reason").alias("reason"))).alias("_f"))
    place = Window.partitionBy("graph_id", "query_id").orderBy("_f._n", "_f._i")
    memories = first.select("graph_id", "query_id", F.row_number().over(place).cast("long").alias("rank"), "node_id", F.col("_f.score").alias("score"), F.col("_f.reason").alias("reason"), F.when(F.col("_f._i") == 0, "seed").otherwise("support").alias("retrieval_role"))
    return memories, routes


def legacy_paths(memories: DataFrame, routes: DataFrame) -> DataFrame:
    """Recalled routes as paths: only steps that are among the memories, without edge types; routes left without any go."""
    rows = routes.select("graph_id", "query_id", "route_id", F.col("score").alias("final_score"), F.posexplode("steps").alias("_i", "node_id"))
    kept = rows.join(memories.select("graph_id", "query_id", "node_id", "score", "reason"), ["graph_id", "query_id", "node_id"])
    steps = F.transform(F.array_sort(F.collect_list(F.struct("_i", "node_id", "reason", "score"))), lambda s: F.struct(s["node_id"].alias("node_id"), s["reason"].alias("reason"), s["score"].alias("score"), F.lit(None).cast("string").alias("via_edge_type")))
    return kept.groupBy("graph_id", "query_id", "route_id", "final_score").agg(steps.alias("steps"))


def ranked_ids(memories: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, node_id): the k first of the recalled memories, each id once."""
    once = memories.groupBy("graph_id", "query_id", "node_id").agg(F.min("rank").alias("_r"))
    rank = F.row_number().over(Window.partitionBy("graph_id", "query_id").orderBy("_r"))
    return once.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).drop("_r")


def returned_ids(paths: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, node_ids): all ids on paths or among the memories, sorted."""
    rows = paths.select("graph_id", "query_id", F.explode("steps").alias("_s")).select("graph_id", "query_id", F.col("_s.node_id").alias("node_id")).unionByName(memories.select("graph_id", "query_id", "node_id"))
    return rows.groupBy("graph_id", "query_id").agg(F.sort_array(F.collect_set("node_id")).alias("node_ids"))


def top_hits(queries: DataFrame, nodes: DataFrame, sims: DataFrame | graph.Similar, k: int, by: str) -> Found:
    """The two baselines: the k best nodes by overlap (lex) or cosine (cos), each a path of one step; those without a score don't count."""
    label = {"lex": "baseline lexical hit", "cos": "embedding semantic hit"}[by]
    every = sims.best(k).drop("ord").distinct() if isinstance(sims, graph.Similar) else sims
    rows = every.where(F.col(by) > 0).join(nodes.select("graph_id", "node_id", "ord"), ["graph_id", "node_id"])
    rank = F.row_number().over(Window.partitionBy("graph_id", "query_id").orderBy(F.desc(by), "ord"))
    hits = rows.withColumn("seed", rank.cast("long")).where(F.col("seed") <= k)
    step = F.array(F.struct("node_id", F.lit(label).alias("reason"), F.col(by).alias("score"), F.lit(None).cast("string").alias("via_edge_type")))
    paths = hits.select(*KEY, step.alias("steps"), F.col(by).alias("final_score")).join(queries.select("graph_id", "query_id", "text"), ["graph_id", "query_id"])
    ident = nodes.schema["node_id"].dataType
    empty = {"step": "int", "node_id": ident, "source_id": ident, "edge_type": "string", "hop": "int", "incoming": "double", "propagated": "double", "activated": "double", "stopped_reason": "string", "is_seed": "boolean"}
    trace = hits.where("false").select(*KEY, *[F.lit(None).cast(kind).alias(c) for c, kind in empty.items()])
    return Found(answered(paths, nodes), trace)
