"""Graphs of nodes and edges as tables: storing them, contradictions, features for scoring, seeds for questions.

A nodes table has (graph_id, node_id, ord, content, role, importance, risk, novelty, confidence, usage, decay, state,
stability); an edges table (graph_id, src, dst, ord, edge_type, weight), reverse edges included, ord being the place in
which edges were added.  Questions are (query_id, graph_id, text).  Ties go to the smaller ord everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import cues, scores, text
from trailmark.operators import overlap
from trailmark.sources import storage

#: Words of a question that raise edges of a kind.
DEPENDENCY_WORDS = ["if ", " when ", " after ", "depends", "override", "defective", "recover", "escalate", "who should", "comes after"]
EXCEPTION_WORDS = ["override", "exception", "unless", "except"]
NEXT_WORDS = ["next", "after", "comes after"]
ESCALATION_WORDS = ["escalate", "escalation", "page", "who should"]
SHAPE_WORDS = ["override", "exception", "defective", "if ", "when "]
REMEDY_WORDS = ["recover", "terminate", "damages"]

DEFAULTS = {"role": "", "importance": 0.0, "risk": 0.0, "novelty": 0.0, "confidence": 1.0, "usage": 0, "decay": 1.0, "state": "encoded", "stability": 0.0}


def as_nodes(rows: DataFrame) -> DataFrame:
    """rows with every column of a nodes table: what is missing or null takes the start value of a new node."""
    kinds = {"usage": "long", "role": "string", "state": "string"}
    filled = {c: (F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v)).cast(kinds.get(c, "double")) for c, v in DEFAULTS.items()}
    if "graph_id" not in rows.columns:
        filled["graph_id"] = F.lit(0).cast("long")
    return rows.withColumns(filled)


def upsert(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the last payload by order, at the place of the first."""
    payload = [c for c in rows.columns if c not in (*key, order)]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*payload), order).alias("_p"), F.min(order).alias(order))
    return best.select(*key, order, "_p.*")


def lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes that wanted (graph_id, node_id) names; reading a name that no node has fails."""
    found = wanted.join(nodes, ["graph_id", "node_id"], "left")
    lost = F.raise_error(F.concat(F.lit("no node "), F.col("node_id").cast("string")))
    return found.withColumn("ord", F.when(F.col("ord").isNull(), lost.cast("long")).otherwise(F.col("ord")))


def add_reverse(edges: DataFrame) -> DataFrame:
    """edges and the reverse of bidirectional ones; each stands right after its own edge, as ords are doubled."""
    back = edges.where("bidirectional").withColumns({"src": F.col("dst"), "dst": F.col("src"), "ord": 2 * F.col("ord") + 1})
    return edges.withColumn("ord", 2 * F.col("ord")).unionByName(back)


def insert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """links and those of new whose (src, dst, edge_type) isn't there yet, once each."""
    key = ["src", "dst", "edge_type"]
    return links.unionByName(new.join(links.select(*key), key, "left_anti").dropDuplicates(key).select(*links.columns))


def contradictions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, left_id, right_id): exception_to edges of exceptions (right) to what they override (left)."""
    right = nodes.where("role = 'exception'").select("graph_id", F.col("node_id").alias("src"))
    pairs = edges.where("edge_type = 'exception_to'").join(right, ["graph_id", "src"], "left_semi")
    return pairs.join(nodes.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi").select("graph_id", F.col("dst").alias("left_id"), F.col("src").alias("right_id"))


def contradiction_targets(pairs: DataFrame) -> DataFrame:
    """(graph_id, node_id, targets): the sorted others of each node in a pair."""
    both = pairs.select("graph_id", F.col("left_id").alias("node_id"), F.col("right_id").alias("other")).unionByName(pairs.select("graph_id", F.col("right_id").alias("node_id"), F.col("left_id").alias("other")))
    return both.groupBy("graph_id", "node_id").agg(F.sort_array(F.collect_set("other")).alias("targets"))


def mark_contradictions(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with in_pair and edges with pair: whether a node is in a contradiction, and whether an edge joins its ends."""
    pairs = contradictions(nodes, edges)
    ends = pairs.select("graph_id", F.explode(F.array("left_id", "right_id")).alias("node_id")).distinct()
    sides = F.array(F.struct(F.col("left_id").alias("src"), F.col("right_id").alias("dst")), F.struct(F.col("right_id").alias("src"), F.col("left_id").alias("dst")))
    joined = pairs.select("graph_id", F.inline(sides)).distinct()
    n = nodes.join(ends.withColumn("in_pair", F.lit(True)), ["graph_id", "node_id"], "left").withColumn("in_pair", F.coalesce("in_pair", F.lit(False)))
    e = edges.join(joined.withColumn("pair", F.lit(True)), ["graph_id", "src", "dst"], "left").withColumn("pair", F.coalesce("pair", F.lit(False)))
    return n, e


def exception_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, exception_target, depends_on_target): the last edge of each kind; conditions only depend."""
    role = nodes.select("graph_id", F.col("node_id").alias("src"), "role")
    rows = edges.join(role, ["graph_id", "src"])
    last = lambda kind, only: F.max_by(F.when((F.col("edge_type") == kind) & only, F.col("dst")), F.when((F.col("edge_type") == kind) & only, F.col("ord")))
    out = rows.groupBy("graph_id", F.col("src").alias("node_id")).agg(last("exception_to", F.lit(True)).alias("exception_target"), last("depends_on", F.col("role") == "condition").alias("depends_on_target"))
    return out.where("exception_target is not null or depends_on_target is not null")


def with_features(nodes: DataFrame, dynamic: bool, anomaly: Column | None = None) -> DataFrame:
    """What scoring reads of a node; without dynamic, usage, decay and state count for nothing.  anomaly (1 or 0) stands for the thresholds of risk and novelty."""
    bounded = scores.bounded_weight(F.col("importance"), F.col("risk"), F.col("novelty"), F.col("confidence"))
    own = {
        "weight_score": scores.effective_weight(bounded, F.col("usage"), F.col("decay")) if dynamic else bounded,
        "anomaly": scores.anomalous(F.col("risk"), F.col("novelty")) if anomaly is None else anomaly,
        "exc": scores.exception_score(F.col("role")),
        "role_bonus": scores.activation_bonus(F.col("role")),
        "multiplier": scores.recall_multiplier(F.col("state"), F.col("stability")) if dynamic else F.lit(1.0),
        "factor": scores.clamp(F.col("decay")) if dynamic else F.lit(1.0),
    }
    return nodes.withColumns(own)


def asked(queries: DataFrame) -> DataFrame:
    """Questions with what their wording tells: the flags that edge priorities, alignment and shapes of routes need."""
    low = F.lower("text")
    flags = {"q_depends": DEPENDENCY_WORDS, "q_except": EXCEPTION_WORDS, "q_next": NEXT_WORDS, "q_escalates": ESCALATION_WORDS, "q_shape": SHAPE_WORDS, "q_remedy": REMEDY_WORDS}
    return queries.withColumns({name: text.any_in(low, words) for name, words in flags.items()})


def edge_priority(edge_type: Column) -> Column:
    """How much the question (its flags stand beside) wants an edge of the type."""
    pick = lambda flag, yes, no: F.when(F.col(flag), yes).otherwise(no)
    return F.when(edge_type == "depends_on", pick("q_depends", 3, 2)).when(edge_type == "exception_to", pick("q_except", 2, 1)).when(edge_type == "next_unit", pick("q_next", 1, 0)).otherwise(0)


def contradiction_score(pair: Column, in_pair: Column) -> Column:
    return F.when(pair, 1.0).when(in_pair, 0.45).otherwise(0.0)


def contradiction_bonus(pair: Column, in_pair: Column) -> Column:
    return F.when(pair, 0.14).when(in_pair, 0.06).otherwise(0.0)


def weighted(sem: Column, hop: Column) -> Column:
    """A node's total at a hop; beside it stand its features, pair (of the edge it came by) and q_escalates."""
    aligned = F.when((F.col("role") == "escalation") & F.col("q_escalates"), 1.0).otherwise(0.0)
    contra = contradiction_score(F.coalesce("pair", F.lit(False)), F.col("in_pair"))
    return scores.weighted_total(sem, scores.structural(hop), F.col("anomaly"), F.col("weight_score"), F.col("exc"), contra, aligned, F.col("multiplier"))


def structure_only(sem: Column, hop: Column) -> Column:
    return scores.structure_total(sem, scores.structural(hop))


def weighted_unpaired(sem: Column, hop: Column) -> Column:
    """weighted() where nodes carry no marks of contradictions, as in palaces."""
    aligned = F.when((F.col("role") == "escalation") & F.col("q_escalates"), 1.0).otherwise(0.0)
    return scores.weighted_total(sem, scores.structural(hop), F.col("anomaly"), F.col("weight_score"), F.col("exc"), F.lit(0.0), aligned, F.col("multiplier"))


def similarities(queries: DataFrame, nodes: DataFrame, name: str = "node_id") -> DataFrame:
    """(graph_id, query_id, node_id, cos, lex, sem) of the pairs in a graph that share a bucket; sem is the larger of both.

    Texts are cut into tokens once: postings of (node, token) are counted and shuffled by them, and the buckets, norms
    and overlaps derive from those.  A shared token is a shared bucket, so no overlap is lost.  Postings of one token
    meet all questions with it, and sums are taken before they are shuffled again.
    """
    cut = lambda t, key: t.select("graph_id", key, F.explode(text.tokens(F.col("content" if key == name else "text"))).alias("token")).groupBy("graph_id", key, "token").agg(F.count(F.lit(1)).alias("tf"))
    q, n = cut(queries, "query_id"), cut(nodes, name)
    bucketed = lambda p, key: p.groupBy("graph_id", key, text.bucket(F.col("token")).alias("bucket")).agg(F.sum("tf").alias("tf"))
    qb, nb = bucketed(q, "query_id"), bucketed(n, name)
    of_q = qb.groupBy("graph_id", "query_id").agg(F.sum(F.col("tf") * F.col("tf")).alias("qn")).join(q.groupBy("graph_id", "query_id").agg(F.count(F.lit(1)).alias("words")), ["graph_id", "query_id"])
    of_n = nb.groupBy("graph_id", name).agg(F.sum(F.col("tf") * F.col("tf")).alias("nn"))
    dots = nb.join(qb.withColumnRenamed("tf", "qtf"), ["graph_id", "bucket"]).select("graph_id", "query_id", name, (F.col("tf") * F.col("qtf")).alias("dot"), F.lit(0).cast("long").alias("common"))
    common = n.join(q.select("graph_id", "query_id", "token"), ["graph_id", "token"]).select("graph_id", "query_id", name, F.lit(0).cast("long").alias("dot"), F.lit(1).cast("long").alias("common"))
    rows = dots.unionByName(common).groupBy("graph_id", "query_id", name).agg(F.sum("dot").alias("dot"), F.sum("common").alias("common"))
    rows = rows.join(of_n, ["graph_id", name]).join(of_q, ["graph_id", "query_id"])
    cos = F.round(F.col("dot") / F.sqrt(F.col("qn").cast("double") * F.col("nn")), 9)
    return rows.select("graph_id", "query_id", name, cos.alias("cos"), F.round(F.col("common") / F.col("words"), 9).alias("lex")).withColumn("sem", F.greatest("cos", "lex"))


#: Pairs up to this number go to every executor.
FEW = 100_000


@dataclass(frozen=True)
class Similar:
    """Similarities that are worked out for what is asked, so that no question meets every node in a table; such a table may stand for it wherever sims are taken."""

    queries: DataFrame  # graph_id, query_id, text, each question once
    nodes: DataFrame  # graph_id, node_id, ord, content, each node once

    def best(self, k: int) -> DataFrame:
        """(graph_id, query_id, node_id, ord, cos, lex, sem): rows with the k best of each question by cosine and by overlap, then by ord; nodes that share nothing are 0."""
        found = overlap.nearest(self.queries, self.nodes, k, ["cos", "lex"], False)
        return found.drop("by").withColumn("sem", F.greatest("cos", "lex"))

    def of(self, pairs: DataFrame) -> DataFrame:
        """(graph_id, query_id, node_id, cos, lex, sem) of the pairs (graph_id, query_id, node_id)."""
        asked = storage.keep(pairs.select("graph_id", "query_id", "node_id").distinct(), "pairs")
        return overlap.of_pairs(self.queries, self.nodes.join(few(asked), ["graph_id", "node_id"])).withColumn("sem", F.greatest("cos", "lex"))


def few(stored: DataFrame) -> DataFrame:
    """A stored table that goes to every executor if it has few rows; what Parquet takes on disk doesn't tell what a broadcast takes on the driver."""
    return F.broadcast(stored) if stored.count() <= FEW else stored.hint("merge")


def similar(queries: DataFrame, nodes: DataFrame) -> Similar | DataFrame:
    """What similarities() tells, on demand; nodes need an ord.  Rows of one node are one text; questions whose id stands several times have a table."""
    if overlap.repeated(queries, ["graph_id", "query_id"]) is not None:
        return storage.keep(similarities(queries, nodes), "similarities")
    key, own = ["graph_id", "node_id"], nodes.select("graph_id", "node_id", "ord", "content")
    many = overlap.repeated(nodes, key)
    if many is not None:
        single, twice = overlap.apart(own, many, key)
        own = single.unionByName(twice.groupBy(*key).agg(F.min("ord").alias("ord"), F.array_join(F.collect_list("content"), "\n").alias("content")))
    return Similar(queries.select("graph_id", "query_id", "text"), own)


def similarity_of(sims: DataFrame | Similar, pairs: DataFrame) -> DataFrame:
    """A table with the similarities of the pairs (graph_id, query_id, node_id) at least."""
    return sims.of(pairs) if isinstance(sims, Similar) else sims


def seeds(queries: DataFrame, nodes: DataFrame, sims: DataFrame | Similar, k: int) -> DataFrame:
    """(graph_id, query_id, seed, node_id, similarity): the k best by cosine and the k best by overlap, best first.

    The former count by their cosine, the latter by the larger of both; a node in both lists by the larger score.
    Nodes that share nothing with the question fill the places that are left, by ord.
    """
    first = nodes.select("graph_id", "node_id", "ord").withColumn("_r", F.row_number().over(Window.partitionBy("graph_id").orderBy("ord"))).where(F.col("_r") <= k).drop("_r")
    fill = queries.select("graph_id", "query_id").join(first, "graph_id").select("graph_id", "query_id", "node_id", "ord", *[F.lit(0.0).alias(c) for c in ("cos", "lex", "sem")])
    found = Similar(queries.select("graph_id", "query_id", "text"), sims.nodes).best(k).select(*fill.columns) if isinstance(sims, Similar) else sims.join(nodes.select("graph_id", "node_id", "ord"), ["graph_id", "node_id"]).select(*fill.columns)
    every = found.unionByName(fill).groupBy("graph_id", "query_id", "node_id", "ord").agg(*[F.max(c).alias(c) for c in ("cos", "lex", "sem")])
    rank = lambda c: F.row_number().over(Window.partitionBy("graph_id", "query_id").orderBy(F.desc(c), "ord"))
    few = every.withColumn("e", rank("cos")).withColumn("l", rank("lex")).where((F.col("e") <= k) | (F.col("l") <= k))
    score = F.when(F.col("e") > k, F.col("sem")).when(F.col("l") > k, F.col("cos")).otherwise(F.greatest("cos", "sem"))
    place = F.when(F.col("e") <= k, F.col("e")).otherwise(k + F.col("l"))
    few = few.select("graph_id", "query_id", "node_id", score.alias("similarity"), place.alias("_p"))
    return few.select("graph_id", "query_id", F.row_number().over(Window.partitionBy("graph_id", "query_id").orderBy(F.desc("similarity"), "_p")).cast("long").alias("seed"), "node_id", "similarity")


def surfaced_pairs(pairs: DataFrame, returned: DataFrame) -> DataFrame:
    """(query_id, left_id, right_id) of the contradictions whose both ends were returned: (graph_id, query_id, node_id)."""
    side = lambda c: returned.select("graph_id", "query_id", F.col("node_id").alias(c)).distinct()
    return pairs.join(side("left_id"), ["graph_id", "left_id"]).join(side("right_id"), ["graph_id", "query_id", "right_id"]).select("query_id", "left_id", "right_id").distinct()


def role_alignment(query: Column, role: Column) -> Column:
    """1 if the question asks where something escalates and the node says so."""
    return F.when((role == "escalation") & text.any_in(F.lower(query), ESCALATION_WORDS), 1.0).otherwise(0.0)


def anomaly_signals(nodes: DataFrame, risk: float = 0.8, novelty: float = 0.8) -> DataFrame:
    """(graph_id, node_id, kind, severity, source, explanation, rule_id): a row for each weight at its threshold."""
    rows = [F.when(F.col(c) >= least, F.struct(F.lit("weight_threshold").alias("kind"), F.col(c).alias("severity"), F.lit("memory_weight").alias("source"), F.lit(f"{c} threshold exceeded").alias("explanation"), F.lit(f"{c}_threshold").alias("rule_id"))) for c, least in (("risk", risk), ("novelty", novelty))]
    return nodes.select("graph_id", "node_id", F.inline(F.array_compact(F.array(*rows))))


def encoding(content: Column, role: Column, scenarios: Column | None = None, symbols: Column | None = None) -> dict[str, Column]:
    """phrases, situations, scenario_tags and symbolic_tags of a memory; tags that are given and not empty stand for the inferred."""
    given = lambda own, inferred: inferred if own is None else F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(inferred)
    s, y = given(scenarios, text.scenario_tags(content)), given(symbols, text.symbolic_tags(content, role))
    return {"phrases": cues.trigger_phrases(content, s), "situations": cues.trigger_situations(s, y), "scenario_tags": s, "symbolic_tags": y}


def with_encoding(memories: DataFrame) -> DataFrame:
    """memories with the four arrays of an encoding: the stored ones if any of them has an entry, else built from the content."""
    names = ["phrases", "situations", "scenario_tags", "symbolic_tags"]
    empty = F.array().cast("array<string>")
    stored = memories.withColumns({c: F.coalesce(F.col(c), empty) if c in memories.columns else empty for c in names})
    some = (F.size("phrases") > 0) | (F.size("situations") > 0) | (F.size("scenario_tags") > 0) | (F.size("symbolic_tags") > 0)
    stored = stored.withColumn("_some", some).withColumn("_s", F.when(F.col("_some"), F.col("scenario_tags")).otherwise(text.scenario_tags(F.col("content")))).withColumn("_y", F.when(F.col("_some"), F.col("symbolic_tags")).otherwise(text.symbolic_tags(F.col("content"), F.col("role"))))
    made = {"phrases": cues.trigger_phrases(F.col("content"), F.col("_s")), "situations": cues.trigger_situations(F.col("_s"), F.col("_y"))}
    out = stored.withColumns({c: F.when(F.col("_some"), F.col(c)).otherwise(v) for c, v in made.items()})
    return out.withColumns({"scenario_tags": F.col("_s"), "symbolic_tags": F.col("_y")}).drop("_some", "_s", "_y")
