"""Episodic memories of a scenario and space drawn together into semantic ones, with links between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import scores, text
from trailmark.operators import graph, modes, state

#: The kinds of memories made of a group, with what their canonical form and first alias say.
CONCEPTS = {
    "summary_memory": ("summary", "summary memory"),
    "generalized_rule_memory": ("generalized rule", "generalized rule"),
    "cross_episode_abstraction": ("cross episode abstraction", "cross episode abstraction"),
}
TERMS = 5


@dataclass(frozen=True)
class Policy:
    least: int = 2
    most_sources: int = 6
    states: tuple[str, ...] = ("active", "stabilizing", "consolidated")


@dataclass(frozen=True)
class Consolidated:
    groups: DataFrame
    created: DataFrame
    links: DataFrame
    sources: DataFrame


def key_of(value: Column) -> Column:
    """A name as an id: its stemmed words joined by _, or memory if it has none."""
    words = text.tokens(value)
    return F.when(F.size(words) > 0, F.array_join(words, "_")).otherwise("memory")


def sources(memories: DataFrame, policy: Policy) -> DataFrame:
    """Episodic memories in a state that may be drawn together, a row for each of their scenarios (inferred where none is stated)."""
    rows = graph.as_nodes(memories).where((F.col("kind") == "episodic") & F.col("state").isin(list(policy.states)))
    stated = F.coalesce("scenario_tags", F.array().cast("array<string>")) if "scenario_tags" in rows.columns else F.array().cast("array<string>")
    symbols = F.coalesce("symbolic_tags", F.array().cast("array<string>")) if "symbolic_tags" in rows.columns else F.array().cast("array<string>")
    more = {c: F.col(c) if c in rows.columns else F.lit(v) for c, v in (("emotional", 0.0), ("recency", 0.0), ("event_type", "event"))}
    rows = rows.withColumns(more).withColumn("participants", F.col("participants") if "participants" in rows.columns else F.array().cast("array<string>")).withColumn("_symbols", symbols)
    rows = rows.withColumn("source_path", F.col("source_path") if "source_path" in rows.columns else F.lit(None).cast("string"))
    base = scores.salience(*[F.col(c) for c in ("importance", "risk", "novelty", "confidence", "emotional", "recency")])
    return rows.withColumn("salience", base).withColumn("scenario", F.explode(F.when(F.size(stated) > 0, stated).otherwise(text.scenario_tags(F.col("content")))))


def top_terms(docs: DataFrame, key: list[str], order: list[str], k: int = TERMS) -> DataFrame:
    """key and terms: the k most frequent tokens of over two letters that aren't stop words, the earlier of ties first."""
    t = docs.select(*key, F.struct(*order).alias("_o"), F.posexplode(text.tokens(F.col("content"))).alias("_i", "term")).where((F.length("term") > 2) & ~F.col("term").isin(text.STOP))
    n = t.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_o", "_i")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "_first"))
    few = n.withColumn("_r", rank).where(F.col("_r") <= k)
    return few.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("terms"))


def consolidate(memories: DataFrame, links: DataFrame, policy: Policy = Policy()) -> Consolidated:
    """Groups of a scenario and space of at least two memories, each group's six best by stability, salience and id, and what is made of them.

    created: three semantic memories a group, without those whose id is there already; links: the new ones among part_of
    (source to summary), recalls (rule and abstraction to source) and summarizes; sources: the memories whose state is
    now consolidated.  A group is combined from at most ``most_sources`` rows, whatever its size.
    """
    key = ["graph_id", "scenario", "space_id"]
    rows = sources(memories, policy).withColumn("space_id", F.col("space_id").cast("string"))
    best = Window.partitionBy(*key).orderBy(F.desc("stability"), F.desc("salience"), "node_id")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).withColumn("place", F.row_number().over(best)).where((F.col("_n") >= policy.least) & (F.col("place") <= policy.most_sources))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(c).alias("v")))), lambda x: x["v"])
    mean = lambda c, more=0.0, times=1.0: F.round(F.least(F.lit(1.0), F.avg(c) * times + more), 9)
    symbols = F.collect_list(F.array_distinct("_symbols"))
    shared = F.array_sort(F.aggregate(F.slice(symbols, 2, policy.most_sources), F.get(symbols, F.lit(0)), lambda a, b: F.array_intersect(a, b)))
    groups = rows.groupBy(*key).agg(
        listed("node_id").alias("source_ids"), shared.alias("shared_symbols"), F.count(F.lit(1)).alias("n"), listed("content").alias("_contents"),
        F.array_sort(F.collect_set(F.when(F.col("event_type") != "", F.col("event_type")))).alias("_events"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter("participants", lambda p: p != ""))))).alias("_people"),
        mean("importance", 0.08).alias("importance"), mean("risk").alias("risk"), mean("novelty", times=0.9).alias("novelty"), mean("confidence", 0.05).alias("confidence"), mean("emotional").alias("emotional"), mean("recency").alias("recency"),
        F.array_sort(F.collect_set("source_path")).alias("source_paths"), F.min_by(F.struct("state", F.lit(0).cast("long").alias("count"), "stability", "decay"), "place").alias("_state"), F.min("ord").alias("ord"),
    )
    groups = groups.join(top_terms(rows, key, ["place"]), key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    groups = groups.withColumn("_several", F.count(F.lit(1)).over(Window.partitionBy("graph_id", "scenario")) > 1)
    made = groups.withColumn("concept_type", F.explode(F.array(*[F.lit(c) for c in CONCEPTS])))
    or_else = lambda values, word: F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(word)
    n = F.col("n").cast("string")
    # fixed values: the wording of the three memories
    content = (
        F.when(F.col("concept_type") == "summary_memory", F.concat(F.lit("Summary memory for "), "scenario", F.lit(": "), n, F.lit(" related episodes recur around this scenario. Representative episodes: "), F.array_join(F.slice("_contents", 1, 2), " | ")))
        .when(F.col("concept_type") == "generalized_rule_memory", F.concat(F.lit("Generalized rule for "), "scenario", F.lit(": When this scenario appears, prioritize recurring signals ["), F.array_join("terms", ", "), F.lit("] and account for symbolic tags ["), or_else(F.col("shared_symbols"), "none"), F.lit("].")))
        .otherwise(F.concat(F.lit("Cross-episode abstraction for "), "scenario", F.lit(": Across "), n, F.lit(" episodes, shared event types are "), or_else(F.col("_events"), "event"), F.lit(" and repeated actors are "), or_else(F.col("_people"), "unspecified"), F.lit(". This abstraction links multiple episodes into one stable semantic memory.")))
    )
    name = F.concat_ws(":", F.lit("semantic"), key_of(F.col("scenario")), F.when(F.col("_several"), key_of(F.col("space_id"))), "concept_type")
    form, alias = F.lit(None).cast("string"), F.lit(None).cast("string")
    for concept, (said, first) in CONCEPTS.items():
        form = F.when(F.col("concept_type") == concept, F.concat("scenario", F.lit(f" {said}"))).otherwise(form)
        alias = F.when(F.col("concept_type") == concept, F.lit(first)).otherwise(alias)
    kept = F.col("_kept")
    created = made.withColumns({"node_id": name, "content": content, "kind": F.lit("semantic"), "canonical_form": form, "aliases": F.array(alias, F.col("scenario")), "consolidation_kind": F.col("concept_type"), "scenario_tags": F.array("scenario"), "symbolic_tags": F.col("shared_symbols"), "_kept": state.consolidate(F.col("_state"))})
    created = created.withColumns({"state": kept["state"], "stability": kept["stability"], "decay": kept["decay"], "consolidated_from": F.col("source_ids")})
    columns = ["graph_id", "space_id", "scenario", "concept_type", "node_id", "ord", "content", "kind", "canonical_form", "aliases", "consolidation_kind", "consolidated_from", "source_paths", "scenario_tags", "symbolic_tags", "importance", "risk", "novelty", "confidence", "emotional", "recency", "state", "stability", "decay"]
    created = created.select(*columns)
    link = lambda rows, a, b, kind, weight: rows.select("graph_id", a.cast("string").alias("src"), b.cast("string").alias("dst"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"))
    c, src = F.col, created.select("graph_id", "concept_type", "node_id", F.explode("consolidated_from").alias("source"))
    # a group's three memories, whose ids need the space only where several groups share a scenario
    trio = created.groupBy("graph_id", "scenario", "space_id").pivot("concept_type", list(CONCEPTS)).agg(F.first("node_id"))
    new = link(src.where("concept_type = 'summary_memory'"), c("source"), c("node_id"), "part_of", 0.8)
    new = new.unionByName(link(src.where("concept_type <> 'summary_memory'"), c("node_id"), c("source"), "recalls", 0.72))
    for concept in list(CONCEPTS)[1:]:
        new = new.unionByName(link(trio, c("summary_memory"), c(concept), "summarizes", 0.84))
    there = links.select("graph_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "edge_type").distinct()
    new = new.dropDuplicates(["graph_id", "src", "dst", "edge_type"]).join(there, ["graph_id", "src", "dst", "edge_type"], "left_anti")
    fresh = created.join(memories.select("graph_id", F.col("node_id").cast("string").alias("node_id")), ["graph_id", "node_id"], "left_anti")
    return Consolidated(groups.select(*key, "source_ids", "shared_symbols"), fresh.select(*columns), new, _settled(memories, rows))


def _settled(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """The sources of groups with their state consolidated."""
    own = graph.as_nodes(memories)
    own = own if "count" in own.columns else own.withColumn("count", F.lit(0).cast("long"))
    hit = own.join(rows.select("graph_id", "node_id").distinct(), ["graph_id", "node_id"], "left_semi")
    hit = hit.withColumn("_s", state.consolidate(modes.read_state(hit)))
    return hit.withColumns({c: F.col("_s")[c] for c in ("state", "stability", "decay")}).drop("_s")
