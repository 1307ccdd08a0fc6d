"""Between memories in spaces (a palace) and plain nodes and edges (a store)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators import graph, palace

#: Kinds of links that a palace knows.
LINK_TYPES = ["next", "part_of", "depends_on", "exception_to", "contradicts", "causes", "recalls", "summarizes", "located_in", "route_to"]


def to_nodes(memories: DataFrame) -> DataFrame:
    """Memories as nodes: the type is the kind, the number of reinforcements the usage; location, state and tags stay as columns."""
    rows = graph.as_nodes(memories)
    rows = rows if "count" in rows.columns else rows.withColumn("count", F.lit(0).cast("long"))
    return rows.withColumns({"type": F.col("kind"), "memory_kind": F.col("kind"), "lifecycle_state": F.col("state"), "usage": F.coalesce("count", F.lit(0)).cast("long"), "location": palace.location_key()})


def to_edges(links: DataFrame) -> DataFrame:
    """Links as edges, each once; graph.add_reverse() brings the reverse of those that go both ways."""
    confidence = F.coalesce("confidence", F.lit(1.0)) if "confidence" in links.columns else F.lit(1.0)
    return links.select("graph_id", "src", "dst", "ord", "edge_type", "weight", confidence.alias("confidence"), "bidirectional")


def to_memories(nodes: DataFrame) -> DataFrame:
    """Nodes as memories: kind by memory_kind or the type's name, place by location, space by space_id, location or legacy-space."""
    rows = graph.as_nodes(nodes)
    has = lambda c, kind="string": F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    low = F.lower(has("type"))
    by_type = F.when(F.contains(low, F.lit("route")), "route").when(F.contains(low, F.lit("session")) | F.contains(low, F.lit("episode")) | F.contains(low, F.lit("event")), "episodic").otherwise("semantic")
    place = palace.parse_location(has("location"))
    made = {"kind": F.coalesce(has("memory_kind"), by_type), **place, "state": F.coalesce(has("lifecycle_state"), F.col("state")), "count": F.coalesce(has("reinforcement_count", "long"), F.col("usage")), "recency": F.coalesce(has("recency", "double"), F.lit(0.0))}
    rows = rows.withColumn("_space", has("space_id")).withColumns(made)
    return rows.withColumn("space_id", F.coalesce("_space", F.when(palace.location_key() != "", palace.location_key()), F.lit("legacy-space"))).drop("_space")


def to_spaces(memories: DataFrame) -> DataFrame:
    """The spaces of memories, each named by its id and placed where its first memory is."""
    first = Window.partitionBy("graph_id", "space_id").orderBy("ord")
    rows = memories.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return rows.select("graph_id", "space_id", "ord", F.col("space_id").alias("name"), "building", "floor", "room", "locus", F.array().cast("array<string>").alias("tags"))


def to_links(edges: DataFrame) -> DataFrame:
    """All directed edges as links.  An edge type that palaces don't know is recalls, next_session is next.

    Edges that go both ways come as two, and both keep the mark, so a way back to a store doubles them again.
    """
    kind = F.when(F.col("edge_type").isin(LINK_TYPES), F.col("edge_type")).when(F.col("edge_type") == "next_session", "next").otherwise("recalls")
    return edges.withColumn("edge_type", kind)
