"""Greedy walks: one chain from each start, along the best link out of each node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import cues


def _best(kinds: list[str]) -> Column:
    """The best link of a node: of a preferred kind, then strong, then of the smallest target."""
    other = ~F.coalesce(F.col("kind").isin(kinds), F.lit(False)) if kinds else F.lit(True)
    return F.min(F.struct(other.alias("other"), (-F.col("strength")).alias("weak"), F.col("dst").alias("dst"), F.col("kind").alias("kind")))


def greedy_walk(starts: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """(query_id, path, kinds): from each start up to hops links, until a dead end or a node already on the path.

    starts: (query_id, node_id, asked), asked being the kind of route wanted or null; links: (src, dst, kind,
    strength).  The best link of a node is a minimum for each kind of route, so it is combined before the shuffle and a
    node with very many links costs no more than others.  Links without a target or strength are no links.
    """
    routes = {"": [], **cues.ROUTE_EDGES}
    best = links.where("dst is not null and strength is not null").groupBy("src").agg(*[_best(kinds).alias(f"_{i}") for i, kinds in enumerate(routes.values())])
    step = F.col("_0")
    for i, name in enumerate(routes):
        step = F.when(F.col("asked") == name, F.col(f"_{i}")).otherwise(step) if name else step
    best = best.withColumnRenamed("src", "_src")
    rows = starts.select("query_id", "asked", F.array("node_id").alias("path"), F.array().cast("array<string>").alias("kinds"))
    for _ in range(hops):
        rows = rows.join(best, F.element_at("path", -1) == F.col("_src"), "left").withColumn("_to", step)
        on = F.col("_to").isNotNull() & ~F.coalesce(F.array_contains("path", F.col("_to.dst")), F.lit(False))
        rows = rows.select("query_id", "asked", F.when(on, F.concat("path", F.array("_to.dst"))).otherwise(F.col("path")).alias("path"), F.when(on, F.concat("kinds", F.array("_to.kind"))).otherwise(F.col("kinds")).alias("kinds"))
    return rows.drop("asked")
