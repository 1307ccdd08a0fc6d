"""Spaces, seeds, routes and their fusion; order of replayed paths; shapes of expected paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import text
from trailmark.operators import recall


def rank_spaces(queries: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The n spaces whose members' words cover most of each query.  members: (space_id, text).

    Words are made distinct per space before they meet the queries, so a large space costs its vocabulary.
    """
    q = queries.select("query_id", F.array_distinct(text.tokens(F.col("text"))).alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    words = members.where("space_id is not null").select("space_id", F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    hits = words.join(q, "token").groupBy("query_id", "space_id", "n").agg(F.count(F.lit(1)).alias("c")).select("query_id", "space_id", F.round(F.col("c") / F.col("n"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "space_id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def fuse_seeds(queries: DataFrame, nodes: DataFrame, n: int, least: float = 0.1) -> DataFrame:
    """The best max(4n, 16) by cosine and by overlap, joined: 0.6 cosine + 0.4 overlap, or the one there is; the n best of at least ``least``."""
    wide = max(4 * n, 16)
    few = recall.topk(queries, nodes, wide, ["cos", "lex"])
    score = lambda by: F.max(F.when(F.col("by") == by, F.col("score")))
    few = few.groupBy("query_id", "node_id").agg(score("cos").alias("e"), score("lex").alias("l"))
    e, l = F.col("e"), F.col("l")
    both = few.select("query_id", "node_id", F.round(F.coalesce(0.6 * e + 0.4 * l, e, l), 9).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def plan_routes(queries: DataFrame, steps: DataFrame, seeds: DataFrame, k: int, bonus: Column | None = None) -> DataFrame:
    """The k best stored routes of each query.

    steps: (route_id, node_id, text), seeds: (query_id, node_id).  Half the share of a route's nodes that are seeds,
    0.35 of its overlap with the query, 0.1 if a seed is on it, and bonus, up to 1; routes without a score are left out.
    """
    length = steps.groupBy("route_id").agg(F.countDistinct("node_id").alias("n_steps"))
    words = recall.lexical_scores(queries, steps.groupBy("route_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text")).select(F.col("route_id").alias("node_id"), "text")).select("query_id", F.col("node_id").alias("route_id"), F.col("score").alias("lex"))
    hits = steps.select("route_id", "node_id").distinct().join(seeds.select("query_id", "node_id"), "node_id").groupBy("query_id", "route_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = words.join(hits, ["query_id", "route_id"], "full_outer").join(length, "route_id")
    hit, lex = F.coalesce("hits", F.lit(0)), F.coalesce("lex", F.lit(0.0))
    total = 0.5 * hit / F.col("n_steps") + 0.35 * lex + F.when(hit > 0, 0.1).otherwise(0.0) + (F.lit(0.0) if bonus is None else bonus)
    rows = rows.select("query_id", "route_id", F.round(F.least(F.lit(1.0), total), 9).alias("score"), "n_steps").where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("n_steps"), "route_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def fuse(seeds: DataFrame, routes: DataFrame, steps: DataFrame, k: int) -> DataFrame:
    """The k best memories: seeds by their score, and steps of planned routes by the route's score over their place.

    seeds: (query_id, node_id, score); routes: (query_id, route_id, score); steps: (route_id, node_id, place from 1).
    """
    walked = routes.select("query_id", "route_id", "score").join(steps, "route_id").select("query_id", "node_id", F.round(F.col("score") / F.col("place"), 9).alias("score"))
    best = seeds.select("query_id", "node_id", "score").unionByName(walked).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def merge_routes(routes: DataFrame, k: int) -> DataFrame:
    """Of routes (query_id, steps, kind, priority, score) with equal steps and kind the first by priority and score; the k best."""
    same = Window.partitionBy("query_id", "steps", "kind").orderBy(F.desc("priority"), F.desc("score"), *[c for c in routes.columns if c not in ("query_id", "steps", "kind", "priority", "score")])
    best = Window.partitionBy("query_id").orderBy(F.desc("priority"), F.desc("score"), F.desc(F.size("steps")), "steps")
    once = routes.withColumn("_r", F.row_number().over(same)).where("_r = 1").drop("_r")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(1, k))


#: Words of a question that asks where a chain of dependencies leads.
CHAIN_WORDS = ["escalate", "escalation", "page", "who should"]


def replay_order(query: Column, path: Column, edge_types: Column) -> Column:
    """The path, reversed if all of its edges (one or more) are depends_on and the question asks where they lead."""
    turned = (F.size(edge_types) > 0) & F.forall(edge_types, lambda e: e == "depends_on") & text.any_in(F.lower(query), CHAIN_WORDS)
    return F.when(turned, F.reverse(path)).otherwise(path)


def matches(expected: Column, found: Column, how: str) -> Column:
    """Whether expected stands in found: all of it (exact), at its start (prefix), or in order with gaps (subsequence)."""
    if how == "exact":
        return expected == found
    if how == "prefix":
        return (F.size(found) >= F.size(expected)) & (F.slice(found, F.lit(1), F.size(expected)) == expected)
    if how != "subsequence":
        raise ValueError(f"exact, prefix or subsequence, not {how!r}")
    got = F.aggregate(found, F.lit(0), lambda i, x: F.when(F.get(expected, i) == x, i + 1).otherwise(i))
    return got == F.size(expected)
