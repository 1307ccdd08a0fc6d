"""Queries of graph building, planning, fusion and evaluation over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import text
from trailmark.operators import evaluate, plan, recall, state
from trailmark.plans.queries import _EMB, _LEX, _TOKENS, LIFECYCLE_FOLD, _asked, _read
from trailmark.sources import storage


def line_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """next_unit edges between neighbouring lines of each document, both ways."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    d = _read(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n >= 2")
    e = d.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long") - 1)).alias("src")).select("doc_id", "src", (F.col("src") + 1).alias("dst"))
    return recall.both_ways(e.select("*", F.lit("next_unit").alias("edge_type"), F.lit(0.85).alias("weight"), F.lit(True).alias("bidirectional")))


LINE_GRAPH = """with d as (select doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) as n from documents),
e as (select doc_id, unnest(generate_series(cast(1 as bigint), n - 1)) as src from d where n >= 2), u as (select doc_id, src, src + 1 as dst from e union all select doc_id, src + 1, src from e)
select *, 'next_unit' as edge_type, 0.85::double as weight, true as bidirectional from u"""


def seed_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.fuse_seeds(*_asked(spark, sf_dir), 5)


SEED_FUSION = f"""with {_LEX}, {_EMB}, e as (select * from emb qualify row_number() over (partition by query_id order by score desc, node_id) <= 20), l as (select * from lex qualify row_number() over (partition by query_id order by score desc, node_id) <= 20),
f as (select query_id, node_id, round(coalesce(0.6::double * e.score + 0.4::double * l.score, e.score, l.score), 9) as score from e full join l using (query_id, node_id))
select query_id, node_id, score, row_number() over (partition by query_id order by score desc, node_id) as rank from f where score >= 0.1 qualify rank <= 5"""


def space_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents as spaces."""
    return plan.rank_spaces(_asked(spark, sf_dir)[0], _read(spark, sf_dir, "documents").select(F.col("source").alias("space_id"), "text"), 3)


SPACE_RANK = f"""with q as (select item_id as query_id, unnest(list_distinct({_TOKENS})) as token from benchmark), qn as (select query_id, count(*) as n from q group by all),
w as (select distinct source as space_id, unnest({_TOKENS}) as token from documents where source is not null),
s as (select query_id, space_id, round(count(*) / any_value(n), 9) as score from w join q using (token) join qn using (query_id) group by query_id, space_id)
select *, row_number() over (partition by query_id order by score desc, space_id) as rank from s qualify rank <= 3"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("route_id"), F.concat_ws(":", "conv_id", "turn").alias("node_id"), "text", F.row_number().over(w).cast("long").alias("place"))


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    queries, turns = _asked(spark, sf_dir)[0], _turns(spark, sf_dir)
    seeds = recall.lexical_topk(queries, turns.select("node_id", "text"), 5)
    return seeds, turns, plan.plan_routes(queries, turns, seeds, 3)


def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as stored routes of turns, planned for each passage from its five best turns."""
    return _planned(spark, sf_dir)[2].select("query_id", "route_id", "score", F.col("n_steps").cast("long").alias("n_steps"), "rank")


_ROUTES = f"""q as (select item_id as query_id, unnest(list_distinct({_TOKENS})) as token from benchmark), qn as (select query_id, count(*) as n from q group by all),
c as (select conv_id as route_id, conv_id || ':' || turn as node_id, row_number() over (partition by conv_id order by turn) as place, {_TOKENS} as t from conversations),
lt as (select query_id, node_id, any_value(route_id) as route_id, round(count(*) / any_value(n), 9) as score from (select route_id, node_id, unnest(list_distinct(t)) as token from c) join q using (token) join qn using (query_id) group by query_id, node_id),
seeds as (select * from lt qualify row_number() over (partition by query_id order by score desc, node_id) <= 5),
lr as (select query_id, route_id, round(count(*) / any_value(n), 9) as lex from (select distinct route_id, unnest(t) as token from c) join q using (token) join qn using (query_id) group by query_id, route_id),
h as (select query_id, route_id, count(*) as hits from seeds group by all), ln as (select route_id, count(distinct node_id) as n_steps from c group by all),
r as (select query_id, route_id, round(least(1.0, 0.5::double * coalesce(hits, 0) / n_steps + 0.35::double * coalesce(lex, 0) + case when hits > 0 then 0.1::double else 0 end), 9) as score, n_steps from lr full join h using (query_id, route_id) join ln using (route_id)),
routes as (select *, row_number() over (partition by query_id order by score desc, n_steps desc, route_id) as rank from r where score > 0 qualify rank <= 3)"""
ROUTE_PLAN = f"with {_ROUTES} select query_id, route_id, score, n_steps, rank from routes"


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by their own score or by their place on a planned conversation."""
    seeds, turns, routes = _planned(spark, sf_dir)
    return plan.fuse(seeds, routes, turns, 5)


RANK_FUSION = f"""with {_ROUTES}, m as (select query_id, node_id, score from seeds union all select query_id, node_id, round(score / place, 9) from routes join c using (route_id)), b as (select query_id, node_id, max(score) as score from m group by all)
select *, row_number() over (partition by query_id order by score desc, node_id) as rank from b qualify rank <= 5"""


def policy_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lifecycle_fold under the dynamic policy."""
    e = _read(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("touched"))
    return state.fold(e, "user_id", "event_id", "touched", state.policy_reinforce, state.policy_decay)


POLICY_FOLD = LIFECYCLE_FOLD.replace("greatest(0, d - 0.05) <=", "round(greatest(0.5, d * 0.95), 6) - 0.05 <=").replace("least(1, d + 0.02::double)", "least(1, least(1, d + 0.02::double) + 0.02::double)").replace("greatest(0, d - 0.05::double)", "round(greatest(0.5::double, d * 0.95::double), 6) - 0.05::double")


def matched_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, within the ten best, of the documents that hold each passage."""
    queries, nodes = _asked(spark, sf_dir)
    hit = evaluate.verbatim_gold(queries, nodes).join(recall.lexical_topk(queries, nodes, 10), ["query_id", "node_id"])
    return hit.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda x: x.cast("string")), ",").alias("ranks"))


_GOLD = "g as (select item_id as query_id, doc_id as node_id from benchmark join documents on contains(documents.text, benchmark.text))"
MATCHED_RANKS = f"""with {_LEX}, r as (select query_id, node_id, row_number() over (partition by query_id order by score desc, node_id) as rank from lex qualify rank <= 10), {_GOLD}
select query_id, array_to_string(list_sort(list(rank)), ',') as ranks from g join r using (query_id, node_id) group by query_id"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, nodes = _asked(spark, sf_dir)
    modes = {"lexical": "lex", "embedding": "cos"}
    found = recall.topk(queries, nodes, 3, list(modes.values())).select("query_id", "node_id", F.when(F.col("by") == "lex", "lexical").otherwise("embedding").alias("mode"))
    gold = storage.keep(evaluate.verbatim_gold(queries, nodes), "gold")
    hits = gold.join(found, ["query_id", "node_id"]).select("query_id", "mode").distinct()
    return gold.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode")).join(hits.withColumn("hit", F.lit(True)), ["query_id", "mode"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


_HITS = f"""{_LEX}, {_EMB}, l as (select * from lex qualify row_number() over (partition by query_id order by score desc, node_id) <= 3), e as (select * from emb qualify row_number() over (partition by query_id order by score desc, node_id) <= 3), {_GOLD},
hits as (select query_id, unnest(['lexical', 'embedding']) as mode, unnest([bool_or(l.node_id is not null), bool_or(e.node_id is not null)]) as hit from g left join l using (query_id, node_id) left join e using (query_id, node_id) group by query_id)"""


def mode_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per passage which modes find a document that holds it."""
    best = F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("mode")))), ",")
    return _hits(spark, sf_dir).groupBy("query_id").agg(best.alias("best_modes"), (~F.bool_or("hit")).alias("missed_by_all"))


MODE_COMPARE = f"with {_HITS} select query_id, coalesce(string_agg(mode, ',' order by mode) filter (where hit), '') as best_modes, not bool_or(hit) as missed_by_all from hits group by query_id"


def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("mode").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


HIT_RATES = f"with {_HITS} select mode, count(*) as cases, round(avg(case when hit then 1.0::double else 0.0::double end), 6) as hit_rate from hits group by mode"


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent terms of each conversation, of over two letters and no stop word; the earlier of ties first."""
    t = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.tokens(F.col("text"))).alias("i", "term")).where((F.length("term") > 2) & ~F.col("term").isin(text.STOP))
    n = t.groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "i")).alias("_first"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "_first")).cast("long")).where("rank <= 5").drop("_first")


TOP_TERMS = f"""with c as (select conv_id, turn, {_TOKENS} as t from conversations), x as (select conv_id, turn, unnest(t) as term, generate_subscripts(t, 1) as i from c),
n as (select conv_id, term, count(*) as n, min(row(turn, i)) as f from x where length(term) > 2 and term not in ({", ".join(repr(w) for w in text.STOP)}) group by conv_id, term)
select conv_id, term, n, row_number() over (partition by conv_id order by n desc, f) as rank from n qualify rank <= 5"""


def replay_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, customer and nation as a chain of dependencies, replayed for a question made of the order's priority."""
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    asks = F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("Who should handle "), "o_orderkey")).otherwise(F.concat(F.lit("What of "), "o_orderkey"))
    kinds = F.array(F.lit("depends_on"), F.when(F.col("o_orderstatus") == "P", "causes").otherwise("depends_on"))
    path = F.array(*[F.col(x).cast("string") for x in ("o_orderkey", "c_custkey", "c_nationkey")])
    return rows.select("o_orderkey", F.array_join(plan.replay_order(asks, path, kinds), ">").alias("path"), plan.matches(F.array(F.col("o_orderkey").cast("string"), F.col("c_nationkey").cast("string")), plan.replay_order(asks, path, kinds), "subsequence").alias("in_order"))


REPLAY_PATHS = """with r as (select o_orderkey, c_custkey, c_nationkey, starts_with(o_orderpriority, '1') and o_orderstatus <> 'P' as turned from orders join customer on o_custkey = c_custkey)
select o_orderkey, case when turned then c_nationkey || '>' || c_custkey || '>' || o_orderkey else o_orderkey || '>' || c_custkey || '>' || c_nationkey end as path, not turned or c_nationkey = o_orderkey as in_order from r"""

_ALL = [line_graph, seed_fusion, space_rank, route_plan, rank_fusion, policy_fold, matched_ranks, mode_compare, hit_rates, top_terms, replay_paths]
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
