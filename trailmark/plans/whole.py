"""Edges, benchmark cases, consolidation and the bridge over whole conversations, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import text
from trailmark.operators import benchmark, consolidate, evaluate, graph, modes, recall
from trailmark.plans import palaces, searches
from trailmark.plans.queries import _LEX, _ROLE, _SCEN, _TOKENS, _asked, _like, _read
from trailmark.sources import bridge, sectioned, storage


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as clauses, each conversation a graph of its own."""
    m = palaces._memories(spark, sf_dir).where("kind = 'episodic'")
    rows = m.select(F.floor(F.col("node_id") / 1000).alias("graph_id"), "node_id", "ord", "content")
    return rows.withColumn("role", text.semantic_role(F.col("content"), F.lit("clause")))


def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of later turns with a cue to the earlier ones of their conversation that share two words."""
    return sectioned.semantic_edges(_clauses(spark, sf_dir), "contract").select("src", "dst", "edge_type", "weight", "bidirectional")


_RULE = "case " + " ".join(f"when {_like('low', cues)} then '{kind}'" for kind, cues, _ in sectioned.CONTRACT.rules) + " end"
_EDGES = f"""c as (select conv_id, cast(node_id as bigint) as id, lower(text) as low, list_distinct({_TOKENS}) as t {palaces._FROM_M}), b as (select *, {_RULE} as edge_type, {_ROLE} as role from c),
e as (select l.conv_id, l.id as src, r.id as dst, l.edge_type, 0.7::double as weight, l.edge_type = 'exception_to' as bidirectional, l.role as src_role, r.role as dst_role from b l join b r on r.conv_id = l.conv_id and r.id < l.id and l.edge_type is not null and len(list_intersect(l.t, r.t)) >= 2)"""
SEMANTIC_EDGES = f"with {_EDGES} select src, dst, edge_type, weight, bidirectional from e"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = storage.keep(_clauses(spark, sf_dir), "clauses")
    e = sectioned.semantic_edges(n, "contract").withColumn("ord", F.col("src") * 1000 + F.col("dst") % 1000)
    return n, storage.keep(e, "clause-edges")


def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return graph.contradictions(n, graph.add_reverse(e)).select("left_id", "right_id")


CONTRADICTION_PAIRS = f"with {_EDGES}, x as (select src, dst, src_role as role from e where bidirectional union all select dst, src, dst_role from e where bidirectional) select dst as left_id, src as right_id from x where role = 'exception'"


def contradiction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    t = graph.contradiction_targets(graph.contradictions(n, graph.add_reverse(e)))
    return t.select("node_id", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


CONTRADICTION_TARGETS = f"with {_EDGES}, x as (select src, dst, src_role as role from e where bidirectional union all select dst, src, dst_role from e where bidirectional), p as (select src as a, dst as b from x where role = 'exception'), q as (select a, b from p union select b, a from p) select a as node_id, string_agg(b::varchar, ',' order by b) as targets from q group by a"


def link_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn overrides and, if it is a condition, depends on: the last edge of the kind."""
    n, e = _graph(spark, sf_dir)
    return graph.exception_targets(e, n).select("node_id", "exception_target", "depends_on_target")


LINK_ANNOTATIONS = f"with {_EDGES} select * from (select src as node_id, max(dst) filter (where edge_type = 'exception_to') as exception_target, max(dst) filter (where edge_type = 'depends_on' and src_role = 'condition') as depends_on_target from e group by src) where exception_target is not null or depends_on_target is not null"


def anomaly_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.anomaly_signals(searches._turns(spark, sf_dir)).select("node_id", "severity", "explanation", "rule_id")


ANOMALY_SIGNALS = "with n as (select cast(conv_id * 1000 + turn as bigint) as node_id, case when turn % 3 = 0 then 0.9::double else 0.3::double end as risk, case when turn % 4 = 1 then 0.85::double else 0.25::double end as novelty from conversations where conv_id is not null and turn is not null) select node_id, risk as severity, 'risk threshold exceeded' as explanation, 'risk_threshold' as rule_id from n where risk >= 0.8 union all select node_id, novelty, 'novelty threshold exceeded', 'novelty_threshold' from n where novelty >= 0.8"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question should surface: the turns of a conversation, a path, roles, stops and a contradiction."""
    q = searches._questions(spark, sf_dir)
    at = lambda i: ((F.col("query_id") % 100) * 1000 + i).cast("long")
    shape = lambda mode, *steps: F.struct(F.lit(mode).alias("match_mode"), F.array(*[F.struct(n.alias("node_id"), F.lit(via).cast("string").alias("via_edge_type")) for n, via in steps]).alias("steps"))
    traced = lambda n, hop: F.struct(n.alias("node_id"), F.lit(None).cast("string").alias("edge_type"), F.lit(hop).alias("hop"), F.lit(None).cast("boolean").alias("is_seed"), F.lit(None).cast("string").alias("stopped_reason"))
    i = F.col("query_id")
    return q.select("*", F.array(*[at(j) for j in range(4)]).alias("evidence"), F.lit(1).alias("minimum"), F.when(i % 3 == 0, shape("subsequence", (at(0), None))).when(i % 3 == 1, shape("prefix", (at(1), None))).alias("path"), F.lit("any_path").alias("path_scope"), F.when(i % 2 == 0, F.array(F.lit("exception"))).otherwise(F.array().cast("array<string>")).alias("roles"), F.when(i % 4 == 0, F.array(F.lit("below_threshold"))).otherwise(F.array().cast("array<string>")).alias("stop_reasons"), F.when(i % 5 == 0, F.lit(3)).alias("least_trace"), F.when(i % 5 == 1, F.lit(2)).alias("most_trace"), F.when(i % 3 == 2, F.array(F.array(at(2), at(1)))).otherwise(F.array().cast("array<array<bigint>>")).alias("contradictions"), F.when(i % 7 == 0, F.array(F.lit("legacy_path"))).otherwise(F.array().cast("array<string>")).alias("route_sources"), F.when(i % 7 == 1, F.struct(F.lit("subsequence").alias("match_mode"), F.array(traced(at(0), 0)).alias("steps"))).alias("trace"))


def _reports(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    n, cases = storage.keep(searches._turns(spark, sf_dir), "turns"), _cases(spark, sf_dir)
    links, every = searches._links(n), None
    for name in names:
        found = modes.search_once(searches._questions(spark, sf_dir), n, links, modes.mode(name), searches.K, searches.HOPS)
        rows = benchmark.judge(cases, benchmark.surfaced(found, n, links)).withColumn("mode", F.lit(name))
        every = rows if every is None else every.unionByName(rows)
    return every


_HIT_COLUMNS = ["evidence_hit", "path_hit", "route_hit", "trace_hit", "semantic_hit", "contradiction_hit", "hit"]


def case_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every kind for each question, in the weighted search."""
    rows = _reports(spark, sf_dir, ["weighted_graph_static"])
    return rows.select("query_id", *_HIT_COLUMNS, F.size("matched").cast("long").alias("n_matched"), F.size("missing").cast("long").alias("n_missing"), F.array_join("roles_found", ",").alias("roles"), F.col("activated").cast("long").alias("activated"), F.col("trace_length").cast("long").alias("trace_length"), F.col("best_path_hops").cast("long").alias("best_path_hops"), F.col("best_exception"), F.col("best_contradiction"))


_SEEN = f"""{searches._BASE}, {searches._walk_sql("weighted")}, pt as (select query_id, seed, route as final, chain, len(chain) > 1 and qs and len(list_filter(chain[2:], lambda c: c.v <> 'depends_on')) = 0 as turned from top join qf using (query_id)),
ps as materialized (select query_id, seed, final, case when turned then list_reverse(list_transform(chain, lambda c: c.n)) else list_transform(chain, lambda c: c.n) end as ids from pt),
rt as materialized (select query_id, list_distinct(flatten(list(ids))) as ret, list(ids) as paths from ps group by query_id), bp as materialized (select * from ps qualify row_number() over (partition by query_id order by final desc, seed) = 1),
tc as ({searches.PATH_TRACE[searches.PATH_TRACE.index("hp as (") :].replace("hp as (", "select 1), hp as (", 1).replace(chr(10) + "select query_id, seed, row_number() over", "," + chr(10) + "tz as materialized (select query_id, seed, row_number() over", 1)}),
tb as (select bp.query_id, count(*) as n, list(stopped_reason) filter (where stopped_reason is not null) as stops, list(struct_pack(n := node_id, h := hop)) as steps from bp join tz using (query_id, seed) group by bp.query_id),
cs as (select item_id as query_id, list_transform(generate_series(0, 3), lambda j: item_id % 100 * 1000 + j) as ev, item_id as i from benchmark),
rl as (select rt.query_id, list_sort(list_distinct(list(role))) as roles from rt, unnest(ret) as u(x) join n0 on node_id = x group by rt.query_id),
sg as (select query_id, max(exc)::double as be, max(case when pp.a is not null then 1.0 when inp then 0.45 else 0.0 end)::double as bc from (select query_id, ids[j] as node_id, ids[j - 1] as src from bp, unnest(generate_series(1, len(ids))) as g(j)) z join nd using (node_id) left join (select distinct a, b from pp) pp on pp.a = z.src and pp.b = z.node_id and z.src is not null group by query_id),
h as (select query_id, i, ev, coalesce(ret, []) as ret, coalesce(roles, []) as roles, coalesce(tb.n, 0) as tn, coalesce(stops, []) as stops, coalesce(steps, []) as steps, coalesce(paths, []) as paths, ids, be, bc, (i % 100 * 1000) as base from cs left join rt using (query_id) left join rl using (query_id) left join tb using (query_id) left join bp using (query_id) left join sg using (query_id)),
k as (select *, len(list_intersect(ev, ret)) >= 1 as evidence_hit, case when i % 3 = 0 then len(list_filter(paths, lambda p: list_contains(p, base))) > 0 when i % 3 = 1 then len(list_filter(paths, lambda p: p[1] = base + 1)) > 0 end as path_hit, case when i % 7 = 0 then len(paths) > 0 end as route_hit,
 case when i % 4 = 0 or i % 5 <= 1 or i % 7 = 1 then (i % 4 <> 0 or list_contains(stops, 'below_threshold')) and (i % 5 <> 0 or tn >= 3) and (i % 5 <> 1 or tn <= 2) and (i % 7 <> 1 or len(list_filter(steps, lambda s: s.n = base and s.h = 0)) > 0) end as trace_hit, case when i % 2 = 0 then list_contains(roles, 'exception') end as semantic_hit,
 case when i % 3 = 2 then list_contains(ret, base + 1) and list_contains(ret, base + 2) and (base + 2, base + 1) in (select a, b from pp) end as contradiction_hit from h),
j as materialized (select *, evidence_hit and coalesce(path_hit, true) and coalesce(route_hit, true) and coalesce(trace_hit, true) and coalesce(semantic_hit, true) and coalesce(contradiction_hit, true) as hit from k)"""
CASE_HITS = f"with {_SEEN} select query_id, {', '.join(_HIT_COLUMNS)}, len(list_intersect(ev, ret)) as n_matched, 4 - len(list_intersect(ev, ret)) as n_missing, array_to_string(roles, ',') as roles, len(ret) as activated, tn as trace_length, greatest(0, len(ids) - 1) as best_path_hops, be as best_exception, bc as best_contradiction from j"


def mode_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the hits in the weighted search, over the cases that each applies to."""
    r = benchmark.mode_report(_reports(spark, sf_dir, ["weighted_graph_static"]), ["mode"])
    return r.select("mode", "questions", *[F.round(c, 6).alias(c) for c in ("evidence_hit_rate", "evidence_recall", "path_hit_rate", "trace_hit_rate", "semantic_hit_rate", "contradiction_hit_rate", "space_hit_rate")], *[f"{c}_cases" for c in ("path_hit", "trace_hit", "semantic_hit", "contradiction_hit", "space_hit")], "avg_activated", "avg_best_path_hops", "avg_trace_length")


MODE_REPORT = f"""with {_SEEN} select 'weighted_graph_static' as mode, count(*) as questions, round(avg(evidence_hit::int), 6) as evidence_hit_rate, round(avg(hit::int), 6) as evidence_recall, {", ".join(f"round(coalesce(avg({c}::int), 0), 6) as {c}_rate, count({c}) as {c}_cases" for c in ("path_hit", "trace_hit", "semantic_hit", "contradiction_hit"))}, 0.0::double as space_hit_rate, 0::bigint as space_hit_cases,
 round(avg(len(ret)), 3) as avg_activated, round(avg(greatest(0, len(ids) - 1)), 3) as avg_best_path_hops, round(avg(tn), 3) as avg_trace_length from j"""


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = palaces._memories(spark, sf_dir).where("kind = 'episodic'")
    who = F.array(F.when(F.col("node_id") % 2 == 0, "user").otherwise("assistant"))
    state = F.when(F.col("node_id") % 3 == 0, "active").when(F.col("node_id") % 3 == 1, "stabilizing").otherwise("encoded")
    return storage.keep(m.withColumns({"state": state, "stability": (F.col("node_id") % 5) / 10, "participants": who, "event_type": F.lit("turn"), "importance": F.lit(0.5), "risk": F.lit(0.2), "novelty": F.lit(0.3), "confidence": F.lit(0.9)}), "episodes")


def _consolidated(spark: SparkSession, sf_dir: str) -> consolidate.Consolidated:
    m = _episodes(spark, sf_dir)
    none = m.sparkSession.createDataFrame([], "graph_id long, src long, dst long, edge_type string, weight double")
    return consolidate.consolidate(m, none)


def consolidation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of a scenario and space: of each group of two or more the six best, with the symbolic tags of all of them."""
    g = _consolidated(spark, sf_dir).groups
    return g.select("scenario", "space_id", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"))


def consolidated_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _consolidated(spark, sf_dir).created
    return c.select("node_id", "content", "canonical_form", "state", *[F.round(x, 6).alias(x) for x in ("stability", "decay", "importance", "novelty", "confidence")])


def consolidated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consolidated(spark, sf_dir).links.select("src", "dst", "edge_type", "weight")


_GROUPS = f"""m0 as (select cast(node_id as bigint) as node_id, 's' || (conv_id % {palaces.SPACES}) as space_id, text, lower(text) as low, {_TOKENS} as t, (node_id % 5) / 10 as stab, node_id % 3 as st, case when node_id % 2 = 0 then 'user' else 'assistant' end as who {palaces._FROM_M}),
m1 as (select *, unnest({_SCEN}) as scenario from m0 where st < 2),
m2 as materialized (select *, count(*) over (partition by scenario, space_id) as n, row_number() over (partition by scenario, space_id order by stab desc, node_id) as place from m1 qualify n >= 2 and place <= 6),
g as materialized (select scenario, space_id, list(node_id order by place) as ids, list(text order by place) as texts, count(*) as n, list_sort(list_distinct(list(who))) as people, arg_min(st, place) as st, arg_min(stab, place) as stab, count(*) over (partition by scenario) > 1 as several from m2 group by scenario, space_id),
tt as (select scenario, space_id, term, count(*) as c, min(place * 100000 + i) as f from (select scenario, space_id, place, unnest(t) as term, generate_subscripts(t, 1) as i from m2) where length(term) > 2 and term not in ({", ".join(repr(w) for w in text.STOP)}) group by all),
tm as (select scenario, space_id, string_agg(term, ', ' order by r) as terms from (select *, row_number() over (partition by scenario, space_id order by c desc, f) as r from tt qualify r <= 5) group by all),
nm as (select *, 'semantic:' || array_to_string({palaces._TOK("scenario")}, '_') || case when several then ':' || array_to_string({palaces._TOK("space_id")}, '_') else '' end as name from g left join tm using (scenario, space_id))"""
CONSOLIDATION_GROUPS = f"with {_GROUPS} select scenario, space_id, array_to_string(ids, ',') as source_ids from g"
CONSOLIDATED_MEMORIES = f"""with {_GROUPS}, k as (select * from nm, (values ('summary_memory', 'summary'), ('generalized_rule_memory', 'generalized rule'), ('cross_episode_abstraction', 'cross episode abstraction')) v(kind, said))
select name || ':' || kind as node_id, case kind when 'summary_memory' then 'Summary memory for ' || scenario || ': ' || n || ' related episodes recur around this scenario. Representative episodes: ' || array_to_string(texts[1:2], ' | ')
 when 'generalized_rule_memory' then 'Generalized rule for ' || scenario || ': When this scenario appears, prioritize recurring signals [' || coalesce(terms, '') || '] and account for symbolic tags [none].'
 else 'Cross-episode abstraction for ' || scenario || ': Across ' || n || ' episodes, shared event types are turn and repeated actors are ' || array_to_string(people, ', ') || '. This abstraction links multiple episodes into one stable semantic memory.' end as content,
 scenario || ' ' || said as canonical_form, 'consolidated' as state, greatest(stab, 0.85)::double as stability, 1.0::double as decay, 0.58::double as importance, 0.27::double as novelty, 0.95::double as confidence from k"""
CONSOLIDATED_LINKS = f"""with {_GROUPS}, s as (select name, unnest(ids)::varchar as id from nm)
select distinct * from (select id as src, name || ':summary_memory' as dst, 'part_of' as edge_type, 0.8::double as weight from s union all select name || ':' || k, id, 'recalls', 0.72::double from s, (values ('generalized_rule_memory'), ('cross_episode_abstraction')) v(k)
 union all select name || ':summary_memory', name || ':' || k, 'summarizes', 0.84::double from nm, (values ('generalized_rule_memory'), ('cross_episode_abstraction')) v(k))"""


def palace_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a store's nodes made memories: kinds by type, places and spaces by location."""
    t = searches._turns(spark, sf_dir).drop("space_id")
    place = F.concat_ws("/", F.lit("house"), F.when(F.col("node_id") % 2 == 0, F.lit("upper")), F.when(F.col("node_id") % 6 == 0, F.lit("hall")))
    kind = F.when(F.col("node_id") % 3 == 0, "session_turn").when(F.col("node_id") % 3 == 1, "Route point").otherwise("clause")
    m = bridge.to_memories(t.withColumn("type", kind).withColumn("location", F.when(F.col("node_id") % 5 > 0, place)))
    return m.select("node_id", "kind", "building", "floor", "room", "locus", "space_id", "state", "count")


PALACE_BRIDGE = """with n as (select cast(conv_id * 1000 + turn as bigint) as node_id from conversations where conv_id is not null and turn is not null)
select node_id, case when node_id % 3 = 0 then 'episodic' when node_id % 3 = 1 then 'route' else 'semantic' end as kind, case when node_id % 5 > 0 then 'house' else 'legacy' end as building, case when node_id % 5 > 0 then case when node_id % 2 = 0 then 'upper' end end as floor, case when node_id % 5 > 0 and node_id % 6 = 0 then 'hall' end as room, null::varchar as locus,
 case when node_id % 5 > 0 then concat_ws('/', 'house', case when node_id % 2 = 0 then 'upper' end, case when node_id % 6 = 0 then 'hall' end) else 'legacy' end as space_id, 'encoded' as state, 0::bigint as count from n"""


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = palaces._memories(spark, sf_dir).withColumn("graph_id", F.floor(F.col("node_id") / 1000))
    return benchmark.kind_counts(m)


KIND_COUNTS = "select conv_id as graph_id, count(*)::bigint as episodic, 0::bigint as semantic, 1::bigint as route, 1::bigint as spaces from conversations where conv_id is not null and turn is not null group by conv_id"


def public_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits within 5 and 10 and NDCG of the documents that hold each passage, overall and by what is asked."""
    queries, nodes = _asked(spark, sf_dir)
    ranked, gold = recall.lexical_topk(queries, nodes, 10), storage.keep(evaluate.verbatim_gold(queries, nodes), "gold")
    cases = queries.join(gold.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.concat(F.lit("type "), (F.col("query_id") % 3).cast("string")).alias("type"), F.concat(F.lit("level "), (F.col("query_id") % 2).cast("string")).alias("level"), F.lit("lexical").alias("mode"))
    return benchmark.public_report(benchmark.public_results(ranked, gold, cases), ["mode"], ["type", "level"])


PUBLIC_METRICS = f"""with {_LEX}, r as (select query_id, node_id, row_number() over (partition by query_id order by score desc, node_id) as rank from lex qualify rank <= 10),
g as (select item_id as query_id, doc_id as node_id from benchmark join documents on contains(documents.text, benchmark.text)),
m as (select query_id, count(*) as gold, coalesce(max((rank <= 5)::int), 0) as h5, coalesce(max((rank <= 10)::int), 0) as h10, coalesce(sum(1 / log2(rank + 1)), 0.0) as gain from g left join r using (query_id, node_id) group by query_id),
c as (select query_id, 'lexical' as mode, 'type ' || query_id % 3 as type, 'level ' || query_id % 2 as level, h5, h10, round(gain / list_sum(list_transform(generate_series(1, least(gold, 10)), lambda k: 1 / log2(k + 1))), 6) as ndcg from m)
select mode, type, level, count(*) as cases, round(avg(h5), 6) as hit_at_5, round(avg(h10), 6) as hit_at_10, round(avg(ndcg), 6) as ndcg_at_10 from c group by grouping sets ((mode), (mode, type), (mode, level))"""

_ALL = [semantic_edges, contradiction_pairs, contradiction_targets, link_annotations, anomaly_signals, case_hits, mode_report, consolidation_groups, consolidated_memories, consolidated_links, palace_bridge, kind_counts, public_metrics]
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
