"""Recall from conversation turns as memories in twelve spaces, conversations being stored routes; and parts of it in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import text
from trailmark.operators import graph, palace
from trailmark.plans.queries import _EMB, _LEX, _ROLE, _SCEN, _SYMB, _TOKENS, _like, _read
from trailmark.plans.routing import _ASKED, _ASKS, _PHRASES, _SITUATIONS, _T
from trailmark.sources import storage

WANTS = ["Who should be paged in a payment dispute about defective goods in the harbour?", "What should support restart next to recover during a rollback failure?", "Is there an exception override when an exception applies on the upper floor?", "As it says:"]
#: What the turns say besides their own words, so that they have roles, tags and triggers.
SAYS = ["A payment dispute over defective goods.", "The rollback failure needs a queue drain to recover.", "Unless an exception applies, override it.", "Escalate the incident immediately and page.", "Because it depends on the service.", ""]
FLOORS, ROOMS = ["ground", "upper", "cellar"], ["harbour", "library", "office", "kitchen"]
SPACES, N_SPACES, N_SEEDS = 12, 4, 5


def _choice(values: list[str], i: F.col) -> F.col:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    preferred = F.when(i % 3 == 0, F.array(F.concat(F.lit("s"), (i % SPACES).cast("string")), F.lit("s nowhere"))).otherwise(F.array().cast("array<string>"))
    # every fifth question has no word of any text, so that the fallback decides
    asks = F.when(i % 5 == 4, F.lit("zzyzx")).otherwise(F.concat(_choice(WANTS, i), F.lit(" "), "text"))
    return _read(spark, sf_dir, "benchmark").select(F.lit(0).cast("long").alias("graph_id"), i.alias("query_id"), asks.alias("text"), preferred.alias("preferred"))


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    node = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    content = F.concat(_choice(SAYS, F.col("conv_id") + F.col("turn")), F.lit(" "), F.coalesce("text", F.lit("")))
    rows = t.select(node.alias("node_id"), "conv_id", content.alias("content"), F.lit("episodic").alias("kind"), F.concat(F.lit("s"), (F.col("conv_id") % SPACES).cast("string")).alias("space_id"), F.when(F.col("turn") % 4 == 1, "active").otherwise("encoded").alias("state"), F.lit(0.5).alias("stability"))
    rows = rows.withColumn("role", text.semantic_role(F.col("content"), F.lit("memory"))).withColumns({c: F.lit(None).cast(k) for c, k in (("route_id", "string"), ("start_id", "long"), ("waypoints", "array<long>"), ("route_kind", "string"))})
    routes = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(node)).alias("waypoints"))
    routes = routes.select((F.col("conv_id") * 1000 + 999).cast("long").alias("node_id"), "conv_id", F.lit("").alias("content"), F.lit("route").alias("kind"), F.concat(F.lit("s"), (F.col("conv_id") % SPACES).cast("string")).alias("space_id"), F.lit("encoded").alias("state"), F.lit(0.0).alias("stability"), F.lit("").alias("role"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("route_id"), F.get("waypoints", F.lit(0)).alias("start_id"), "waypoints", _choice(["timeline", "dependency"], F.col("conv_id")).alias("route_kind"))
    return graph.as_nodes(rows.unionByName(routes).withColumn("ord", F.col("node_id")).withColumn("graph_id", F.lit(0).cast("long")))


def _spaces(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(SPACES).select(F.lit(0).cast("long").alias("graph_id"), F.concat(F.lit("s"), i.cast("string")).alias("space_id"), i.alias("ord"), F.concat(F.lit("place "), i.cast("string")).alias("name"), F.lit("house").alias("building"), _choice(FLOORS, i).alias("floor"), _choice(ROOMS, i).alias("room"), F.lit(None).cast("string").alias("locus"), F.array(F.lit("goods"), F.concat(F.lit("tag"), i.cast("string"))).alias("tags"))


def _links(memories: DataFrame) -> DataFrame:
    turns = memories.where("kind = 'episodic'")
    to = lambda n, kind, weight, both, at: F.struct((F.col("node_id") + n).alias("dst"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"), F.lit(both).alias("bidirectional"), (2 * F.col("node_id") + at).alias("ord"))
    rows = turns.select("graph_id", F.col("node_id").alias("src"), F.inline(F.array(to(1, "next", 0.6, True, 0), to(2, "depends_on", 0.9, False, 1))))
    return rows.join(turns.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst", "ord", "edge_type", "weight", "bidirectional")


def palace_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spaces of each question, by words or place, of names or contents; the fallback's where none fits."""
    found = palace.hybrid_spaces(_questions(spark, sf_dir), _spaces(spark), _memories(spark, sf_dir), N_SPACES)
    return found.select("query_id", "space_id", F.round("score", 6).alias("score"), "reason", "rank")


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, m = _questions(spark, sf_dir), storage.keep(_memories(spark, sf_dir), "memories")
    sims = graph.similar(q, m)
    allowed = storage.keep(palace.hybrid_spaces(q, _spaces(spark), m, N_SPACES), "spaces")
    return q, m, palace.hybrid_seeds(palace.candidates(q, m, sims, max(4 * N_SEEDS, 16), True, allowed), N_SEEDS)


def palace_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds in those spaces, by cosine and overlap with triggers, intent and the memory's state."""
    _, _, seeds = _seeded(spark, sf_dir)
    return seeds.select("query_id", "node_id", F.round("score", 6).alias("score"), "reason", F.col("seed").alias("rank"))


def palace_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored conversations planned as routes for those seeds, with the greedy walk beside them."""
    q, m, seeds = _seeded(spark, sf_dir)
    routes = palace.plan_routes(q, m, _links(m), storage.keep(seeds, "seeds"), palace.Policy())
    return routes.select("query_id", "route_id", "route_kind", "route_source", F.array_join(F.col("steps").cast("array<string>"), ">").alias("steps"), F.round("score", 6).alias("score"), "explanation", F.col("place").alias("rank"))


def palace_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole recall: the memories of each question by rank."""
    m = storage.keep(_memories(spark, sf_dir), "memories")
    got = palace.recall(_questions(spark, sf_dir), m, _spaces(spark), _links(m), palace.Policy(max_spaces=N_SPACES))
    return got.memories.select("query_id", "rank", "node_id", F.round("score", 6).alias("score"), "reason", "retrieval_role", "fallback")


def _pick(values: list[str], i: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][cast({i} as bigint) % {len(values)} + 1]"


_QT = f"case when item_id % 5 = 4 then 'zzyzx' else {_pick(WANTS, 'item_id')} || ' ' || text end"
_MT = f"{_pick(SAYS, 'conv_id + turn')} || ' ' || coalesce(text, '')"
_FROM_M = f"from (select conv_id, turn, conv_id * 1000 + turn as node_id, {_MT} as text from conversations where conv_id is not null and turn is not null)"
_SIMS = (_LEX + "," + _EMB).replace("from documents", _FROM_M).replace("doc_id as node_id", "node_id").replace("from benchmark", f"from (select item_id, {_QT} as text from benchmark)")
_TOK = lambda e: _TOKENS.replace("coalesce(text, '')", f"coalesce({e}, '')")
_SPACE = f"""{_SIMS}, sim as (select query_id, node_id, emb.score as cos, coalesce(lex.score, 0) as lx from emb left join lex using (query_id, node_id)),
qq as materialized (select item_id as query_id, {_QT} as text, case when item_id % 3 = 0 then 's' || (item_id % {SPACES}) end as pref from benchmark), qw as (select query_id, text, pref, list_distinct({_TOKENS}) as w from qq),
sp as (select 's' || i as space_id, i as ord, 'place ' || i as name, 'house' as building, {_pick(FLOORS, "i")} as floor, {_pick(ROOMS, "i")} as room, 'tag' || i as tag from generate_series(0, {SPACES - 1}) g(i)),
mm as (select 's' || (conv_id % {SPACES}) as space_id, text {_FROM_M}), bl as (select space_id, list_distinct(flatten(list({_TOKENS}))) as t from mm group by space_id),
pl as (select query_id, pref, space_id, ord, len(w) as n, w, list_distinct({_TOK("name || ' ' || building || ' ' || floor || ' ' || room || ' goods ' || tag")}) as kt, coalesce(t, []) as mt,
 round(least(1.0, case when len(list_intersect(w, {_TOK("building")})) > 0 then 0.35 else 0.0 end + case when len(list_intersect(w, {_TOK("floor")})) > 0 then 0.2 else 0.0 end + case when len(list_intersect(w, {_TOK("room")})) > 0 then 0.35 else 0.0 end
  + case when len(list_intersect(w, {_TOK("'goods ' || tag")})) > 0 then 0.15 else 0.0 end + case when len(list_intersect(w, {_TOK("name")})) > 0 then 0.2 else 0.0 end)::double, 9) as loc from qw, sp left join bl using (space_id)),
kd as (select *, k, round(len(list_intersect(w, case when k = 'keyword' then kt else mt end)) / greatest(n, 1), 9) as lx from pl, (values ('keyword', 0.35), ('metadata', 0.25)) v(k, gain)),
ks as (select query_id, k, space_id, pref, ord, greatest(lx, loc) as sig, least(1.0, greatest(lx, loc) + case when pref = space_id then gain else 0 end)::double as score, case when loc > lx then k || '_space_location_prior' when k = 'keyword' then 'keyword_space_lexical' else 'metadata_space_memory_blob' end as reason, max(greatest(lx, loc)) over (partition by query_id, k) > 0 as heard from kd),
kt as (select query_id, k, space_id, score, reason from ks where heard qualify row_number() over (partition by query_id, k order by score desc, space_id) <= {N_SPACES}
 union all select query_id, k, space_id, {palace.FALLBACK}::double, case when pref is not null then 'fallback_preferred_spaces' else 'fallback_low_confidence_scope' end from ks where not heard qualify row_number() over (partition by query_id, k order by case when pref = space_id then 0 else 1 end, ord) <= {N_SPACES}),
hy as (select query_id, space_id, greatest(coalesce(a.score, b.score), coalesce(b.score, a.score)) as score, case when a.score is null then b.reason when b.score is null or (starts_with(a.reason, 'fallback_') and starts_with(b.reason, 'fallback_')) then a.reason when contains(a.reason, 'location_prior') or contains(b.reason, 'location_prior') then 'hybrid_max(location_prior)' else 'hybrid_max(keyword,metadata)' end as reason
 from (select * from kt where k = 'keyword') a full join (select * from kt where k = 'metadata') b using (query_id, space_id)),
spaces as materialized (select *, row_number() over (partition by query_id order by score desc, space_id) as rank from hy qualify rank <= {N_SPACES})"""
PALACE_SPACES = f"with {_SPACE} select query_id, space_id, round(score, 6) as score, reason, rank from spaces"

_SEEDS = f"""{_SPACE},
m0 as (select node_id, 's' || (conv_id % {SPACES}) as space_id, case when turn % 4 = 1 then least(1.35, 1.2 + least(0.1, 0.12 * 0.5)) else 0.95 end::double as mult, lower(text) as low, {_TOKENS} as t {_FROM_M}), m1 as (select *, {_ROLE} as role from m0), m2 as materialized (select node_id, space_id, mult, role, low, {_SCEN} as scen, {_SYMB} as symb from m1),
m3 as materialized (select node_id, space_id, mult, role, scen, symb, {_PHRASES} as ph, {_SITUATIONS} as si from (select *, low as content from m2)),
q1 as (select query_id, lower(text) as low, {_TOKENS} as t, null::varchar as role from qq), q2 as materialized (select query_id, low as q_low, list_distinct(t) as words, {_SCEN} as q_scen, {_SYMB} as q_symb from q1),
pr as (select query_id, node_id, mult, coalesce(cos, 0)::double as cos, coalesce(lx, 0)::double as lx,
 round(least(1::double, 0.3::double * len(list_filter(ph, lambda p: contains(q_low, p))) + 0.18::double * len(list_filter(si, lambda s: len(list_intersect(list_distinct({_T}), words)) >= 2)) + 0.25::double * len(list_filter(scen, lambda s: len(list_filter({_T}, lambda w: not list_contains(words, w))) = 0)) + 0.12::double * len(list_filter(symb, lambda s: contains(q_low, s)))), 9) as tr,
 round(least(0.45::double, 0.22::double * least(1, len(list_intersect(scen, q_scen))) + 0.08::double * least(2, len(list_intersect(symb, q_symb))) + 0.18::double * {_ASKS}), 9) as it
 from spaces join m3 using (space_id) join q2 using (query_id) left join sim using (query_id, node_id)),
ps as (select query_id, node_id, src, round(least(1::double, least(1::double, case when src = 'e' then cos + 0.2 * tr + 0.25 * it else lx + 0.35 * tr + 0.3 * it end) * mult)::double, 9) as score, case when src = 'e' then 'embedding_cosine' else 'lexical_overlap' end || case when tr > 0 then '+trigger' else '' end || case when it > 0 then '+intent' else '' end as reason from pr, (values ('e'), ('l')) v(src)),
pk as (select * from ps where score >= 0.1 qualify row_number() over (partition by query_id, src order by score desc, node_id) <= {max(4 * N_SEEDS, 16)}),
pf as (select query_id, node_id, round(coalesce(0.6 * a.score + 0.4 * b.score, a.score, b.score)::double, 9) as score, case when a.score is null then b.reason when b.score is null then a.reason when contains(a.reason, 'intent') or contains(b.reason, 'intent') then 'hybrid_embed_lex_trigger_intent' when contains(a.reason, 'trigger') or contains(b.reason, 'trigger') then 'hybrid_embed_lex_trigger' else 'hybrid_embed_lex' end as reason
 from (select * from pk where src = 'e') a full join (select * from pk where src = 'l') b using (query_id, node_id)),
seeds as materialized (select *, row_number() over (partition by query_id order by score desc, node_id) as rank from pf where score >= 0.1 qualify rank <= {N_SEEDS})"""
PALACE_SEEDS = f"with {_SEEDS} select query_id, cast(node_id as bigint) as node_id, round(score, 6) as score, reason, rank from seeds"

PALACE_ROUTES = f"""with recursive {_SEEDS},
c as (select conv_id, turn, cast(node_id as bigint) as node_id, {_TOKENS} as t {_FROM_M}), rt as (select conv_id, list(node_id order by node_id) as steps, list_distinct(flatten(list(t))) as words from c group by conv_id),
qk as (select query_id, {_ASKED} as asked from q2),
sr as (select query_id, 'r' || conv_id as route_id, {_pick(["timeline", "dependency"], "conv_id")} as route_kind, steps, len(list_intersect(steps, sl)) as hits, round(len(list_intersect(w, words)) / len(w), 9) as lx, asked from rt, qw join qk using (query_id) left join (select query_id, list(cast(node_id as bigint)) as sl from seeds group by query_id) using (query_id)),
ss as (select query_id, route_id, route_kind, 'route_memory' as route_source, steps, round(least(1.0, 0.5 * coalesce(hits, 0) / len(steps) + 0.35 * lx + case when hits > 0 then 0.1 else 0 end + case when route_kind = asked then 0.2 else 0 end)::double, 9) as score, array_to_string(list_filter([case when hits > 0 then 'matches current seeds' end, case when lx > 0 then 'matches query content' end, case when route_kind = asked then 'matches query route intent' end], lambda x: x is not null), ', ') as explanation, row_number() over (partition by query_id order by cast(route_id[2:] as bigint)) as o from sr),
lk as (select node_id as src, node_id + 1 as dst, 'next' as kind, 0.6 as w from c union all select node_id + 1, node_id, 'next', 0.6 from c union all select node_id, node_id + 2, 'depends_on', 0.9 from c), le as (select * from lk where src in (select node_id from c) and dst in (select node_id from c)),
bl2 as (select src, pref, arg_min(dst, struct_pack(p := not coalesce(list_contains(case pref when 'timeline' then ['next'] when 'dependency' then ['depends_on', 'part_of', 'causes'] when 'exception' then ['exception_to', 'contradicts'] when 'semantic-summary' then ['summarizes', 'recalls', 'part_of'] else [] end, kind), false), w := -w, d := dst)) as dst from le, (values ('timeline'), ('dependency'), ('exception'), ('semantic-summary'), ('')) v(pref) group by src, pref),
gw as (select query_id, score, coalesce(asked, '') as asked, [cast(node_id as bigint)] as steps, 0 as h from seeds join qk using (query_id) where rank = 1 union all select query_id, score, asked, list_append(steps, dst), h + 1 from gw join bl2 on src = steps[-1] and pref = asked where h < 2 and not list_contains(steps, dst)),
gl as (select * from gw qualify row_number() over (partition by query_id order by h desc) = 1),
lg as (select query_id, 'legacy-path-' || steps[1] as route_id, coalesce(nullif(asked, ''), 'graph_expansion') as route_kind, 'legacy_path' as route_source, steps, score, 'seed-driven graph expansion from ' || steps[1] || case when asked <> '' then ' biased toward ' || asked || ' edges' else '' end as explanation, 4611686018427387904 as o from gl),
al as (select * from ss where score > 0 union all select * from lg where query_id not in (select query_id from ss where score > 0) or (len(steps) > 1 and (query_id, steps) not in (select query_id, steps from ss where score > 0)))
select query_id, route_id, route_kind, route_source, array_to_string(steps, '>') as steps, round(score, 6) as score, explanation, row_number() over (partition by query_id order by score desc, (route_source = 'route_memory')::int desc, len(steps) desc, o) as rank from al qualify rank <= 3"""

_ALL = [palace_spaces, palace_seeds, palace_routes, palace_recall]
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
