"""Searches of a graph of conversation turns for the benchmark's passages, and the same in DuckDB SQL.

The graph has cycles, parallel edges and ties: turns in a row are next_unit both ways, every turn depends on the one
after the next, and turns whose role is exception override the next one, both ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import graph, modes, search
from trailmark.plans.queries import _EMB, _LEX, _like, _read
from trailmark.sources import storage

ROLES = ["obligation", "exception", "remedy", "escalation", "action"]
K, HOPS = 3, 2
#: What is asked besides the passage's own words, so that questions differ in what their wording wants.
WANTS = ["if goods are defective who should escalate", "what comes next after that", "how to recover unless overruled", "as it says"]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wants = F.element_at(F.array(*[F.lit(w) for w in WANTS]), (F.col("item_id") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "benchmark").select(F.lit(0).cast("long").alias("graph_id"), F.col("item_id").alias("query_id"), F.concat(wants, F.lit(" "), "text").alias("text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    node = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("turn") % 5 + 1).cast("int"))
    rows = t.select(F.lit(0).cast("long").alias("graph_id"), node.alias("node_id"), node.alias("ord"), F.coalesce("text", F.lit("")).alias("content"), role.alias("role"), F.col("conv_id").cast("string").alias("space_id"), (0.4 + 0.1 * (F.col("turn") % 5)).alias("importance"), F.when(F.col("turn") % 3 == 0, 0.9).otherwise(0.3).alias("risk"), F.when(F.col("turn") % 4 == 1, 0.85).otherwise(0.25).alias("novelty"), F.lit(0.95).alias("confidence"))
    return graph.as_nodes(rows)


def _links(turns: DataFrame) -> DataFrame:
    to = lambda n, kind, weight, both, at: F.struct((F.col("node_id") + n).alias("dst"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"), F.lit(both).alias("bidirectional"), (3 * F.col("node_id") + at).alias("ord"))
    made = F.array_compact(F.array(to(1, "next_unit", 0.4, True, 0), F.when(F.col("role") == "exception", to(1, "exception_to", 0.9, True, 1)), to(2, "depends_on", 0.7, False, 2)))
    rows = turns.select("graph_id", F.col("node_id").alias("src"), F.inline(made))
    return rows.join(turns.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst", "ord", "edge_type", "weight", "bidirectional")


def _found(spark: SparkSession, sf_dir: str, mode: str) -> search.Found:
    n = _turns(spark, sf_dir)
    return modes.search_once(_questions(spark, sf_dir), n, _links(n), modes.mode(mode), K, HOPS)


def _flat(paths: DataFrame) -> DataFrame:
    told = lambda c: F.array_join(F.transform("steps", lambda s: F.coalesce(s[c].cast("string"), F.lit("-"))), ">")
    return paths.select("query_id", "seed", told("node_id").alias("path"), told("via_edge_type").alias("edges"), F.round("final_score", 6).alias("final_score"))


def graph_search_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_found(spark, sf_dir, "weighted_graph_static").paths)


def graph_search_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_found(spark, sf_dir, "structure_only").paths)


def graph_search_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_found(spark, sf_dir, "activation_spreading_static").paths)


def _trace(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "seed", F.col("step").cast("long").alias("step"), "node_id", "source_id", "edge_type", F.col("hop").cast("long").alias("hop"), *[F.round(c, 6).alias(c) for c in ("incoming", "propagated", "activated")], "stopped_reason")


def path_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(_found(spark, sf_dir, "weighted_graph_static").trace)


def spread_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(_found(spark, sf_dir, "activation_spreading_static").trace)


def recalled_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted search's paths as recalled memories, by rank."""
    memories, _ = search.recalled(_found(spark, sf_dir, "weighted_graph_static").paths)
    return memories.select("query_id", "rank", "node_id", F.round("score", 6).alias("score"), "retrieval_role")


def state_after_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that the spreading search visits reinforced, all others decayed."""
    n = storage.keep(_turns(spark, sf_dir), "turns")
    found = modes.search_once(_questions(spark, sf_dir), n, _links(n), modes.mode("activation_spreading_v1"), K, HOPS)
    after = modes.after_search(n, modes.visited(found.paths), modes.StatePolicy())
    return after.select("node_id", "usage", F.round("decay", 6).alias("decay"), "state", F.round("stability", 6).alias("stability"))


_W = "case item_id % 4 " + " ".join(f"when {i} then '{w} '" for i, w in enumerate(WANTS)) + " end"
_ID = "conv_id * 1000 + turn"
_SIMS = (_LEX + "," + _EMB).replace("from documents", "from conversations where conv_id is not null and turn is not null").replace("doc_id as node_id", f"{_ID} as node_id").replace("from benchmark", f"from (select item_id, {_W} || text as text from benchmark)")
_BASE = f"""{_SIMS}, sim as (select query_id, node_id, emb.score as cos, coalesce(lex.score, 0) as lex, greatest(emb.score, coalesce(lex.score, 0)) as sem from emb left join lex using (query_id, node_id)),
qq as materialized (select item_id as query_id, lower({_W} || text) as low from benchmark),
qf as (select query_id, {_like("low", graph.DEPENDENCY_WORDS)} as qd, {_like("low", graph.EXCEPTION_WORDS)} as qe, {_like("low", graph.NEXT_WORDS)} as qn, {_like("low", graph.ESCALATION_WORDS)} as qs, {_like("low", graph.SHAPE_WORDS)} as qh, {_like("low", graph.REMEDY_WORDS)} as qr from qq),
n0 as (select cast({_ID} as bigint) as node_id, ['{"', '".join(ROLES)}'][turn % 5 + 1] as role, 0.4::double + 0.1::double * (turn % 5) as imp, case when turn % 3 = 0 then 0.9::double else 0.3::double end as risk, case when turn % 4 = 1 then 0.85::double else 0.25::double end as nov from conversations where conv_id is not null and turn is not null),
e0 as (select node_id as src, node_id + 1 as dst, 'next_unit' as kind, 0.4::double as w, true as two, 3 * node_id as o from n0 union all select node_id, node_id + 1, 'exception_to', 0.9::double, true, 3 * node_id + 1 from n0 where role = 'exception' union all select node_id, node_id + 2, 'depends_on', 0.7::double, false, 3 * node_id + 2 from n0),
e1 as (select * from e0 where dst in (select node_id from n0)), e2 as (select src, dst, kind, w, 2 * o as o from e1 union all select dst, src, kind, w, 2 * o + 1 from e1 where two),
pr as (select dst as a, src as b from e2 join n0 on src = node_id where kind = 'exception_to' and role = 'exception'), pp as (select a, b from pr union select b, a from pr),
e as (select e2.*, a is not null as pair from e2 left join pp on src = a and dst = b),
nd as (select node_id, role, greatest(0, least(1, 0.35 * imp + 0.35 * risk + 0.15 * nov + 0.15 * 0.95::double)) as wt, case when risk >= 0.8 or nov >= 0.8 then 1.0 else 0.0 end as anom, case when role = 'exception' then 1.0 when role in ('remedy', 'escalation') then 0.45 else 0.0 end as exc, case when role = 'exception' then 0.15 when role in ('remedy', 'escalation') then 0.08 else 0.0 end as rb, node_id in (select a from pp) as inp from n0),
ev as (select query_id, node_id, cos, lex, sem from sim union all select query_id, node_id, 0, 0, 0 from qq, (select node_id from nd order by node_id limit {K}) where (query_id, node_id) not in (select query_id, node_id from sim)),
rk as (select *, row_number() over (partition by query_id order by cos desc, node_id) as re, row_number() over (partition by query_id order by lex desc, node_id) as rl from ev),
sd as (select query_id, node_id, case when re > {K} then sem when rl > {K} then cos else greatest(cos, sem) end as s, case when re <= {K} then re else {K} + rl end as p from rk where re <= {K} or rl <= {K}),
seeds as materialized (select query_id, row_number() over (partition by query_id order by s desc, p) as seed, node_id, s::double as s from sd)"""

_PRIO = "case when kind = 'depends_on' then case when qd then 3 else 2 end when kind = 'exception_to' then case when qe then 2 else 1 end when kind = 'next_unit' then case when qn then 1 else 0 end else 0 end"
_TOTALS = {
    "weighted": "round((0.45 * sem + 0.15 * greatest(0, 1 - 0.25 * {hop}) + sem * (0.15 * anom + 0.1 * wt + 0.075 * exc + 0.075 * case when pair then 1.0 when inp then 0.45 else 0.0 end + 0.12 * case when qs and role = 'escalation' then 1.0 else 0.0 end))::double, 9)",
    "structure": "round((0.45 * sem + 0.15 * greatest(0, 1 - 0.25 * {hop}))::double, 9)",
}


def _walk_sql(total: str) -> str:
    """All simple paths, their best rows and the chosen ones as CTEs."""
    of = _TOTALS[total]
    entry = "struct_pack(n := x.node_id, s := {t}, v := {v}, r := role, p := {p})"
    inner = "select s.query_id, s.seed, s.node_id, n.role, " + of.format(hop=0).replace("sem", "s.s").replace("pair", "false")
    out = f"l0 as materialized (select query_id, seed, node_id, 0 as hop, 1 as place, t, [{entry.format(t='t', v='null::varchar', p='0')}] as chain from ({inner} as t from seeds s join nd n using (node_id) join qf using (query_id)) x)"
    for hop in range(1, HOPS + 1):
        out += f""",
m{hop} as (select l.query_id, l.seed, l.place as f, l.chain, e.dst as node_id, e.kind, e.w, e.o, e.pair, {_PRIO} as prio from l{hop - 1} l join e on e.src = l.node_id join qf using (query_id) where not list_contains(list_transform(l.chain, lambda c: c.n), e.dst)),
k{hop} as (select *, row_number() over (partition by query_id, seed order by f, prio desc, w desc, node_id, o) as place from m{hop}),
t{hop} as (select k.query_id, k.seed, k.node_id, k.place, k.chain, k.kind, k.prio, role, {of.format(hop=hop).replace("sem", "coalesce(sem, 0)")} as t from k{hop} k join nd n using (node_id) join qf using (query_id) left join sim using (query_id, node_id)),
l{hop} as materialized (select query_id, seed, node_id, {hop} as hop, place, t, list_append(chain, {entry.format(t="t", v="kind", p="prio")}) as chain from t{hop} x)"""
    out += f""",
every as ({" union all ".join(f"select * from l{h}" for h in range(HOPS + 1))}),
best as materialized (select *, min(hop * 100000000 + place) over (partition by query_id, seed, node_id) as first from every qualify row_number() over (partition by query_id, seed, node_id order by t desc, hop, place) = 1),
sc as (select best.*, round((list_sum(list_transform(chain, lambda c: c.s)) / len(chain) + 0.04 * list_sum(list_transform(chain, lambda c: c.p)) / greatest(len(chain) - 1, 1) + case when len(chain) > 1 then
 case when qh then case when chain[1].r = 'remedy' and chain[2].r = 'exception' then 0.08 when chain[1].r = 'obligation' and chain[2].r = 'exception' then -0.05 else 0.0 end + case when chain[-1].r = 'exception' then 0.03 else 0.0 end else 0.0 end + case when qr and chain[-1].r = 'remedy' then 0.04 else 0.0 end else 0.0 end)::double, 9) as route from best join qf using (query_id)),
top as materialized (select * from sc qualify row_number() over (partition by query_id, seed order by (chain[1].n = node_id)::int, route desc, t desc, len(chain) desc, first) = 1)"""
    return out


# turned round where all hops are depends_on and the question asks where a chain leads
_REPLAY = """rp as (select query_id, seed, final, case when turned then list_reverse(ids) else ids end as ids, case when turned then list_concat(['-'], list_transform(ids[2:], lambda x: 'depends_on')) else vias end as vias
 from (select *, len(ids) > 1 and qs and len(list_filter(vias[2:], lambda v: v <> 'depends_on')) = 0 as turned from pt join qf using (query_id)))
select query_id, seed, array_to_string(ids, '>') as path, array_to_string(vias, '>') as edges, round(final, 6) as final_score from rp"""
_PATHS = "pt as (select query_id, seed, route as final, list_transform(chain, lambda c: c.n) as ids, list_transform(chain, lambda c: coalesce(c.v, '-')) as vias from top)"
GRAPH_SEARCH_WEIGHTED = f"with {_BASE}, {_walk_sql('weighted')}, {_PATHS}, {_REPLAY}"
GRAPH_SEARCH_STRUCTURE = f"with {_BASE}, {_walk_sql('structure')}, {_PATHS}, {_REPLAY}"

PATH_TRACE = f"""with {_BASE}, {_walk_sql("weighted")},
hp as (select query_id, seed, chain, len(chain) as len, i, chain[i].n as src, chain[i].s as fs, chain[i + 1].n as chosen, chain[i + 1].s as cs, chain[i + 1].v as via from top, unnest(generate_series(1, len(chain))) as g(i) where i < len(chain) or len(chain) - 1 < {HOPS}),
ob as (select hp.*, e.dst, e.kind, row_number() over (partition by query_id, seed, i order by {_PRIO} desc, e.w desc, e.dst, e.o) as r from hp join e on e.src = hp.src join qf using (query_id)),
ah as (select query_id, seed, i, dst as nx, kind as nk from ob where i = len and r = 1),
oc as (select ob.* exclude (chosen), coalesce(chosen, nx) as chosen from ob left join ah using (query_id, seed, i)),
lf as (select query_id, seed, i, src, fs, dst, kind from oc where not (dst = chosen and kind <> 'next_unit') and not (i < len and list_contains(list_transform(chain, lambda c: c.n), dst) and dst <> chosen) qualify row_number() over (partition by query_id, seed, i order by r) = 1),
lt as (select lf.*, coalesce(b.t, 0)::double as tg from lf left join best b on b.query_id = lf.query_id and b.seed = lf.seed and b.node_id = lf.dst),
tr as (select query_id, seed, 0 as a, 0 as b, chain[1].n as node_id, null::bigint as source_id, null::varchar as edge_type, 0 as hop, chain[1].s as incoming, chain[1].s as propagated, chain[1].s as activated, null::varchar as stopped_reason from top
 union all select query_id, seed, i, 0, chosen, src, via, i, fs, cs, cs, null from hp where i < len
 union all select query_id, seed, i, 1, dst, src, kind, i, fs, round(least(0.5 * fs, case when tg > 0 then 0.5 * tg else 0.25 * fs end), 9), case when tg <> 0 then tg end, 'below_threshold' from lt
 union all select hp.query_id, hp.seed, hp.i, 0, nx, src, nk, hp.i, fs, coalesce(b.t, 0), coalesce(b.t, 0), null from hp join ah using (query_id, seed, i) left join best b on b.query_id = hp.query_id and b.seed = hp.seed and b.node_id = nx)
select query_id, seed, row_number() over (partition by query_id, seed order by a, b) as step, node_id, source_id, edge_type, cast(hop as bigint) as hop, round(incoming, 6) as incoming, round(propagated, 6) as propagated, round(activated, 6) as activated, stopped_reason from tr qualify step <= {search.MOST_TRACED}"""

RECALLED_MEMORIES = f"""with {_BASE}, {_walk_sql("weighted")}, pt as (select query_id, seed, route as final, chain, len(chain) > 1 and qs and len(list_filter(chain[2:], lambda c: c.v <> 'depends_on')) = 0 as turned from top join qf using (query_id)),
rn as (select *, row_number() over (partition by query_id order by final desc, seed) as pn from (select query_id, seed, final, case when turned then list_reverse(chain) else chain end as chain from pt)),
st as (select query_id, pn, i, chain[i].n as node_id, chain[i].s as score from rn, unnest(generate_series(1, len(chain))) as g(i)),
fr as (select * from st qualify row_number() over (partition by query_id, node_id order by pn, i) = 1)
select query_id, row_number() over (partition by query_id order by pn, i) as rank, node_id, round(score, 6) as score, case when i = 1 then 'seed' else 'support' end as retrieval_role from fr"""


def _spread_sql(total: str = "weighted", decay: float = 0.75, threshold: float = 0.15, most: int = 12) -> str:
    """Levels of activation as CTEs, with the last accepted row of each node (an) and the trace's rows (tr)."""
    of = _TOTALS[total]
    out = "r0 as (select query_id, seed, node_id, round(s, 9) as act, null::bigint as source_id, null::varchar as via, false as pair, 1 as place from seeds where s > 0)"
    for hop in range(HOPS + 1):
        sem = "s.s" if hop == 0 else "coalesce(sim.sem, 0)"
        scored = of.format(hop=hop).replace("sem", sem)
        join = "join seeds s on s.query_id = x.query_id and s.seed = x.seed and s.node_id = x.node_id" if hop == 0 else "left join sim on sim.query_id = x.query_id and sim.node_id = x.node_id"
        before = "" if hop == 0 else " left join (select query_id, seed, node_id, max(act) as had from (" + " union all ".join(f"select query_id, seed, node_id, act from a{h}" for h in range(hop)) + ") group by all) b using (query_id, seed, node_id)"
        count = "" if hop == 0 else " left join (select query_id, seed, count(distinct node_id) as c from (" + " union all ".join(f"select query_id, seed, node_id from a{h}" for h in range(hop)) + ") group by all) d using (query_id, seed)"
        had, c = ("-1.0", "0") if hop == 0 else ("coalesce(had, -1.0)", "coalesce(c, 0)")
        out += f""",
x{hop} as (select * from (select r{hop}.*, greatest(coalesce(max(act) over (partition by query_id, seed, node_id order by place rows between unbounded preceding and 1 preceding), -1.0), {had}) as top, {c} as c from r{hop}{before}{count}) where act > top),
y{hop} as (select * from (select *, c + coalesce(sum(case when top = -1.0 then 1 else 0 end) over (partition by query_id, seed order by place rows between unbounded preceding and 1 preceding), 0) as b4 from x{hop}) where b4 < {most}),
a{hop} as materialized (select x.query_id, x.seed, x.node_id, x.act, least(1.0, greatest(x.act, {scored.replace("pair", "x.pair")}))::double as score, {hop} as hop, x.source_id, x.via, x.place from y{hop} x join nd n on n.node_id = x.node_id join qf on qf.query_id = x.query_id {join})"""
        if hop == HOPS:
            break
        gone = "" if hop == 0 else " and (a.query_id, a.seed, e.dst) not in (" + " union all ".join(f"select query_id, seed, node_id from a{h}" for h in range(hop)) + ")"
        out += f""",
v{hop} as (select query_id, seed, node_id as dst, min(place) as visit from a{hop} group by all),
o{hop} as materialized (select a.query_id, a.seed, a.node_id as src, e.dst, e.kind, e.o, e.pair, a.place, a.act, round(a.act * {decay} * e.w, 9)::double as p, rb, inp from a{hop} a join e on e.src = a.node_id join nd n on n.node_id = e.dst left join v{hop} v on v.query_id = a.query_id and v.seed = a.seed and v.dst = e.dst where (visit is null or visit > a.place){gone}),
u{hop} as (select *, p < {threshold} as stopped, case when p < {threshold} then p else round(least(1.0, p + case when kind = 'exception_to' then 0.12 else 0.0 end + rb + case when pair then 0.14 when inp then 0.06 else 0.0 end), 9) end::double as v from o{hop}),
r{hop + 1} as (select query_id, seed, dst as node_id, v as act, src as source_id, kind as via, pair, row_number() over (partition by query_id, seed order by place, o) as place from u{hop} where not stopped)"""
    every = " union all ".join(f"select * from a{h}" for h in range(HOPS + 1))
    out += f""",
ea as materialized ({every}), an as materialized (select *, min(hop * 100000000 + place) over (partition by query_id, seed, node_id) as first from ea qualify row_number() over (partition by query_id, seed, node_id order by hop desc, place desc) = 1)"""
    return out


_SPREAD_PATHS = """se as (select query_id, seed, node_id as start from seeds where s > 0), tm as (select an.*, start from an join se using (query_id, seed) qualify row_number() over (partition by query_id, seed order by (node_id = start)::int, score desc, act desc, hop desc, first) = 1),
b1 as (select tm.query_id, tm.seed, start, [struct_pack(n := tm.node_id, s := tm.score, v := coalesce(tm.via, '-'))] as ch, case when tm.node_id <> start then tm.source_id end as nx from tm),
b2 as (select b1.query_id, b1.seed, start, case when an.node_id is not null then list_prepend(struct_pack(n := an.node_id, s := an.score, v := coalesce(an.via, '-')), ch) else ch end as ch, case when nx <> start then an.source_id end as nx from b1 left join an on an.query_id = b1.query_id and an.seed = b1.seed and an.node_id = nx),
b3 as (select b2.query_id, b2.seed, start, case when an.node_id is not null then list_prepend(struct_pack(n := an.node_id, s := an.score, v := coalesce(an.via, '-')), ch) else ch end as ch from b2 left join an on an.query_id = b2.query_id and an.seed = b2.seed and an.node_id = nx),
pt as (select query_id, seed, case when qs then ch[-1].s else list_max(list_transform(ch, lambda c: c.s)) end as final, list_transform(ch, lambda c: c.n) as ids, list_transform(ch, lambda c: c.v) as vias from b3 join qf using (query_id))"""
GRAPH_SEARCH_SPREAD = f"with {_BASE}, {_spread_sql()}, {_SPREAD_PATHS}, {_REPLAY}"

SPREAD_TRACE = f"""with {_BASE}, {_spread_sql()},
tr as (select query_id, seed, 0 as h, 0 as pl, 0 as o, node_id, source_id, via as edge_type, act as incoming, act as propagated, null::varchar as stopped_reason from r0
 {" ".join(f"union all select query_id, seed, {h + 1}, place, o, dst, src, kind, act, v, case when stopped then 'below_threshold' end from u{h}" for h in range(HOPS))}),
tn as (select *, row_number() over (partition by query_id, seed, node_id, source_id, h order by pl desc, o desc) as nth from tr),
ak as (select *, row_number() over (partition by query_id, seed, node_id, source_id, hop order by place) as k from ea)
select t.query_id, t.seed, row_number() over (partition by t.query_id, t.seed order by h, pl, o) as step, t.node_id, t.source_id, edge_type, cast(h as bigint) as hop, round(incoming, 6) as incoming, round(propagated, 6) as propagated, round(score, 6) as activated, stopped_reason
from tn t left join ak on ak.query_id = t.query_id and ak.seed = t.seed and ak.node_id = t.node_id and ak.source_id is not distinct from t.source_id and ak.hop = t.h and ak.k = t.nth"""

# new nodes have used 0, decay 1 and state encoded, so the multiplier is 0.95 and the other factors are 1
STATE_AFTER_SEARCH = f"""with {_BASE}, {_spread_sql("weighted")}, {_SPREAD_PATHS}, vs as (select distinct unnest(ids) as node_id from pt)
select node_id, case when v.node_id is not null then 1 else 0 end::bigint as usage, case when v.node_id is not null then 1.0 else 0.9 end::double as decay, case when v.node_id is not null then 'active' else 'encoded' end as state, case when v.node_id is not null then 0.2 else 0.0 end::double as stability from nd left join vs v using (node_id)""".replace("0.12 * case when qs and role = 'escalation' then 1.0 else 0.0 end))::double, 9)", "0.12 * case when qs and role = 'escalation' then 1.0 else 0.0 end)) * 0.95::double, 9)")

_ALL = [graph_search_weighted, graph_search_structure, graph_search_spread, path_trace, spread_trace, recalled_memories, state_after_search]
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
