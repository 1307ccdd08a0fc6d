"""The recall engine's queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import scores, text
from trailmark.operators import evaluate, graph, recall, state


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text")


# the stemmer and tokens, as DuckDB has them
_STEM = "case when length(t) > 5 and t like '%ing' then t[:-4] when length(t) > 4 and (t like '%ed' or t like '%es') then t[:-3] when length(t) > 3 and t like '%s' then t[:-2] else t end"
_TOKENS = f"list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: {_STEM})"


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.try_element_at("t", F.lit(1)).alias("first_token"))


TOKEN_STATS = f"with d as (select doc_id, {_TOKENS} as t from documents) select doc_id, cast(len(t) as bigint) as n_tokens, cast(len(list_distinct(t)) as bigint) as n_distinct, t[1] as first_token from d"


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.lexical_topk(*_asked(spark, sf_dir), 3).select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


_LEX = f"""
q as (select item_id as query_id, unnest(list_distinct({_TOKENS})) as token from benchmark), qn as (select query_id, count(*) as n from q group by query_id),
n as (select doc_id as node_id, unnest(list_distinct({_TOKENS})) as token from documents),
lex as (select query_id, node_id, round(count(*) / any_value(qn.n), 9) as score from q join n using (token) join qn using (query_id) group by query_id, node_id)"""
LEXICAL_TOPK = f"with {_LEX} select query_id, node_id, score, row_number() over (partition by query_id order by score desc, node_id) as rank from lex qualify rank <= 3"

_EMB = f"""
qb as (select query_id, b, count(*) as tf from (select item_id as query_id, unnest(list_transform({_TOKENS}, lambda x: cast('0x' || md5(x)[1:4] as int) % 256)) as b from benchmark) group by all),
nb as (select node_id, b, count(*) as tf from (select doc_id as node_id, unnest(list_transform({_TOKENS}, lambda x: cast('0x' || md5(x)[1:4] as int) % 256)) as b from documents) group by all),
ql as (select query_id, sum(tf * tf) as s from qb group by all), nl as (select node_id, sum(tf * tf) as s from nb group by all),
emb as (select query_id, node_id, round(sum(qb.tf * nb.tf) / sqrt(cast(any_value(ql.s) as double) * any_value(nl.s)), 9) as score from qb join nb using (b) join ql using (query_id) join nl using (node_id) group by query_id, node_id)"""


def hash_embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.hash_embedding_topk(*_asked(spark, sf_dir), 3).select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


HASH_EMBEDDING_TOPK = f"with {_EMB} select query_id, node_id, score, row_number() over (partition by query_id order by score desc, node_id) as rank from emb qualify rank <= 3"


def hybrid_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best by cosine and the three best by overlap, a document of both by its larger score."""
    one = F.lit(0).cast("long").alias("graph_id")
    queries = _read(spark, sf_dir, "benchmark").select(one, F.col("item_id").alias("query_id"), "text")
    nodes = _read(spark, sf_dir, "documents").select(one, F.col("doc_id").alias("node_id"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("content"))
    found = graph.seeds(queries, nodes, graph.similar(queries, nodes), 3)
    return found.select("query_id", "node_id", F.col("similarity").alias("score"), F.col("seed").alias("rank"))


HYBRID_SEEDS = f"""with {_LEX}, {_EMB},
h as (select query_id, node_id, emb.score as c, coalesce(lex.score, 0.0) as l from emb left join lex using (query_id, node_id) union all select item_id, doc_id, 0, 0 from benchmark, (select doc_id from documents order by doc_id limit 3) where (item_id, doc_id) not in (select query_id, node_id from emb)),
r as (select *, row_number() over (partition by query_id order by c desc, node_id) as rc, row_number() over (partition by query_id order by l desc, node_id) as rl from h),
s as (select query_id, node_id, case when rc > 3 then greatest(c, l) when rl > 3 then c else greatest(c, l) end as score, case when rc <= 3 then rc else 3 + rl end as p from r where rc <= 3 or rl <= 3)
select query_id, node_id, score, row_number() over (partition by query_id order by score desc, p) as rank from s"""


def recall_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, nodes = _asked(spark, sf_dir)
    ranked = recall.lexical_topk(queries, nodes, 10)
    gold = evaluate.verbatim_gold(queries, nodes)
    return evaluate.ranking_metrics(ranked, gold, 10)


RECALL_NDCG = f"""with {_LEX},
r as (select query_id, node_id, row_number() over (partition by query_id order by score desc, node_id) as rank from lex qualify rank <= 10),
g as (select item_id as query_id, doc_id as node_id from benchmark join documents on contains(documents.text, benchmark.text)),
gn as (select query_id, count(*) as gold from g group by all),
i as (select query_id, gold, list_sum(list_transform(generate_series(1, least(gold, 10)), lambda k: 1 / log2(k + 1))) as ideal from gn),
m as (select query_id, count(rank) as matched, coalesce(sum(1 / log2(rank + 1)), 0.0) as gain from g left join r using (query_id, node_id) group by all)
select query_id, gold, matched, matched > 0 as hit, round(gain / ideal, 9) as ndcg from i join m using (query_id)"""


def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest others of every vector whose id is divisible by 50."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return evaluate.nearest(e.where(F.pmod("vec_id", F.lit(50)) == 0), e, 3)


DENSE_COSINE_TOPK = """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as s from e),
p as (select q.vec_id as query_id, n.vec_id as node_id, round(list_dot_product(q.v, n.v) / (q.s * n.s), 6) as score from n q join n on q.vec_id <> n.vec_id and q.vec_id % 50 = 0)
select query_id, node_id, score, row_number() over (partition by query_id order by score desc, node_id) as rank from p qualify rank <= 3"""

# clauses: orders as sentences with the rules' words
_CLAUSE = "concat('If the ', lower(o_orderpriority), ' order ', cast(o_orderkey as string), case when o_orderstatus = 'F' then ' is delivered, the customer shall pay the invoice immediately' when o_orderstatus = 'O' then ' is late, support must notify leadership and restart the queue' else ' is disputed, the buyer may terminate unless goods are accepted' end)"
_CLAUSE_SQL = _CLAUSE.replace("as string)", "as varchar)")


def clause_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.expr(_CLAUSE).alias("content"))
    n = n.withColumn("role", text.semantic_role(F.col("content"), F.lit("clause"))).select("*", *[c.alias(k) for k, c in text.weights(F.col("content"), text.CONTRACT_WEIGHTS).items()])
    w = scores.bounded_weight(F.col("importance"), F.col("risk"), F.col("novelty"), F.col("confidence"))
    return n.select("node_id", "role", F.array_join(text.scenario_tags(F.col("content")), ",").alias("scenario_tags"), F.array_join(text.symbolic_tags(F.col("content"), F.col("role")), ",").alias("symbolic_tags"), "importance", "risk", "novelty", F.round(w, 9).alias("weight"), scores.anomalous(F.col("risk"), F.col("novelty")).alias("anomaly"))


def _like(column: str, cues: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{c}')" for c in cues) + ")"


_ROLE = "case " + " ".join(f"when {_like('low', cues)} then '{role}'" for role, cues in text.ROLE_CUES) + " else 'obligation' end"
_SCEN = "list_sort(list_filter([" + ", ".join(f"case when len(list_intersect(t, [{', '.join(repr(text.plain_stem(w)) for w in words)}])) > 0 then '{tag}' end" for tag, words in text.SCENARIO_WORDS.items()) + "], lambda x: x is not null))"
_SYMB = "list_sort(list_distinct(list_filter([" + ", ".join(f"case when {_like('low', cues)} then '{tag}' end" for tag, cues in text.SYMBOLIC_CUES.items()) + ", case when role in ('exception', 'escalation') then role end], lambda x: x is not null)))"
_NODES = f"""c as (select o_orderkey as node_id, {_CLAUSE_SQL} as text from orders), l as (select *, lower(text) as low, {_TOKENS} as t from c), r as (select *, {_ROLE} as role from l),
nodes as (select node_id, text, role, t, array_to_string({_SCEN}, ',') as scenario_tags, array_to_string({_SYMB}, ',') as symbolic_tags,
 {", ".join(f"case when {_like('low', cues)} then {high}::double else {rest}::double end as {k}" for k, (cues, high, rest) in text.CONTRACT_WEIGHTS.items())} from r),
weighed as (select *, round(greatest(0, least(1, 0.35 * importance + 0.35 * risk + 0.15 * novelty + 0.15 * 0.95::double)), 9) as weight, case when risk >= 0.8 or novelty >= 0.8 then 1.0::double else 0.0::double end as anomaly from nodes)"""
CLAUSE_NODES = f"with {_NODES} select node_id, role, scenario_tags, symbolic_tags, importance, risk, novelty, weight, anomaly from weighed"


def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause for one question, at depth 1: the weighted and the structure-only total."""
    question = F.lit("Who should pay the defective invoice, and when may the buyer terminate?")
    n = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.expr(_CLAUSE).alias("content"))
    n = n.withColumn("role", text.semantic_role(F.col("content"), F.lit("clause"))).select("*", *[c.alias(k) for k, c in text.weights(F.col("content"), text.CONTRACT_WEIGHTS).items()])
    sem, struct = text.lexical_overlap(question, F.col("content")), scores.structural(F.lit(1.0))
    importance = scores.bounded_weight(F.col("importance"), F.col("risk"), F.col("novelty"), F.col("confidence"))
    total = scores.weighted_total(sem, struct, scores.anomalous(F.col("risk"), F.col("novelty")), importance, scores.exception_score(F.col("role")), F.lit(0.0), F.lit(0.0), scores.recall_multiplier(F.lit("active"), F.lit(0.2)))
    return n.select("node_id", F.round(sem, 9).alias("semantic"), F.round(total, 9).alias("total"), F.round(scores.structure_total(sem, struct), 9).alias("structure_only"))


WEIGHTED_SCORES = f"""with {_NODES}, q as (select list_distinct({_TOKENS}) as qt from (select 'Who should pay the defective invoice, and when may the buyer terminate?' as text)),
s as (select *, len(list_intersect(qt, t))::double / len(qt) as sem, greatest(0, least(1, 0.35 * importance + 0.35 * risk + 0.15 * novelty + 0.15 * 0.95::double)) as imp from weighed, q)
select node_id, round(sem, 9) as semantic, round((0.45 * sem + 0.15 * 0.75 + sem * (0.15 * anomaly + 0.1 * imp + 0.075 * case when role = 'exception' then 1.0 when role in ('remedy', 'escalation') then 0.45 else 0.0 end)) * (1.2 + 0.024)::double, 9) as total, round(0.45 * sem + 0.15 * 0.75::double, 9) as structure_only from s"""


def session_palace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory per conversation: its turns as text, its participants, recency of the last one."""
    t = _read(spark, sf_dir, "conversations")
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.trim(F.coalesce("role", F.lit(""))) == "", "unknown").otherwise(F.col("role")).alias("role"), F.trim("text").alias("text")))).alias("t"))
    lines = F.array_compact(F.transform("t", lambda x, i: F.when(x["text"] != "", F.concat(F.lit("[Turn "), (i + 1).cast("string"), F.lit("] "), x["role"], F.lit(": "), x["text"]))))
    return rows.select("conv_id", F.array_join(lines, "\n").alias("content"), F.array_join(F.array_sort(F.array_distinct(F.transform("t", lambda x: x["role"]))), ",").alias("participants"), F.size("t").cast("long").alias("n_turns"))


SESSION_PALACE = """with t as (select conv_id, row_number() over (partition by conv_id order by turn) as i, case when trim(coalesce(role, '')) = '' then 'unknown' else role end as role, trim(text) as text from conversations)
select conv_id, coalesce(string_agg('[Turn ' || i || '] ' || role || ': ' || text, chr(10) order by i) filter (where text <> ''), '') as content, array_to_string(list_sort(list_distinct(list(role))), ',') as participants, count(*) as n_turns from t group by conv_id"""


def session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEXT links between the turns of a conversation, in both directions."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("src"), F.lead("turn").over(w).alias("dst")).where("dst is not null")
    return recall.both_ways(t.select("conv_id", "src", "dst", F.lit("next").alias("edge_type"), F.lit(0.6).alias("weight"), F.lit(True).alias("bidirectional")))


SESSION_LINKS = """with t as (select conv_id, turn as src, lead(turn) over (partition by conv_id order by turn) as dst from conversations qualify dst is not null), u as (select conv_id, src, dst from t union all select conv_id, dst, src from t)
select *, 'next' as edge_type, 0.6::double as weight, true as bidirectional from u"""


def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of users whose purchases are touches and other events decays."""
    e = _read(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("touched"))
    return state.fold(e, "user_id", "event_id", "touched")


LIFECYCLE_FOLD = """with recursive e as (select user_id, event_type = 'purchase' as t, row_number() over (partition by user_id order by event_id) as i, count(*) over (partition by user_id) as n from events where user_id is not null),
f as (select distinct user_id, cast(0 as bigint) as i, 'encoded' as state, cast(0 as bigint) as c, 0.0::double as s, 1.0::double as d from e
 union all select f.user_id, f.i + 1,
 case when t then case when c + 1 >= 4 or least(1, s + 0.2) >= 0.8 - 1e-9 then 'consolidated' when c + 1 >= 2 then 'stabilizing' else 'active' end
  else case when greatest(0, d - 0.05) <= 0.2 + 1e-9 then 'archived' when state = 'consolidated' and greatest(0, s - 0.1) < 0.55 - 1e-9 then 'fading' when state in ('active', 'stabilizing') and greatest(0, s - 0.1) <= 1e-9 then 'fading' else state end end,
 case when t then c + 1 else c end, round(case when t then least(1, s + 0.2::double) else greatest(0, s - 0.1::double) end, 6), round(case when t then least(1, d + 0.02::double) else greatest(0, d - 0.05::double) end, 6)
 from f join e on e.user_id = f.user_id and e.i = f.i + 1)
select f.user_id, state, c as count, s as stability, d as decay from f join (select distinct user_id, n from e) x on x.user_id = f.user_id and x.n = f.i"""


def bucket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates overall, by language and by source, of documents labelled good."""
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id").select("lang", "source", F.col("quality").cast("double").alias("hit"))
    out = rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("hit"), 6).alias("hit_rate"))
    return out


BUCKET_SUMMARY = "select lang, source, count(*) as cases, round(avg(quality::double), 6) as hit_rate from labels join documents using (doc_id) group by grouping sets ((), (lang), (source))"


_ALL = [token_stats, lexical_topk, hash_embedding_topk, hybrid_seeds, recall_ndcg, dense_cosine_topk, clause_nodes, weighted_scores, session_palace, session_links, lifecycle_fold, bucket_summary]
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
