"""Queries of cues, greedy walks and the streamed lifecycle over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import cues, text
from trailmark.operators import walk
from trailmark.plans.queries import _CLAUSE, _NODES, _SCEN, _SYMB, _TOKENS, LIFECYCLE_FOLD, _like, _read
from trailmark.sources import storage
from trailmark.streaming import lifecycle

#: A question for the clauses of each order status; P stands for any other.
QUESTIONS = {
    "F": "Who should be paged in a payment dispute about defective goods?",
    "O": "What should support restart next to recover during a rollback failure?",
    "P": "Is there an exception override when an exception applies, because goods are in dispute?",
}


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses and the questions that their status asks; what a question says is told once for each of the three."""
    asks = spark.createDataFrame(list(QUESTIONS.items()), "status string, question string")
    asks = asks.select("*", F.array_distinct(text.tokens(F.col("question"))).alias("words"), text.scenario_tags(F.col("question")).alias("q_scen"), text.symbolic_tags(F.col("question"), F.lit(None).cast("string")).alias("q_symb"))
    status = F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")).otherwise("P").alias("status")
    n = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), status, F.expr(_CLAUSE).alias("content"))
    n = n.withColumn("role", text.semantic_role(F.col("content"), F.lit("clause")))
    n = n.select("*", text.scenario_tags(F.col("content")).alias("scen"), text.symbolic_tags(F.col("content"), F.col("role")).alias("symb"), text.tokens(F.col("content")).alias("own"))
    return n.join(F.broadcast(asks), "status")


def clause_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls up each clause, and how far its question does; a score is made once for each distinct profile of clauses and question."""
    n = _clauses(spark, sf_dir).withColumn("phrases", cues.trigger_phrases(F.col("content"), F.col("scen"))).withColumn("situations", cues.trigger_situations(F.col("scen"), F.col("symb")))
    profile = ["status", "role", "phrases", "situations", "scen", "symb"]
    kinds = n.groupBy(*profile).agg(*[F.first(c).alias(c) for c in ("question", "words", "q_scen", "q_symb")])
    kinds = kinds.withColumn("trigger", cues.trigger_score(*[F.col(c) for c in ("question", "words", "phrases", "situations", "scen", "symb")]))
    kinds = kinds.withColumn("intent", cues.intent_score(*[F.col(c) for c in ("question", "q_scen", "q_symb", "scen", "symb", "role")]))
    rows = n.select("node_id", *profile, "question", (F.size(F.array_intersect("words", "own")) / F.size("words")).alias("overlap")).join(kinds.select(*profile, "trigger", "intent"), profile)
    return rows.select("node_id", F.array_join("phrases", "|").alias("phrases"), F.array_join("situations", "|").alias("situations"), "trigger", "intent", cues.seed_reason(F.lit("lexical"), F.col("trigger"), F.col("intent")).alias("reason"), cues.seed_score(F.col("overlap"), F.col("trigger"), F.col("intent"), F.lit(0.95), "lexical").alias("score"), cues.asked_route(F.col("question")).alias("asked"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_T = _TOKENS.replace("coalesce(text", "coalesce(s")
_PHRASES = "list_sort(list_distinct(list_concat(flatten([" + ", ".join(f"case when list_contains(scen, '{s}') then {_list(p)} else [] end" for s, p in cues.SCENARIO_PHRASES.items()) + f"]), list_filter({_list(cues.LITERAL_PHRASES)}, lambda p: contains(lower(content), p)))))"
_SITUATIONS = "list_sort(list_distinct(list_concat(list_transform(scen, lambda s: 'during ' || s), list_transform(scen, lambda s: 'after ' || s), list_filter([" + ", ".join(f"case when list_contains(symb, '{s}') then '{w}' end" for s, w in cues.SITUATIONS.items()) + "], lambda x: x is not null))))"
_ASKS = "case " + " ".join(f"when role in ({', '.join(repr(r) for r in roles)}) and {_like('q_low', asks)} then {score}::double" for roles, asks, score in cues.ROLE_QUESTIONS) + " else 0::double end"
_ASKED = "case " + " ".join(f"when {_like('q_low', asks)} then '{kind}'" for kind, asks in cues.ROUTE_QUESTIONS) + " end"
CLAUSE_TRIGGERS = f"""with {_NODES}, qs as (select * from (values ('F', '{QUESTIONS["F"]}'), ('O', '{QUESTIONS["O"]}'), ('P', '{QUESTIONS["P"]}')) v(st, text)), ql as (select st, lower(text) as low, {_TOKENS} as t, null::varchar as role from qs),
qq as (select st, low as q_low, list_distinct(t) as words, {_SCEN} as q_scen, {_SYMB} as q_symb from ql),
b as (select node_id, nodes.text as content, nodes.t, role, list_filter(string_split(scenario_tags, ','), lambda x: x <> '') as scen, list_filter(string_split(symbolic_tags, ','), lambda x: x <> '') as symb, case when o_orderstatus in ('F', 'O') then o_orderstatus else 'P' end as st from nodes join orders on o_orderkey = node_id),
e as (select *, {_PHRASES} as ph, {_SITUATIONS} as si from b join qq using (st)),
d as (select *, round(least(1::double, 0.3::double * len(list_filter(ph, lambda p: contains(q_low, p))) + 0.18::double * len(list_filter(si, lambda s: len(list_intersect(list_distinct({_T}), words)) >= 2))
  + 0.25::double * len(list_filter(scen, lambda s: len(list_filter({_T}, lambda w: not list_contains(words, w))) = 0)) + 0.12::double * len(list_filter(symb, lambda s: contains(q_low, s)))), 9) as trigger,
 round(least(0.45::double, 0.22::double * least(1, len(list_intersect(scen, q_scen))) + 0.08::double * least(2, len(list_intersect(symb, q_symb))) + 0.18::double * {_ASKS}), 9) as intent, len(list_intersect(words, t))::double / len(words) as lex from e)
select node_id, array_to_string(ph, '|') as phrases, array_to_string(si, '|') as situations, trigger, intent, 'lexical' || case when trigger > 0 then '+trigger' else '' end || case when intent > 0 then '+intent' else '' end as reason,
 round(least(1::double, least(1::double, lex + 0.35::double * trigger + 0.3::double * intent) * 0.95::double), 9) as score, {_ASKED} as asked from d"""


def greedy_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of three links from each conversation's first turn; back links are stronger, and only some ask for a timeline."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _read(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(w).alias("i"), F.lead("turn").over(w).isNotNull().alias("more"))
    at = lambda i: F.concat_ws(":", F.col("conv_id").cast("string"), i.cast("string"))
    ahead = t.where("more").select(at(F.col("i")).alias("src"), at(F.col("i") + 1).alias("dst"))
    links = ahead.select("src", "dst", F.lit("next").alias("kind"), F.lit(0.6).alias("strength")).unionByName(ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("recalls").alias("kind"), F.lit(0.9).alias("strength")))
    starts = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").alias("query_id"), at(F.lit(1)).alias("node_id"), F.when(F.col("n") % 2 == 0, "timeline").alias("asked"))
    return walk.greedy_walk(starts, links, 3).select("query_id", F.array_join("path", ">").alias("path"), cues.walked_route(F.col("kinds")).alias("route_kind"))


GREEDY_WALKS = """with n as (select conv_id, count(*) as n from conversations group by conv_id), k as (select conv_id, least(n, case when n % 2 = 0 then 4 else 2 end) as k from n)
select conv_id as query_id, array_to_string(list_transform(generate_series(1, k), lambda i: conv_id || ':' || i), '>') as path, case when k > 1 then 'timeline' else 'graph_expansion' end as route_kind from k"""


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lifecycle_fold, with events as a stream: all that is there now, batch by batch; the last state of each user."""
    folder = f"{storage.shared_dir(spark)}/lifecycle-{uuid.uuid4().hex}"
    path, source = f"{sf_dir}/events.parquet", spark.readStream
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(file).isDirectory():
        # streams read folders
        source, path = source.option("pathGlobFilter", "events.parquet"), sf_dir
    events = source.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(path).where("user_id is not null")
    log = events.select("user_id", "event_id", (F.col("event_type") == "purchase").alias("touched"))
    updates = lifecycle.stream_fold(log, "user_id", "event_id", "touched")
    # a batch that runs again overwrites its own folder
    keep = lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={i}")
    updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    last = F.max_by(F.struct("state", "count", "stability", "decay"), "n_events").alias("_s")
    return spark.read.schema(updates.schema).parquet(f"{folder}/updates").groupBy("user_id").agg(last).select("user_id", "_s.*")


STREAM_LIFECYCLE = LIFECYCLE_FOLD

_ALL = [clause_triggers, greedy_walks, stream_lifecycle]
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
