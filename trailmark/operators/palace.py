"""Recall from memories in spaces: which spaces, which seeds, what they activate, which routes fit, and their ranking.

memories: a nodes table (operators.graph) with kind (episodic, semantic, route), space_id and a place (building, floor,
room, locus); route memories also have route_id, start_id, waypoints and route_kind.  spaces: (graph_id, space_id, ord,
name, building, floor, room, locus, tags).  links: an edges table with bidirectional.  Questions: (query_id, graph_id,
text) and, if any are preferred, preferred (an array of space_ids).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions import cues, scores, text
from trailmark.operators import graph, modes, overlap, search, state, walk
from trailmark.operators.overlap import NANO, Best, Block, Reader, as_batches, billionths, column, scored, trim, typed
from trailmark.sources import storage

Q = ["graph_id", "query_id"]
PARTS = ["building", "floor", "room", "locus", "name"]
LEAST_SEED = 0.1
#: Pairs of a question and a profile of memories that go to workers at most.
PROFILED = 4_000_000
FALLBACK = 0.01


@dataclass(frozen=True)
class Policy:
    """What a recall may take: how many spaces, seeds and results, how far, and which kinds of memories (None: all)."""

    mode: str = "weighted_graph"
    top_k: int = 3
    max_hops: int = 2
    max_spaces: int = 3
    max_seeds: int = 5
    fallback: bool = True
    kinds: tuple[str, ...] | None = None


#: By mode, what is left of activation after an edge and the least that goes on.
TRAVEL = {"structure_only": (0.82, 0.05), "activation_spreading": (0.75, 0.15), "embedding_baseline": (0.7, 0.2), "": (0.8, 0.1)}
STATIC_MODES = ("lexical_baseline", "embedding_baseline", "structure_only", "weighted_graph_static", "activation_spreading_static")


def propagation(mode: str) -> search.Propagation:
    return search.Propagation(*next(v for name, v in TRAVEL.items() if mode.startswith(name)))


def location_key(row: dict[str, Column] | None = None) -> Column:
    """building/floor/room/locus, empty parts left out."""
    part = lambda c: F.when(F.col(c) != "", F.col(c)) if row is None else row[c]
    return F.concat_ws("/", *[part(c) for c in ("building", "floor", "room", "locus")])


def parse_location(key: Column) -> dict[str, Column]:
    """The four parts of a location key; the building is legacy where there is none."""
    parts = F.filter(F.split(F.coalesce(key, F.lit("legacy")), "/"), lambda x: x != "")
    return {"building": F.coalesce(F.get(parts, F.lit(0)), F.lit("legacy"))} | {c: F.get(parts, F.lit(i)) for i, c in enumerate(("floor", "room", "locus"), 1)}


def memory_space(memories: DataFrame) -> DataFrame:
    """memories whose space_id is their location where they state none."""
    if "building" not in memories.columns:
        return memories
    return memories.withColumn("space_id", F.coalesce(F.col("space_id").cast("string"), location_key()))


def _words(queries: DataFrame) -> DataFrame:
    q = queries.select(*Q, F.array_distinct(text.tokens(F.col("text"))).alias("_t"))
    return q.select(*Q, F.size("_t").alias("n"), F.explode("_t").alias("token"))


def _first_ranked(rows: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*Q).orderBy(F.desc("score"), "space_id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= max(1, n))


def fallback_spaces(queries: DataFrame, spaces: DataFrame, n: int) -> DataFrame:
    """For questions that no space answers: the preferred spaces, in their order, then the first ones by ord; n in all."""
    first = spaces.select("graph_id", "space_id", "ord").withColumn("_r", F.row_number().over(Window.partitionBy("graph_id").orderBy("ord"))).where(F.col("_r") <= max(1, n))
    rows = queries.select(*Q).join(first, "graph_id").select(*Q, "space_id", (F.col("_r") + (1 << 30)).alias("_p"))
    reason = F.lit("fallback_low_confidence_scope")
    if "preferred" in queries.columns:
        wanted = queries.select(*Q, F.posexplode("preferred").alias("_p", "space_id")).join(spaces.select("graph_id", "space_id"), ["graph_id", "space_id"], "left_semi")
        rows = rows.unionByName(wanted.select(*Q, "space_id", F.col("_p").alias("_p")))
        some = queries.select(*Q, (F.size(F.coalesce("preferred", F.array().cast("array<string>"))) > 0).alias("_some"))
        rows = rows.groupBy(*Q, "space_id").agg(F.min("_p").alias("_p")).join(some, Q)
        reason = F.when(F.col("_some"), "fallback_preferred_spaces").otherwise(reason)
    rank = F.row_number().over(Window.partitionBy(*Q).orderBy("_p"))
    return rows.withColumn("_o", rank).where(F.col("_o") <= max(1, n)).select(*Q, "space_id", F.lit(FALLBACK).alias("score"), reason.alias("reason"), F.col("_o").cast("long").alias("rank"))


def select_spaces(queries: DataFrame, spaces: DataFrame, texts: DataFrame, n: int, kind: str) -> DataFrame:
    """(graph_id, query_id, space_id, score, reason, rank): the n best spaces by their words or by their place.

    texts: (graph_id, space_id, text), of which a space may have many rows; its overlap with the question is that of
    all of them.  kind keyword is for names and places, metadata for contents.  Preferred spaces gain 0.35 or 0.25.
    Spaces without a word in common fill what is left, by space_id; if no space has one, the fallback decides.
    """
    gain = {"keyword": 0.35, "metadata": 0.25}[kind]
    says = {"keyword": "keyword_space_lexical", "metadata": "metadata_space_memory_blob"}[kind]
    words = _words(queries)
    own = texts.select("graph_id", "space_id", F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    lex = own.join(words, ["graph_id", "token"]).groupBy(*Q, "space_id", "n").agg(F.count(F.lit(1)).alias("c")).select(*Q, "space_id", F.round(F.col("c") / F.col("n"), 9).alias("lex"), F.lit(0.0).alias("loc"))
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(F.col(p), F.lit("")).alias("own")) for p in PARTS], F.struct(F.lit("tags").alias("part"), F.concat_ws(" ", F.coalesce("tags", F.array().cast("array<string>"))).alias("own")))
    placed = spaces.select("graph_id", "space_id", F.inline(parts)).select("graph_id", "space_id", "part", F.explode(text.tokens(F.col("own"))).alias("token")).distinct()
    share = F.lit(0.0)
    for part, value in cues.PLACE_SHARES.items():
        share = F.when(F.col("part") == part, F.lit(value)).otherwise(share)
    loc = placed.join(words, ["graph_id", "token"]).select(*Q, "space_id", "part").distinct().groupBy(*Q, "space_id").agg(F.round(F.least(F.lit(1.0), F.sum(share)), 9).alias("loc")).select(*Q, "space_id", F.lit(0.0).alias("lex"), "loc")
    first = spaces.select("graph_id", "space_id").withColumn("_r", F.row_number().over(Window.partitionBy("graph_id").orderBy("space_id"))).where(F.col("_r") <= max(1, n)).drop("_r")
    none = [F.lit(0.0).alias("lex"), F.lit(0.0).alias("loc")]
    rows = lex.unionByName(loc).unionByName(queries.select(*Q).join(first, "graph_id").select(*Q, "space_id", *none))
    if "preferred" in queries.columns:
        wanted = queries.select(*Q, F.explode("preferred").alias("space_id")).join(spaces.select("graph_id", "space_id"), ["graph_id", "space_id"], "left_semi").distinct()
        rows = rows.unionByName(wanted.select(*Q, "space_id", *none))
    rows = rows.groupBy(*Q, "space_id").agg(F.max("lex").alias("lex"), F.max("loc").alias("loc"))
    signal = F.greatest("lex", "loc")
    rows = rows.withColumn("score", signal).withColumn("reason", F.when(F.col("loc") > F.col("lex"), f"{kind}_space_location_prior").otherwise(says))
    if "preferred" in queries.columns:
        rows = rows.join(wanted.withColumn("_w", F.lit(True)), [*Q, "space_id"], "left").withColumn("score", F.when(F.col("_w"), F.least(F.lit(1.0), F.col("score") + gain)).otherwise(F.col("score"))).drop("_w")
    heard = rows.where(signal > 0).select(*Q).distinct()
    top = _first_ranked(rows.join(heard, Q, "left_semi").select(*Q, "space_id", "score", "reason"), n)
    return top.unionByName(fallback_spaces(queries.join(heard, Q, "left_anti"), spaces, n))


def space_texts(spaces: DataFrame) -> DataFrame:
    """A space as a text: its name, its place and its tags."""
    return spaces.select("graph_id", "space_id", F.concat_ws(" ", "name", location_key(), F.coalesce("tags", F.array().cast("array<string>"))).alias("text"))


def hybrid_spaces(queries: DataFrame, spaces: DataFrame, memories: DataFrame, n: int) -> DataFrame:
    """The n best of both kinds of selection, a space by its larger score."""
    k = select_spaces(queries, spaces, space_texts(spaces), n, "keyword").select(*Q, "space_id", F.col("score").alias("k"), F.col("reason").alias("kr"))
    contents = memories.where("space_id is not null").select("graph_id", F.col("space_id").cast("string").alias("space_id"), F.col("content").alias("text"))
    m = select_spaces(queries, spaces, contents, n, "metadata").select(*Q, "space_id", F.col("score").alias("m"), F.col("reason").alias("mr"))
    both = k.join(m, [*Q, "space_id"], "full_outer")
    back = F.col("kr").startswith("fallback_") & F.col("mr").startswith("fallback_")
    placed = F.contains("kr", F.lit("location_prior")) | F.contains("mr", F.lit("location_prior"))
    reason = F.when(F.col("k").isNull(), F.col("mr")).when(F.col("m").isNull() | back, F.col("kr")).when(placed, "hybrid_max(location_prior)").otherwise("hybrid_max(keyword,metadata)")
    return _first_ranked(both.select(*Q, "space_id", F.greatest(F.coalesce("k", "m"), F.coalesce("m", "k")).alias("score"), reason.alias("reason")), n)


@dataclass(frozen=True)
class Candidates:
    """(query, memory) pairs that can be seeds, with cos, lex, trigger, intent and the state's multiplier."""

    rows: DataFrame


def candidates(queries: DataFrame, memories: DataFrame, sims: DataFrame | graph.Similar, n: int, dynamic: bool, allowed: DataFrame | None = None, kinds: tuple[str, ...] | None = None) -> Candidates:
    """Memories in the allowed spaces (graph_id, query_id, space_id; None: all) that some score may lift.

    Without a word in common, a memory's score depends only on its profile (role, tags, phrases, situations) and its
    state.  So questions meet each distinct profile once, and of the memories that share nothing else with a question
    only the first n of a profile and state can be among the n best; no question meets every memory.  Where sims are
    worked out on demand, workers score memories text by text and only the n best of both kinds of seeds are rows.
    """
    n = max(1, n)
    rows = graph.with_encoding(memory_space(graph.as_nodes(memories).where("kind <> 'route'")))
    rows = rows.where(F.col("kind").isin(list(kinds))) if kinds else rows
    own = ["phrases", "situations", "scenario_tags", "symbolic_tags", "role"]
    rows = rows.withColumn("profile", F.xxhash64(*own, F.lit(5))).withColumn("multiplier", scores.recall_multiplier(F.col("state"), F.col("stability")) if dynamic else F.lit(1.0))
    rows = storage.keep(rows.select("graph_id", "node_id", "ord", F.col("space_id").cast("string").alias("space_id"), "profile", "multiplier", "content", *own), "seed-memories")
    profiles = rows.select("graph_id", "profile", *own).dropDuplicates(["graph_id", "profile"])
    asked = queries.select(*Q, "text", F.array_distinct(text.tokens(F.col("text"))).alias("words"), text.scenario_tags(F.col("text")).alias("q_scen"), text.symbolic_tags(F.col("text"), F.lit("")).alias("q_symb"))
    c = F.col
    called = lambda pairs: pairs.select(*Q, "profile", cues.trigger_score(c("text"), c("words"), c("phrases"), c("situations"), c("scenario_tags"), c("symbolic_tags")).alias("trigger"), cues.intent_score(c("text"), c("q_scen"), c("q_symb"), c("scenario_tags"), c("symbolic_tags"), c("role")).alias("intent"))
    if isinstance(sims, graph.Similar):
        # few rows, but much work on each: spread over all cores
        spread = storage.keep(profiles, "profiles").repartition(rows.sparkSession.sparkContext.defaultParallelism)
        each = storage.keep(called(spread.join(asked, "graph_id")), "profiled")
        if each.count() <= PROFILED and overlap.repeated(rows, ["graph_id", "node_id"]) is None:
            return Candidates(storage.keep(_scored_seeds(queries, rows, each, n, allowed), "seed-candidates"))
        sims = storage.keep(graph.similarities(queries, memories), "similarities")
    rows = rows.drop("content")
    first = Window.partitionBy("graph_id", "space_id", "profile", "multiplier").orderBy("ord")
    few = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).select("graph_id", "node_id", "ord", "space_id", "profile", "multiplier")
    scope = queries.select(*Q) if allowed is None else allowed.select(*Q, "space_id").distinct()
    on = ["graph_id"] if allowed is None else ["graph_id", "space_id"]
    alone = few.join(scope, on).select(*Q, "node_id", "ord", "space_id", "profile", "multiplier", F.lit(0.0).alias("cos"), F.lit(0.0).alias("lex"))
    met = rows.drop(*own).join(sims.select(*Q, "node_id", "cos", "lex"), ["graph_id", "node_id"])
    met = met if allowed is None else met.join(scope, [*Q, "space_id"], "left_semi")
    pairs = met.select(*alone.columns).unionByName(alone).groupBy(*Q, "node_id", "ord", "space_id", "profile", "multiplier").agg(F.max("cos").alias("cos"), F.max("lex").alias("lex"))
    each = called(pairs.select(*Q, "profile").distinct().join(profiles, ["graph_id", "profile"]).join(asked, Q))
    return Candidates(storage.keep(pairs.join(each, [*Q, "profile"]), "seed-candidates"))


def _scored_seeds(queries: DataFrame, rows: DataFrame, each: DataFrame, n: int, allowed: DataFrame | None) -> DataFrame:
    """Of the memories (rows) the n best of each question by both kinds of seed scores, as select_seeds() ranks them; each: trigger and intent of a question and a profile."""
    kinds = {f.name: f.dataType for f in rows.schema}
    carry = [(c, kinds[c]) for c in ("node_id", "ord", "space_id", "profile", "multiplier")] + [(c, T.DoubleType()) for c in ("cos", "lex", "trigger", "intent")]
    schema, arrow = typed([("graph_id", kinds["graph_id"]), ("query_id", queries.schema["query_id"].dataType), *carry])
    texts = rows.select("graph_id", "node_id", "ord", "space_id", "profile", "multiplier", overlap.lowered("content").alias("low"))
    told = each.toArrow()
    triggers, intents = (told.column(c).to_numpy() for c in ("trigger", "intent"))
    profile, which = np.unique(told.column("profile").to_numpy(), return_inverse=True)
    pair_of: dict = {}
    for i, pair in enumerate(zip(told.column("graph_id").to_pylist(), told.column("query_id").to_pylist())):
        pair_of.setdefault(pair, []).append(i)
    spaces = None if allowed is None else sorted({tuple(r) for r in allowed.select(*Q, "space_id").collect() if r[2] is not None}, key=repr)

    def of(block: Block) -> DataFrame:
        trigger, intent = np.zeros((2, len(profile), len(block.rows)))
        for j, (g, q, _) in enumerate(block.rows):
            at = pair_of.get((g, q), [])
            trigger[which[at], j], intent[which[at], j] = triggers[at], intents[at]
        place = {(g, q): j for j, (g, q, _) in enumerate(block.rows)}
        opened = None if spaces is None else [(place[g, q], s) for g, q, s in spaces if (g, q) in place]

        def search_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, best = Reader(block), [Best(len(block.rows), n) for _ in range(2)]
            names = {} if opened is None else {s: i for i, s in enumerate(dict.fromkeys(s for _, s in opened))}
            open_ = np.zeros((len(names) + 1, len(block.rows)), bool)
            for j, s in opened or []:
                open_[names[s], j] = True
            for s in scored(reader, batches):
                take = pa.array(s.rows)
                kind = np.searchsorted(profile, column(s.piece, "profile").take(take).to_numpy(zero_copy_only=False))
                factor = column(s.piece, "multiplier").take(take).to_numpy(zero_copy_only=False)[:, None]
                t, i = trigger[kind][:, s.asked], intent[kind][:, s.asked]
                cos, lex = s.cos / NANO, s.lex / NANO
                inside = True
                if opened is not None:
                    inside = open_[[names.get(x, len(names)) for x in column(s.piece, "space_id").take(take).to_pylist()]][:, s.asked]
                values = [column(s.piece, c) for c, _ in carry[:5]]
                carried = lambda r, j: (*[v[int(s.rows[r])].as_py() for v in values], float(cos[r, j]), float(lex[r, j]), float(t[r, j]), float(i[r, j]))  # noqa: B023, E731
                # as cues.seed_score() has it, embedding and lexical
                for b, base, of_trigger, of_intent in ((best[0], cos, 0.2, 0.25), (best[1], lex, 0.35, 0.3)):
                    score = billionths(np.minimum(1.0, np.minimum(1.0, base + of_trigger * t + of_intent * i) * factor))
                    b.add(s, score, inside & (score >= LEAST_SEED * NANO), carried)
            for b in best:
                for (g, q, _), found in zip(block.rows, b.found):
                    yield from as_batches([(g, q, *e[2]) for e in found], arrow)
            trim()

        return texts.mapInArrow(search_seeds, schema)

    every = overlap.blocks(queries)
    if not every:
        return rows.sparkSession.createDataFrame([], schema)
    out = of(every[0])
    for block in every[1:]:
        out = out.unionByName(of(block))
    return out.distinct()


def _best_seeds(rows: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*Q).orderBy(F.desc("score"), "ord"))
    return rows.where(F.col("score") >= LEAST_SEED).withColumn("seed", rank.cast("long")).where(F.col("seed") <= max(1, n))


def select_seeds(found: Candidates, n: int, kind: str) -> DataFrame:
    """(graph_id, query_id, seed, node_id, ord, score, reason, space_id): the n best of at least 0.1, kind embedding or lexical."""
    base, label = {"embedding": ("cos", "embedding_cosine"), "lexical": ("lex", "lexical_overlap")}[kind]
    c = F.col
    rows = found.rows.select(*Q, "node_id", "ord", cues.seed_score(c(base), c("trigger"), c("intent"), c("multiplier"), kind).alias("score"), cues.seed_reason(F.lit(label), c("trigger"), c("intent")).alias("reason"), "space_id")
    return _best_seeds(rows, n)


def hybrid_seeds(found: Candidates, n: int) -> DataFrame:
    """Both selections, each of max(4n, 16), joined: 0.6 of the embedding's and 0.4 of the lexical score, or the one there is.

    ``found`` must have been made for max(4n, 16) seeds.
    """
    wide = max(4 * n, 16)
    e = select_seeds(found, wide, "embedding").select(*Q, "node_id", F.col("ord").alias("eo"), F.col("score").alias("e"), F.col("reason").alias("er"), F.col("space_id").alias("es"))
    l = select_seeds(found, wide, "lexical").select(*Q, "node_id", F.col("ord").alias("lo"), F.col("score").alias("l"), F.col("reason").alias("lr"), F.col("space_id").alias("ls"))
    both = e.join(l, [*Q, "node_id"], "full_outer")
    says = lambda w: F.contains("er", F.lit(w)) | F.contains("lr", F.lit(w))
    reason = F.when(F.col("e").isNull(), F.col("lr")).when(F.col("l").isNull(), F.col("er")).when(says("intent"), "hybrid_embed_lex_trigger_intent").when(says("trigger"), "hybrid_embed_lex_trigger").otherwise("hybrid_embed_lex")
    score = F.round(F.coalesce(0.6 * F.col("e") + 0.4 * F.col("l"), "e", "l"), 9)
    return _best_seeds(both.select(*Q, "node_id", F.coalesce("eo", "lo").alias("ord"), score.alias("score"), reason.alias("reason"), F.coalesce("es", "ls").alias("space_id")), n)


@dataclass(frozen=True)
class Activated:
    memories: DataFrame
    routes: DataFrame
    snapshot: DataFrame


def activate(queries: DataFrame, memories: DataFrame, links: DataFrame, sims: DataFrame | graph.Similar, seeds: DataFrame, allowed: DataFrame | None, policy: Policy, most: int = 12) -> Activated:
    """What the seeds activate inside the allowed spaces; route memories take no part.

    memories: query_id, node_id, score, reason, retrieval_role, the top_k best; routes: one per seed, the top_k best;
    snapshot: the traces of all seeds.
    """
    dynamic = policy.mode not in STATIC_MODES
    total = graph.structure_only if policy.mode == "structure_only" else graph.weighted_unpaired
    p = search.prepare(queries, memories, links, dynamic, sims)
    reach = graph.as_nodes(memories).where("kind <> 'route'").select("graph_id", "node_id", F.col("space_id").cast("string").alias("space_id"))
    scope = search.Reach(storage.keep(reach.distinct(), "reach"), None if allowed is None else allowed.select(*Q, "space_id"))
    start = seeds.select(*search.KEY, "node_id", F.col("score").alias("similarity"))
    active, trace = search.spread(p, start, policy.max_hops, total, propagation(policy.mode), most, scope)
    active = storage.keep(active, "activated")
    k = max(1, policy.top_k)
    best = Window.partitionBy(*Q, "node_id").orderBy(F.desc("score"), "seed")
    arrival = Window.partitionBy(*Q).orderBy("seed", F.desc("score"), F.desc("activation"), "first")
    rows = active.withColumn("_n", F.row_number().over(arrival))
    rows = rows.withColumn("_b", F.row_number().over(best)).withColumn("_first", F.min("_n").over(Window.partitionBy(*Q, "node_id"))).where("_b = 1")
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(*Q).orderBy(F.desc("score"), "_first")).cast("long")).where(F.col("place") <= k)
    reason = F.when(F.col("hop") == 0, F.format_string("seed activation=%.3f", F.col("activation"))).otherwise(F.format_string("native activation hop=%d activation=%.3f", F.col("hop"), F.col("activation")))
    got = top.select(*Q, "place", "node_id", "score", reason.alias("reason"), F.when(F.col("hop") == 0, "seed").otherwise("support").alias("retrieval_role"))
    ends = search.terminals(active, start, False)
    walked = search.trace_back(ends, active, policy.max_hops, "native activation").join(ends.select(*search.KEY, "start", F.col("node_id").alias("end"), "score"), search.KEY)
    kinds = F.filter(F.transform("steps", lambda s: s["via_edge_type"]), lambda e: e.isNotNull())
    kind = cues.walked_route(kinds)
    hops = (F.size("steps") - 1).cast("string")
    # fixed values: the wording of explanations
    said = F.concat(F.lit("expanded from seed "), F.col("start").cast("string"), F.lit(" to "), F.col("end").cast("string"))
    told = F.when(F.size(kinds) > 0, F.concat(said, F.lit(" across "), hops, F.lit(" hops using "), F.array_join(kinds, " -> "), F.lit(" edges ("), kind, F.lit(")"))).when(F.col("start") == F.col("end"), F.concat(F.lit("seed "), F.col("start").cast("string"), F.lit(" remained the strongest recalled node"))).otherwise(F.concat(said, F.lit(" ("), kind, F.lit(")")))
    routes = walked.select(*Q, "seed", F.concat(F.lit("native-path-"), F.col("start").cast("string")).alias("route_id"), kind.alias("route_kind"), F.lit("native_activation").alias("route_source"), F.transform("steps", lambda s: s["node_id"]).alias("steps"), "score", told.alias("explanation"))
    routes = routes.withColumn("place", F.row_number().over(Window.partitionBy(*Q).orderBy(F.desc("score"), "seed")).cast("long")).where(F.col("place") <= k).drop("seed")
    return Activated(got, routes, trace)


def route_steps(memories: DataFrame) -> DataFrame:
    """Route memories with steps: the waypoints, the start before them if it isn't one of them."""
    points = F.coalesce("waypoints", F.array().cast(memories.schema["waypoints"].dataType))
    steps = F.when(F.col("start_id").isNotNull() & ~F.coalesce(F.array_contains(points, F.col("start_id")), F.lit(False)), F.concat(F.array("start_id"), points)).otherwise(points)
    rows = memories.where("kind = 'route'").select("graph_id", F.coalesce(F.col("route_id").cast("string"), F.col("node_id").cast("string")).alias("route_id"), "ord", F.coalesce(F.when(F.col("route_kind") != "", F.col("route_kind")), F.lit("route_memory")).alias("route_kind"), steps.alias("steps"))
    return rows.where(F.size("steps") > 0)


def _best_routes(queries: DataFrame, said: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """(graph_id, query_id, _row, lex): of the routes (graph_id, _row, route_kind, ord, content) the k best of each question by words and kind."""
    asked_kind = {(r[0], r[1]): r[2] for r in kinds.select(*Q, "asked").collect()}
    schema, arrow = typed([("graph_id", said.schema["graph_id"].dataType), ("query_id", queries.schema["query_id"].dataType), ("_row", T.LongType()), ("lex", T.DoubleType())])
    texts = said.select("graph_id", "_row", "route_kind", "ord", overlap.lowered("content").alias("low"))

    def of(block: Block) -> DataFrame:
        wanted = [asked_kind.get((g, q)) for g, q, _ in block.rows]

        def search_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, best = Reader(block), Best(len(block.rows), k)
            want = np.array([w or "" for w in wanted], object)
            for s in scored(reader, batches):
                kind = np.array(column(s.piece, "route_kind").take(pa.array(s.rows)).to_pylist(), object)
                bonus = np.where((kind[:, None] == want[s.asked][None, :]) & (want[s.asked] != "")[None, :], 0.2, 0.0)
                lex, row = s.lex / NANO, column(s.piece, "_row")
                score = billionths(np.minimum(1.0, 0.35 * lex + bonus))
                best.add(s, score, score > 0, lambda i, j: (row[int(s.rows[i])].as_py(), float(lex[i, j])))  # noqa: B023
            for (g, q, _), found in zip(block.rows, best.found):
                yield from as_batches([(g, q, *e[2]) for e in found], arrow)
            trim()

        return texts.mapInArrow(search_routes, schema)

    every = overlap.blocks(queries)
    if not every:
        return said.sparkSession.createDataFrame([], schema)
    out = of(every[0])
    for block in every[1:]:
        out = out.unionByName(of(block))
    return out


def plan_routes(queries: DataFrame, memories: DataFrame, links: DataFrame, seeds: DataFrame, policy: Policy) -> DataFrame:
    """(graph_id, query_id, route_id, route_kind, route_source, steps, score, explanation, place): the top_k stored routes.

    Half the share of a route's nodes that are seeds, 0.35 of its contents' overlap with the question, 0.1 if a seed is
    on it, 0.2 if its kind is asked for; routes that have none of these are left out.  Beside them stands the greedy
    walk from the best seed if it goes anywhere else, or alone if no route is left.
    """
    k = max(1, policy.top_k)
    routes = storage.keep(route_steps(memories).withColumn("_row", F.xxhash64("graph_id", "route_id", "ord")), "routes")
    kinds = queries.select(*Q, cues.asked_route(F.col("text")).alias("asked"))
    at = routes.select("graph_id", "_row", F.explode(F.array_distinct("steps")).alias("node_id"))
    size = at.groupBy("graph_id", "_row").agg(F.count(F.lit(1)).alias("n_set"))
    hits = at.join(seeds.select(*Q, "node_id").distinct(), ["graph_id", "node_id"]).groupBy(*Q, "_row").agg(F.count(F.lit(1)).alias("hits"))
    hits = storage.keep(hits, "route-hits")
    walk = storage.keep(greedy_route(queries, links, seeds, policy.max_hops), "walked")
    said = at.join(memories.select("graph_id", "node_id", "content"), ["graph_id", "node_id"], "left").groupBy("graph_id", "_row").agg(F.array_join(F.collect_list("content"), "\n").alias("content"))
    place = F.array(-F.size("steps").cast("long"), F.coalesce(F.col("ord").cast("long"), F.lit(-(1 << 63)))).alias("ord")
    said = storage.keep(routes.select("graph_id", "_row", "route_kind", place).join(said, ["graph_id", "_row"]), "route-texts")
    # a route without seeds scores by its words and kind: of those the k best; all with seeds, and all that equal the walk, as it stands aside then
    needed = hits.select(*Q, "_row").unionByName(walk.join(routes.select("graph_id", "_row", "steps"), ["graph_id", "steps"]).select(*Q, "_row"))
    needed = storage.keep(needed.distinct(), "route-pairs")
    stated = overlap.of_pairs(queries, graph.few(needed).join(said, ["graph_id", "_row"]).select(*Q, F.col("_row").alias("node_id"), "content"))
    rows = _best_routes(queries, said, kinds, k).unionByName(stated.select(*Q, F.col("node_id").alias("_row"), "lex"))
    rows = storage.keep(rows.groupBy(*Q, "_row").agg(F.max("lex").alias("lex")).join(hits, [*Q, "_row"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))), "route-candidates")
    rows = graph.few(rows).join(routes, ["graph_id", "_row"]).join(size, ["graph_id", "_row"]).join(kinds, Q)
    bonus = F.coalesce(cues.kind_bonus(F.col("route_kind"), F.col("asked")), F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), 0.5 * F.col("hits") / F.col("n_set") + 0.35 * F.col("lex") + F.when(F.col("hits") > 0, 0.1).otherwise(0.0) + bonus), 9)
    parts = F.array_compact(F.array(F.when(F.col("hits") > 0, F.lit("matches current seeds")), F.when(F.col("lex") > 0, F.lit("matches query content")), F.when(bonus > 0, F.lit("matches query route intent"))))
    stored = rows.select(*Q, "route_id", "route_kind", F.lit("route_memory").alias("route_source"), "steps", score.alias("score"), F.array_join(parts, ", ").alias("explanation"), "ord").where("score > 0")
    stored = storage.keep(stored, "planned")
    beside = stored.select(*Q).distinct().withColumn("_some", F.lit(True))
    equal = stored.select(*Q, "steps").distinct().withColumn("_same", F.lit(True))
    walk = walk.join(beside, Q, "left").join(equal, [*Q, "steps"], "left").where("_some is null or (size(steps) > 1 and _same is null)")
    every = stored.unionByName(walk.select(*stored.columns))
    own = (F.col("route_source") == "route_memory").cast("int")
    order = Window.partitionBy(*Q).orderBy(F.desc("score"), F.desc(own), F.desc(F.size("steps")), "ord", "route_id")
    return every.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).drop("ord")


def greedy_route(queries: DataFrame, links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """The chain of best links from each question's best seed, kinds that the question asks for before others."""
    starts = seeds.where("seed = 1").join(queries.select(*Q, "text"), Q)
    keyed = starts.select(F.struct(*Q).alias("query_id"), F.struct("graph_id", "node_id").alias("node_id"), cues.asked_route(F.col("text")).alias("asked"))
    out = graph.add_reverse(links).select(F.struct("graph_id", F.col("src").alias("node_id")).alias("src"), F.struct("graph_id", F.col("dst").alias("node_id")).alias("dst"), F.col("edge_type").alias("kind"), F.col("weight").alias("strength"))
    path = walk.greedy_walk(keyed, out, max(0, hops)).select("query_id.*", F.transform("path", lambda x: x["node_id"]).alias("steps"))
    rows = path.join(starts.select(*Q, "node_id", "score", cues.asked_route(F.col("text")).alias("asked")), Q)
    kind = F.coalesce("asked", F.lit("graph_expansion"))
    told = F.concat(F.lit("seed-driven graph expansion from "), F.col("node_id").cast("string"), F.when(F.col("asked").isNotNull(), F.concat(F.lit(" biased toward "), F.col("asked"), F.lit(" edges"))).otherwise(""))
    return rows.select(*Q, F.concat(F.lit("legacy-path-"), F.col("node_id").cast("string")).alias("route_id"), kind.alias("route_kind"), F.lit("legacy_path").alias("route_source"), "steps", "score", told.alias("explanation"), F.lit((1 << 62)).cast("long").alias("ord"))


def merge_routes(planned: DataFrame, activated: DataFrame, k: int) -> DataFrame:
    """One route of each (steps, kind): by priority of its source, score, then stored, activated, walked order; the k best."""
    columns = [*Q, "route_id", "route_kind", "route_source", "steps", "score", "explanation"]
    turn = F.when(F.col("route_source") == "route_memory", 0).when(F.col("route_source") == "native_activation", 1).otherwise(2)
    every = planned.select(*columns, "place").unionByName(activated.select(*columns, "place")).withColumn("_at", F.struct(turn.alias("t"), "place")).withColumn("priority", cues.route_priority(F.col("route_source")))
    same = Window.partitionBy(*Q, "steps", "route_kind")
    once = every.withColumn("_first", F.min("_at").over(same)).withColumn("_r", F.row_number().over(same.orderBy(F.desc("priority"), F.desc("score"), "_at"))).where("_r = 1")
    order = Window.partitionBy(*Q).orderBy(F.desc("priority"), F.desc("score"), F.desc(F.size("steps")), "_first")
    return once.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= max(1, k)).select(*columns, "priority", "place")


def rank_fusion(memories: DataFrame, sims: DataFrame | graph.Similar, seeds: DataFrame, activated: DataFrame, routes: DataFrame, k: int, dynamic: bool) -> tuple[DataFrame, DataFrame]:
    """The k best memories of seeds, activated ones and steps of routes, and the routes ranked by score and alignment.

    Scores gain 0.35 (routes 0.25) of the alignment: the larger of cosine and overlap, for routes that of their best
    step.  Seeds and steps are first weighed by the state of the memory; a step has its route's score over its place.
    """
    own = graph.as_nodes(memories).select("graph_id", "node_id", (scores.recall_multiplier(F.col("state"), F.col("stability")) if dynamic else F.lit(1.0)).alias("multiplier"), F.lit(True).alias("known"))
    pairs = seeds.select(*Q, "node_id").unionByName(activated.select(*Q, "node_id")).unionByName(routes.select(*Q, F.explode("steps").alias("node_id")))
    align = graph.similarity_of(sims, pairs).select(*Q, "node_id", F.col("sem").alias("alignment"))
    align = storage.keep(align, "alignments") if isinstance(sims, graph.Similar) else align

    def aligned(rows: DataFrame, base: Column) -> DataFrame:
        rows = rows.join(own, ["graph_id", "node_id"], "left").join(align, [*Q, "node_id"], "left").withColumn("alignment", F.coalesce("alignment", F.lit(0.0)))
        return rows.withColumn("score", F.round(F.when(F.col("known"), base + 0.35 * F.col("alignment")).otherwise(F.col("score")), 9))

    weighed = F.least(F.lit(1.0), F.col("score") * F.col("multiplier"))
    columns = [*Q, "node_id", "score", "alignment", "reason", "retrieval_role", "_turn", "_place", "_step"]
    none = F.lit(0).cast("long")
    one = aligned(seeds.select(*Q, "node_id", "score", "reason", F.lit("seed").alias("retrieval_role"), F.lit(0).alias("_turn"), F.col("seed").alias("_place"), none.alias("_step")), weighed).select(*columns)
    two = aligned(activated.select(*Q, "node_id", "score", "reason", "retrieval_role", F.lit(1).alias("_turn"), F.col("place").alias("_place"), none.alias("_step")), F.col("score")).select(*columns)
    best = routes.select(*Q, "place", F.explode(F.array_distinct("steps")).alias("node_id")).join(own.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi").join(align, [*Q, "node_id"], "left").groupBy(*Q, "place").agg(F.max(F.coalesce("alignment", F.lit(0.0))).alias("alignment"))
    scored = routes.join(best, [*Q, "place"], "left").withColumn("alignment", F.coalesce("alignment", F.lit(0.0))).withColumn("score", F.round(F.col("score") + 0.25 * F.col("alignment"), 9))
    steps = scored.select(*Q, "place", "route_id", F.col("score").alias("_r"), F.posexplode("steps").alias("_i", "node_id")).select(*Q, "node_id", (F.col("_r") / (F.col("_i") + 1)).alias("score"), F.concat(F.lit("route:"), "route_id").alias("reason"), F.when(F.col("_i") > 0, "support").otherwise("seed").alias("retrieval_role"), F.lit(2).alias("_turn"), F.col("place").alias("_place"), F.col("_i").cast("long").alias("_step"))
    three = aligned(steps, weighed).select(*columns)
    every = one.unionByName(two).unionByName(three).withColumn("_at", F.struct("_turn", "_place", "_step"))
    pick = every.withColumn("_b", F.row_number().over(Window.partitionBy(*Q, "node_id").orderBy(F.desc("score"), "_at"))).withColumn("_first", F.min("_at").over(Window.partitionBy(*Q, "node_id"))).where("_b = 1")
    order = Window.partitionBy(*Q).orderBy(F.desc("score"), F.desc("alignment"), "_first")
    top = pick.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= max(1, k)).select(*Q, "rank", "node_id", "score", "reason", "retrieval_role")
    place = Window.partitionBy(*Q).orderBy(F.desc("score"), F.desc("alignment"), F.size("steps"), "place")
    return top, scored.withColumn("rank", F.row_number().over(place).cast("long")).drop("place", "priority")


@dataclass(frozen=True)
class Recalled:
    memories: DataFrame
    routes: DataFrame
    snapshot: DataFrame
    spaces: DataFrame
    seeds: DataFrame


@dataclass(frozen=True)
class Steps:
    """The steps of a recall that may be replaced; each takes and returns tables as the built-in one does."""

    spaces: Callable[..., DataFrame] = hybrid_spaces
    seeds: Callable[[Candidates, int], DataFrame] = hybrid_seeds
    activation: Callable[..., Activated] = activate
    routes: Callable[..., DataFrame] = plan_routes
    ranking: Callable[..., tuple[DataFrame, DataFrame]] = rank_fusion


def reinforce(memories: DataFrame, recalled: DataFrame) -> DataFrame:
    """memories after a recall: those recalled (graph_id, node_id) are reinforced, all others decay, by the plain lifecycle."""
    return modes.after_search(memories, recalled, modes.StatePolicy(True, state.reinforce, state.decay))


def recall(queries: DataFrame, memories: DataFrame, spaces: DataFrame, links: DataFrame, policy: Policy = Policy(), sims: DataFrame | graph.Similar | None = None, steps: Steps = Steps()) -> Recalled:
    """Spaces, seeds, activation, routes, merging and ranking for all questions; questions that recall nothing fall back to a search of the whole graph, if the policy allows it.

    A recall leaves the memories as they are; reinforce() makes what it recalled stronger.
    """
    dynamic = policy.mode not in STATIC_MODES
    memories = storage.keep(graph.as_nodes(memories), "memories")
    sims = graph.similar(queries, memories) if sims is None else sims
    allowed = storage.keep(steps.spaces(queries, spaces, memories, policy.max_spaces), "spaces")
    scope = None if spaces.isEmpty() else allowed
    found = candidates(queries, memories, sims, max(4 * policy.max_seeds, 16), dynamic, scope, policy.kinds)
    seeds = storage.keep(steps.seeds(found, policy.max_seeds), "seeds")
    active = steps.activation(queries, memories, links, sims, seeds, scope, policy)
    planned = steps.routes(queries, memories, links, seeds, policy)
    routes = storage.keep(merge_routes(planned, active.routes, policy.top_k), "merged")
    top, ranked = steps.ranking(memories, sims, seeds, active.memories, routes, policy.top_k, dynamic)
    top = storage.keep(top, "recalled")
    top, ranked = top.withColumn("fallback", F.lit(False)), ranked.select(*Q, "rank", "route_id", "route_kind", "route_source", "steps", "score", "explanation")
    if policy.fallback:
        left = queries.join(top.select(*Q), Q, "left_anti")
        if not left.isEmpty():
            got = modes.search_once(left, memories, links, modes.mode(policy.mode.removeprefix("palace_")), policy.top_k, policy.max_hops, sims)
            m, r = search.recalled(got.paths)
            top = top.unionByName(m.select(*Q, "rank", "node_id", "score", "reason", "retrieval_role", F.lit(True).alias("fallback")))
            again = r.withColumn("rank", F.row_number().over(Window.partitionBy(*Q).orderBy("route_id")).cast("long")).withColumn("explanation", F.lit("converted from legacy retrieval path"))
            ranked = ranked.join(left.select(*Q), Q, "left_anti").unionByName(again.select(*ranked.columns))
    return Recalled(top, ranked, active.snapshot, allowed, seeds)
