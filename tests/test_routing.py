"""Cues, greedy walks and the streamed lifecycle against brute force."""

import random

from pyspark.sql import functions as F

from trailmark.functions import cues, text
from trailmark.operators import state, walk
from trailmark.streaming import lifecycle

LINKS = "src string, dst string, kind string, strength double"


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_triggers(spark):
    none = F.array().cast("array<string>")
    pay = F.array(F.lit("payment dispute"))
    assert one(spark, cues.trigger_phrases(F.lit("the Queue Drain"), pay)) == [["defective goods", "invoice dispute", "payment dispute", "queue drain"]]
    assert one(spark, cues.trigger_phrases(F.lit(""), F.array(F.lit("own")))) == [["own"]]
    assert one(spark, cues.trigger_situations(pay, F.array(F.lit("urgency"), F.lit("conflict")))) == [["after payment dispute", "during payment dispute", "when urgency is high"]]
    q = F.lit("A payment dispute, urgency")
    words = F.array_distinct(text.tokens(q))
    # one phrase, two situations, the scenario in full, one symbol
    assert one(spark, cues.trigger_score(q, words, F.array(F.lit("payment dispute")), cues.trigger_situations(pay, none), pay, F.array(F.lit("urgency")))) == [1.0]
    assert one(spark, cues.trigger_score(q, words, none, none, none, F.array(F.lit("urgency")))) == [0.12]
    assert one(spark, cues.trigger_score(F.lit(""), none, none, none, none, none)) == [0.0]


def test_intent_places_and_kinds(spark):
    none, tags = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert one(spark, cues.intent_score(F.lit("who should"), tags, tags, tags, tags, F.lit("escalation"))) == [0.45]
    assert one(spark, cues.intent_score(F.lit("what do"), none, none, tags, tags, F.lit("remedy"))) == [0.144]
    assert one(spark, cues.place_score(F.array(F.lit("hall")), {"building": F.lit("Hall"), "tags": F.array(F.lit("halls")), "room": F.lit(None).cast("string")})) == [0.5]
    assert one(spark, cues.asked_route(F.lit("What depends on it")), cues.asked_route(F.lit("else"))) == ["dependency", None]
    assert one(spark, *[cues.walked_route(F.array(*[F.lit(x) for x in k])) for k in (["next", "part_of"], ["recalls", "next"], ["next"], ["other"])]) == ["dependency", "semantic-summary", "timeline", "graph_expansion"]
    assert one(spark, cues.route_priority(F.lit("legacy_path")), cues.kind_bonus(F.lit("timeline"), F.lit(None).cast("string"))) == [1, 0.0]


def test_greedy_walks_against_a_loop(spark):
    rng = random.Random(3)
    links = [(str(rng.randrange(9)), str(rng.randrange(9)), rng.choice(["next", "causes", "recalls"]), rng.choice([0.2, 0.6, 0.9])) for _ in range(25)]
    starts = [(f"{n}-{asked}", str(n), asked) for n in range(9) for asked in (None, "timeline", "dependency", "semantic-summary")]

    def walked(node, asked):
        path, kinds = [node], []
        for _ in range(4):
            out = sorted((kind not in cues.ROUTE_EDGES.get(asked, []), -strength, dst, kind) for src, dst, kind, strength in links if src == path[-1])
            if not out or out[0][2] in path:
                break
            path.append(out[0][2])
            kinds.append(out[0][3])
        return path, kinds

    got = walk.greedy_walk(spark.createDataFrame(starts, "query_id string, node_id string, asked string"), spark.createDataFrame([*links, ("0", None, "next", 1.0)], LINKS), 4)
    assert {r.query_id: (r.path, r.kinds) for r in got.collect()} == {q: walked(n, a) for q, n, a in starts}


def test_greedy_walk_without_links(spark):
    got = walk.greedy_walk(spark.createDataFrame([("q", "a", None)], "query_id string, node_id string, asked string"), spark.createDataFrame([], LINKS), 2)
    assert [tuple(r) for r in got.collect()] == [("q", ["a"], [])]


def test_stream_goes_on_from_its_last_batch(spark, tmp_path):
    rng = random.Random(5)
    log = [(rng.randrange(4), i, rng.choice([True, False, False, None])) for i in range(60)]
    kind = "node long, i long, touched boolean"
    for part in range(3):
        spark.createDataFrame(log[part * 20 : part * 20 + 20], kind).coalesce(1).write.parquet(f"{tmp_path}/in{part}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    rows = {}

    def keep(batch, _):
        for r in batch.collect():
            assert r["n_events"] > rows.get(r["node"], {"n_events": 0})["n_events"]
            rows[r["node"]] = r.asDict()

    query = lifecycle.stream_fold(stream, "node", "i", "touched").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(keep).start()
    assert query.awaitTermination(120)
    # files come in the order they were written
    whole = state.fold(spark.createDataFrame(log, kind), "node", "i", "touched")
    assert {r["node"]: tuple(r)[1:] for r in whole.collect()} == {n: (r["state"], r["count"], r["stability"], r["decay"]) for n, r in rows.items()}
