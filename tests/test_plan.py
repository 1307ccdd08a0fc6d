"""Sources, planning and policies on small inputs."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trailmark.operators import graph, plan, state
from trailmark.sources import samples, sectioned

MARKDOWN = """# Title
1.1 The buyer shall pay each invoice.
## Late Goods
2.1 The buyer shall pay the invoice after delivery.
not numbered
2.2 Goods may be withheld unless the buyer shall pay the invoice.
"""


def built(spark, tmp_path):
    (tmp_path / "deal.md").write_text(MARKDOWN)
    return sectioned.nodes(sectioned.units(sectioned.read(spark, str(tmp_path))), "contract")


def test_sections_and_chains(spark, tmp_path):
    n = built(spark, tmp_path)
    assert [(r.node_id, r.space_id, r.role) for r in n.orderBy("ord").collect()] == [("deal:1.1", "deal:root", "obligation"), ("deal:2.1", "deal:late-goods", "condition"), ("deal:2.2", "deal:late-goods", "exception")]
    assert [(r.src, r.dst) for r in sectioned.next_edges(n).collect()] == [("deal:2.1", "deal:2.2")]


def test_semantic_edges_against_loops(spark, tmp_path):
    n = built(spark, tmp_path)
    e = sectioned.semantic_edges(n, "contract")
    # each text has "shall pay", which causes; the last one's "unless" comes earlier in the rules
    assert {(r.src, r.dst, r.edge_type, r.bidirectional) for r in e.collect()} == {("deal:2.1", "deal:1.1", "causes", False), ("deal:2.2", "deal:1.1", "exception_to", True), ("deal:2.2", "deal:2.1", "exception_to", True)}
    one = F.lit(0).alias("graph_id")
    pairs = graph.contradictions(n.select("*", one), graph.add_reverse(e.select("*", one, F.lit(1).alias("ord"))))
    assert {tuple(r)[1:] for r in pairs.collect()} == {("deal:1.1", "deal:2.2"), ("deal:2.1", "deal:2.2")}
    nodes, edges = sectioned.ingest(sectioned.read(spark, str(tmp_path)), "contract_pack")
    assert [(r["node_id"], r["ord"], r["source_ref"]["section_id"]) for r in nodes.orderBy("ord").collect()] == [("deal:1.1", 1, "1.1"), ("deal:2.1", 2, "2.1"), ("deal:2.2", 3, "2.2")]
    assert [(r["src"], r["dst"], r["edge_type"]) for r in edges.orderBy("ord").collect()] == [("deal:2.1", "deal:1.1", "causes"), ("deal:2.1", "deal:2.2", "next_unit"), ("deal:2.2", "deal:1.1", "exception_to"), ("deal:2.2", "deal:2.1", "exception_to")]


def test_empty_documents_have_no_units(spark):
    d = spark.createDataFrame([("a", "a", None), ("b", "b", ""), ("c", "c", "## only")], "path string, stem string, text string")
    assert sectioned.units(d).count() == 0
    with pytest.raises(ValueError, match="Available: contract"):
        sectioned.pack("poem")


def test_qa_samples(spark, tmp_path):
    p = tmp_path / "qa.json"
    context = [["The \uff34itle", ["one ", "two"]], ["the title", ["three"]], ["?!", ["four"]]]
    p.write_text(json.dumps([{"_id": "s", "question": "q", "type": "bridge", "context": context, "supporting_facts": [["THE  title", 1], ["the title", 0], ["THE title", 1]]}]))
    s = samples.read_qa(spark, str(p))
    n = samples.qa_nodes(s)
    assert [(r.node_id, r.content) for r in n.orderBy("ord").collect()] == [("the_title:0", "one"), ("the_title:1", "two"), ("the_title__2:0", "three"), ("title:0", "four")]
    assert [(r.src, r.dst) for r in samples.qa_edges(n).collect()] == [("the_title:0", "the_title:1")]
    # all three facts name the first paragraph whose title is alike
    case = samples.qa_cases(s).first()
    assert case.evidence == ["the_title:1", "the_title:0"] and case.minimum == 2 and case.tags == ["hotpotqa", "public", "bridge"]
    p.write_text(json.dumps([{"_id": "s", "question": "q"}]))
    with pytest.raises(PySparkException):
        samples.read_qa(spark, str(p)).collect()
    p.write_text(json.dumps([{"_id": "s", "question": "q", "context": context, "supporting_facts": [["other", 0]]}]))
    with pytest.raises(PySparkException, match="no paragraph"):
        samples.qa_gold(samples.read_qa(spark, str(p))).collect()


def test_sessions(spark, tmp_path):
    p, chat = tmp_path / "s.json", [[{"role": "user", "content": " hi ", "has_answer": True}], [{"role": "", "content": "x"}, {"role": "user", "content": ""}]]
    one = {"question_id": "q", "question": "?", "haystack_session_ids": ["a b", "b"], "haystack_sessions": chat, "answer_session_ids": ["b", "b"]}
    p.write_text(json.dumps([one]))
    read = samples.read_sessions(spark, str(p))
    m = samples.session_memories(read)
    assert [(r.node_id, r.content, r.participants, r.recency) for r in m.where("kind = 'episodic'").orderBy("ord").collect()] == [("q:a_b", "[Turn 1] user: hi [gold_turn]", ["user"], 0.4), ("q:b", "[Turn 1] unknown: x", ["unknown", "user"], 1.0)]
    assert [(r.src, r.dst, r.edge_type) for r in samples.session_edges(m).orderBy("ord").collect()] == [("q:a_b", "q:b", "next"), ("q:route:timeline", "q:a_b", "route_to"), ("q:route:timeline", "q:b", "route_to")]
    assert [(r.space_id, r.name, r.tags) for r in samples.session_spaces(m).orderBy("ord").collect()] == [("q:space:a_b", "session-a b", ["longmemeval", "unknown"]), ("q:space:b", "session-b", ["longmemeval", "unknown"])]
    assert samples.session_cases(read).first().evidence == ["q:b"]
    p.write_text(json.dumps([one | {"answer_session_ids": ["c"]}]))
    with pytest.raises(PySparkException):
        samples.read_sessions(spark, str(p)).collect()


def test_routes_merge_by_priority(spark):
    r = spark.createDataFrame([("q", ["a", "b"], "k", 1, 0.9), ("q", ["a", "b"], "k", 2, 0.1), ("q", ["c"], "k", 1, 0.5)], "query_id string, steps array<string>, kind string, priority int, score double")
    assert [(x.steps, x.score) for x in plan.merge_routes(r, 5).orderBy("rank").collect()] == [(["a", "b"], 0.1), (["c"], 0.5)]


def test_shapes(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    row = spark.range(1).select(plan.matches(a("a", "c"), a("a", "b", "c"), "subsequence"), plan.matches(a("c", "a"), a("a", "b", "c"), "subsequence"), plan.matches(a("a", "b"), a("a", "b", "c"), "prefix"), plan.matches(a("a"), a("a", "b"), "exact")).first()
    assert list(row) == [True, False, True, False]


def test_dynamic_policy(spark):
    r = spark.range(1).select(state.policy_reinforce(state.start()).alias("t"), state.policy_decay(state.start()).alias("d")).first()
    assert (r.t.count if not callable(r.t.count) else r.t["count"], r.t.state, r.d.decay) == (1, "active", 0.9)
