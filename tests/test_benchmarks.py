"""Cases, reports, consolidation, palaces and the command line on small files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trailmark import __main__ as cli
from trailmark.operators import benchmark, consolidate, graph, palace, questions, suite
from trailmark.sources import bridge, datasets, download, reports, sectioned

TEXT = """# Deal
## goods
1.1 The buyer shall pay for goods on delivery.
1.2 The buyer may withhold payment unless defective goods are replaced.
1.3 The seller may terminate the deal and claim damages if the buyer does not pay.
"""


def case(**more):
    return {"case_id": "c", "query": "may the buyer withhold payment for defective goods", "expectation": {"evidence_node_ids": ["deal:1.2"], **more}}


def write(tmp_path, *cases):
    (tmp_path / "docs").mkdir(exist_ok=True)
    (tmp_path / "docs" / "deal.md").write_text(TEXT)
    p = tmp_path / "set.json"
    p.write_text(json.dumps({"dataset_id": "d", "dataset_name": "D", "domain_pack_name": "contract_pack", "document_directory": "docs", "cases": list(cases)}))
    return str(p)


def test_cases_are_checked(spark, tmp_path):
    good = datasets.read(spark, write(tmp_path, case())).first()
    assert (good["minimum"], good["path_scope"], good["route_scope"], good["roles"]) == (1, "any_path", "best_route", [])
    steps = [{"node_id": "deal:1.2"}]
    for bad in (case(minimum_evidence_matches=2), {"case_id": "", "query": "q", "expectation": {"evidence_node_ids": ["x"]}}, case(path={"steps": []}), case(path={"match_mode": "some", "steps": steps}), case(path={"steps": [{"node_id": "x", "via_edge_type": " "}]}), case(path_scope="no"), case(min_activation_trace_length=3, max_activation_trace_length=2), {"case_id": "c", "query": "q", "expectation": {"evidence_node_ids": []}}):
        with pytest.raises(PySparkException, match="breaks a rule"):
            datasets.read(spark, write(tmp_path, bad)).collect()
    with pytest.raises(PySparkException, match="needs its names"):
        datasets.read(spark, write(tmp_path)).collect()


def test_cases_are_judged(spark, tmp_path):
    path = {"match_mode": "prefix", "steps": [{"node_id": "deal:1.2"}]}
    good = case(path=path, required_semantic_roles=["exception"], required_space_ids=["deal:goods"], required_contradiction_pairs=[["deal:1.2", "deal:1.1"]], required_route_sources=["legacy_path"], min_activation_trace_length=1, required_lifecycle_states={"deal:1.2": "active"})
    bad = good | {"case_id": "d", "expectation": good["expectation"] | {"required_semantic_roles": ["escalation"], "required_lifecycle_states": {"deal:1.2": "archived"}}}
    cases = datasets.read(spark, write(tmp_path, good, bad))
    nodes, edges = sectioned.ingest(sectioned.read(spark, str(tmp_path / "docs")), "contract")
    got = {r["query_id"]: r for r in suite.run(cases.where("query_id = 'c'"), nodes, edges, "weighted_graph").collect()}
    assert got["c"]["hit"] and all(got["c"][h] for h in ("path_hit", "route_hit", "space_hit", "trace_hit", "semantic_hit", "contradiction_hit", "lifecycle_hit")) and got["c"]["snapshot_hit"] is None
    every, summary, both = suite.run_suite(cases, nodes, edges, ["weighted_graph_static", "embedding_baseline"])
    rows = {(r["mode"], r["query_id"]): r for r in every.collect()}
    assert not rows["weighted_graph_static", "d"]["semantic_hit"] and not rows["weighted_graph_static", "c"]["lifecycle_hit"]
    s = {r["mode"]: r for r in summary.collect()}["weighted_graph_static"]
    assert (s["questions"], s["evidence_hit_rate"], s["path_hit_rate"], s["path_hit_cases"], s["snapshot_hit_rate"], s["snapshot_hit_cases"]) == (2, 1.0, 1.0, 2, 0.0, 0)
    assert all(r["missed_by_all"] and r["best_modes"] == [] for r in both.collect())
    text = reports.markdown(benchmark.overall(reports.rates(summary, ["path_hit"]), ["mode"]), "Rates", ["path_hit_rate"])
    assert "| weighted_graph_static | 1.000 (2) |" in text


def test_shapes_with_fields_left_open(spark):
    rows = spark.sql("select array(named_struct('node_id', 'a', 'via_edge_type', cast(null as string)), named_struct('node_id', 'b', 'via_edge_type', 'causes'), named_struct('node_id', 'c', 'via_edge_type', 'next')) as found")
    want = lambda mode, *steps: F.struct(F.lit(mode).alias("match_mode"), F.array(*[F.struct(F.lit(n).alias("node_id"), F.lit(v).cast("string").alias("via_edge_type")) for n, v in steps]).alias("steps"))
    hit = lambda *a: rows.select(benchmark.shape_hit(F.col("found"), want(*a), benchmark.same_step)).first()[0]
    assert hit("exact", ("a", None), ("b", "causes"), ("c", None)) and not hit("exact", ("a", None), ("b", None))
    assert hit("prefix", ("a", None), ("b", "causes")) and not hit("prefix", ("b", None)) and not hit("prefix", ("a", "causes"))
    assert hit("subsequence", ("a", None), ("c", "next")) and not hit("subsequence", ("c", None), ("a", None)) and not hit("subsequence", ("a", None), ("b", "next"))


def palace_tables(spark):
    content = ["page on call in an incident escalation", "escalate the incident and page on call", "the service depends on the queue", "payment dispute over goods"]
    m = spark.createDataFrame([(0, f"m{i}", i, "episodic", t, "ops" if i < 3 else "law", "house", "upper", None, None, "active", 0.5, ["user"], "turn") for i, t in enumerate(content)], "graph_id long, node_id string, ord long, kind string, content string, space_id string, building string, floor string, room string, locus string, state string, stability double, participants array<string>, event_type string")
    from trailmark.functions import text

    m = m.withColumn("role", text.semantic_role(F.col("content"), F.lit("memory"))).withColumns({c: F.lit(None).cast(k) for c, k in (("route_id", "string"), ("start_id", "string"), ("waypoints", "array<string>"), ("route_kind", "string"))})
    route = m.where("node_id = 'm0'").withColumns({"node_id": F.lit("r"), "ord": F.lit(9).cast("long"), "kind": F.lit("route"), "content": F.lit("m1 m2"), "route_id": F.lit("way"), "start_id": F.lit("m0"), "waypoints": F.array(F.lit("m1"), F.lit("m2")), "route_kind": F.lit("timeline")})
    spaces = spark.createDataFrame([(0, "ops", 0, "operations", "house", "upper", None, None, ["incident"]), (0, "law", 1, "contracts", "house", "ground", None, None, [])], "graph_id long, space_id string, ord long, name string, building string, floor string, room string, locus string, tags array<string>")
    links = spark.createDataFrame([(0, "m0", "m1", 0, "next", 0.6, True), (0, "m1", "m2", 1, "depends_on", 0.9, False), (0, "m1", "m3", 2, "causes", 1.0, False)], "graph_id long, src string, dst string, ord long, edge_type string, weight double, bidirectional boolean")
    return m.unionByName(route), spaces, links


def test_recall_of_a_palace(spark):
    m, spaces, links = palace_tables(spark)
    q = spark.createDataFrame([(0, 1, "what comes next when the incident should page on call"), (0, 2, "blub qqqq")], "graph_id long, query_id long, text string")
    got = palace.recall(q, m, spaces, links, palace.Policy(max_spaces=1))
    assert [(r["space_id"], r["reason"]) for r in got.spaces.where("query_id = 1").collect()] == [("ops", "hybrid_max(location_prior)")]
    assert [r["reason"] for r in got.spaces.where("query_id = 2").collect()] == ["fallback_low_confidence_scope"]
    seeds = [r["node_id"] for r in got.seeds.where("query_id = 1").orderBy("seed").collect()]
    assert seeds[0] in ("m0", "m1") and "m3" not in seeds
    top = got.memories.where("query_id = 1").orderBy("rank").collect()
    assert top[0]["node_id"] == seeds[0] and len(top) == 3 and not any(r["fallback"] for r in top)
    # activation stays inside the space, and says so
    assert [r["node_id"] for r in got.snapshot.where("stopped_reason = 'outside_space_scope'").select("node_id").distinct().collect()] == ["m3"]
    routes = got.routes.where("query_id = 1").orderBy("rank").collect()
    assert {"way"} <= {r["route_id"] for r in routes}
    stored = next(r for r in routes if r["route_id"] == "way")
    assert stored["steps"] == ["m0", "m1", "m2"] and stored["route_source"] == "route_memory" and stored["explanation"] == "matches current seeds, matches query content, matches query route intent"
    after = {r["node_id"]: (r["state"], r["count"]) for r in palace.reinforce(m.withColumn("count", F.lit(0).cast("long")), got.memories.where("query_id = 1")).collect()}
    assert after[top[0]["node_id"]] == ("active", 1) and after["m3"][1] == 0
    # the second question shares nothing: the whole graph answers instead, with the first nodes
    assert all(r["fallback"] for r in got.memories.where("query_id = 2").collect())


def test_static_and_dynamic_modes_differ_by_state_only(spark):
    m, spaces, links = palace_tables(spark)
    q = spark.createDataFrame([(0, 1, "page on call in an incident")], "graph_id long, query_id long, text string")
    score = lambda mode, frame: palace.recall(q, frame, spaces, links, palace.Policy(mode)).memories.where("rank = 1").first()["score"]
    encoded = m.withColumn("state", F.lit("encoded"))
    assert score("weighted_graph_static", m) == score("weighted_graph_static", encoded)
    assert score("weighted_graph_dynamic", m) > score("weighted_graph_dynamic", encoded)


def test_consolidation_adds_three_memories_a_group_once(spark):
    m, _, links = palace_tables(spark)
    done = consolidate.consolidate(m, links)
    got = {r["concept_type"]: r for r in done.created.where("scenario = 'incident escalation'").collect()}
    assert set(got) == set(consolidate.CONCEPTS) and got["summary_memory"]["node_id"] == "semantic:incident_escalation:summary_memory"
    assert got["summary_memory"]["content"].startswith("Summary memory for incident escalation: 2 related episodes") and got["summary_memory"]["state"] == "consolidated" and got["summary_memory"]["stability"] == 0.85
    kinds = {(r["edge_type"], r["weight"]) for r in done.links.collect()}
    assert kinds == {("part_of", 0.8), ("recalls", 0.72), ("summarizes", 0.84)}
    assert {r["node_id"] for r in done.sources.collect()} >= {"m0", "m1"} and {r["state"] for r in done.sources.collect()} == {"consolidated"}
    again = consolidate.consolidate(m.unionByName(done.created.select("graph_id", "node_id", "ord", "kind", "content", "space_id"), allowMissingColumns=True), links.select("graph_id", "src", "dst", "edge_type", "weight").unionByName(done.links))
    assert again.created.count() == 0 and again.links.count() == 0


def test_bridge_there_and_back(spark):
    m, _, links = palace_tables(spark)
    n = bridge.to_nodes(m)
    assert {(r["node_id"], r["type"], r["location"]) for r in n.where("node_id in ('m0', 'r')").collect()} == {("m0", "episodic", "house/upper"), ("r", "route", "house/upper")}
    back = bridge.to_memories(n)
    assert {(r["node_id"], r["kind"], r["building"], r["floor"], r["space_id"]) for r in back.where("node_id = 'm3'").collect()} == {("m3", "episodic", "house", "upper", "law")}
    e = graph.add_reverse(bridge.to_edges(links))
    assert {(r["src"], r["dst"], r["edge_type"]) for r in bridge.to_links(e.withColumn("edge_type", F.lit("next_unit"))).collect()} == {("m0", "m1", "recalls"), ("m1", "m0", "recalls"), ("m1", "m2", "recalls"), ("m1", "m3", "recalls")}
    # both directions keep the mark, so they double on the way back
    assert graph.add_reverse(bridge.to_links(e)).count() == 6


def test_command_line(spark, tmp_path, capsys):
    p = write(tmp_path, case())
    cli.main(["search", str(tmp_path / "docs"), "may the buyer withhold payment", "-k", "1"])
    assert "deal:1.2" in capsys.readouterr().out
    cli.main(["benchmark", p, "--modes", "lexical_baseline", "--output", str(tmp_path / "full"), "--summary-output", str(tmp_path / "short")])
    assert json.loads(capsys.readouterr().out)[0]["evidence_hit_rate"] == 1.0
    assert spark.read.json(str(tmp_path / "full")).count() == 1 and spark.read.json(str(tmp_path / "short")).count() == 1
    f = tmp_path / "qa.json"
    f.write_text(json.dumps([{"_id": "s", "question": "alpha beta", "type": "bridge", "context": [["T", ["alpha beta", "gamma"]]], "supporting_facts": [["T", 0]]}]))
    cli.main(["samples", str(f), "--modes", "embedding_baseline"])
    assert json.loads(capsys.readouterr().out)[0]["hit_at_5"] == 1.0


def test_earlier_entry_points(spark, tmp_path):
    write(tmp_path)
    q = tmp_path / "questions.json"
    q.write_text(json.dumps([{"id": "q1", "query": "may the buyer withhold payment", "evidence_node_ids": ["deal:1.2"]}, {"id": "q2", "query": "zzz", "evidence_node_ids": ["deal:9"]}]))
    with pytest.warns(DeprecationWarning):
        got = questions.evaluate_questions(spark, str(tmp_path / "docs"), str(q), "lexical_baseline", detailed=True)
    assert (got["questions"], got["evidence_hit_rate"]) == (2, 0.5) and [r["hit"] for r in got["details"]] == [True, False]


def test_downloads_retry_what_may_pass(tmp_path):
    import io
    import urllib.error

    fail = [urllib.error.HTTPError("u", 503, "busy", {}, None), urllib.error.URLError("no name")]

    def opener(url, timeout):
        if fail:
            raise fail.pop()
        return io.BytesIO(b"data")

    assert download.fetch("u", tmp_path / "a" / "f", pause=0, opener=opener).read_bytes() == b"data" and not list((tmp_path / "a").glob("*.part"))
    fail.append(urllib.error.HTTPError("u", 404, "gone", {}, None))
    with pytest.raises(urllib.error.HTTPError):
        download.fetch("u", tmp_path / "g", pause=0, opener=opener)
    assert not (tmp_path / "g").exists()
