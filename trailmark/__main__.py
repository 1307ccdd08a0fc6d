"""python -m trailmark search|benchmark|sessions|samples|report: searches and benchmarks of files on the command line."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import benchmark, modes, search, suite
from trailmark.sources import bridge, datasets, reports, samples, sectioned, storage


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trailmark")
    sub = p.add_subparsers(dest="what", required=True)
    s = sub.add_parser("search", help="ask sectioned documents")
    s.add_argument("documents")
    s.add_argument("question")
    s.add_argument("--pack", default="contract")
    s.add_argument("--mode", default="weighted_graph")
    s.add_argument("--baseline", action="store_true", help="search by words first, on the same memory")
    b = sub.add_parser("benchmark", help="run a dataset of cases")
    b.add_argument("dataset")
    b.add_argument("--documents", help="default: the dataset's own folder of documents")
    b.add_argument("--modes", nargs="+", default=modes.DEFAULT_MODES)
    r = sub.add_parser("report", help="hit rates of several datasets as Markdown")
    r.add_argument("datasets", nargs="+")
    r.add_argument("--modes", nargs="+", default=["weighted_graph", "activation_spreading_v1"])
    for name in ("samples", "sessions"):
        x = sub.add_parser(name, help=f"run a file of {name}")
        x.add_argument("file")
        x.add_argument("--modes", nargs="+", default=["embedding_baseline", "weighted_graph"])
        x.add_argument("--limit", type=int, help="only so many of the file's samples")
    for x in sub.choices.values():
        x.add_argument("-k", type=int, default=3)
        x.add_argument("--output", help="folder for the full reports as JSON")
        x.add_argument("--summary-output", help="folder for the summary as JSON")
    return p


def _dataset(spark: SparkSession, path: str, folder: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    cases = storage.keep(datasets.read(spark, path), "cases")
    first = cases.select("domain_pack_name", "document_directory").first()
    documents = sectioned.read(spark, folder or str((Path(path).parent / first["document_directory"]).resolve()))
    return cases, *(storage.keep(t, "ingested") for t in sectioned.ingest(documents, first["domain_pack_name"]))


def public(spark: SparkSession, cases: DataFrame, nodes: DataFrame, edges: DataFrame, names: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(results by case, report) of public samples, each sample's graph searched for its own question."""
    every = None
    for name in names:
        how = modes.mode(name)
        found = modes.search_once(cases, nodes, edges, how, k)
        memories, _ = search.recalled(found.paths)
        gold = cases.select("query_id", F.explode("evidence").alias("node_id"))
        rows = benchmark.public_results(search.ranked_ids(memories, max(k, 10)), gold, cases.select("query_id", F.element_at("tags", -1).alias("type"), F.lit(name).alias("mode")))
        every = rows if every is None else every.unionByName(rows)
    every = storage.keep(every, "public")
    return every, benchmark.public_report(every, ["mode"], ["type"])


def main(arguments: list[str] | None = None) -> None:
    a = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName("trailmark").getOrCreate()
    if a.what == "search":
        nodes, edges = sectioned.ingest(sectioned.read(spark, a.documents), a.pack)
        question = spark.createDataFrame([(0, "question", a.question)], "graph_id long, query_id string, text string")
        if a.baseline:
            found, nodes = modes.search_in_turn(question, nodes, edges, modes.Mode("lex", modes.StatePolicy()), k=a.k)
            print(reports.told(found.paths, found.trace))
        found, _ = modes.search_in_turn(question, nodes, edges, modes.mode(a.mode), k=a.k)
        print(reports.told(found.paths, found.trace))
        return
    if a.what == "report":
        parts = None
        for path in a.datasets:
            _, summary, _ = suite.run_suite(*_dataset(spark, path, None), a.modes, a.k)
            rows = reports.rates(summary, ["path_hit", "route_hit", "space_hit", "lifecycle_hit", "trace_hit", "snapshot_hit"])
            parts = rows if parts is None else parts.unionByName(rows)
        total = storage.keep(benchmark.overall(parts, ["mode"]), "overall")
        print(reports.markdown(total, "Hit rates", ["path_hit_rate", "route_hit_rate", "space_hit_rate", "lifecycle_hit_rate", "trace_hit_rate", "snapshot_hit_rate"]))
        summary, full = total, parts
    elif a.what == "benchmark":
        full, summary, _ = suite.run_suite(*_dataset(spark, a.dataset, a.documents), a.modes, a.k)
    else:
        read = samples.read_qa if a.what == "samples" else samples.read_sessions
        rows = read(spark, a.file)
        rows = rows.limit(a.limit) if a.limit else rows
        if a.what == "samples":
            nodes, edges, cases = samples.qa_nodes(rows), None, samples.qa_cases(rows)
            edges = samples.qa_edges(nodes)
        else:
            memories, cases = samples.session_memories(rows), samples.session_cases(rows)
            nodes, edges = bridge.to_nodes(memories), bridge.to_edges(samples.session_edges(memories))
        full, summary = public(spark, cases, nodes, edges, a.modes, a.k)
    if a.output:
        reports.write_json(full, a.output)
    if a.summary_output:
        reports.write_json(summary, a.summary_output)
    if a.what != "report":
        print(json.dumps([r.asDict(True) for r in summary.collect()], default=str, indent=1))


if __name__ == "__main__":
    main()
