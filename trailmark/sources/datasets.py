"""Benchmark datasets in JSON: typed, checked, as one row per case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEPS = "struct<match_mode: string, steps: array<struct<node_id: string, via_edge_type: string>>>"
_TRACE = "struct<match_mode: string, steps: array<struct<node_id: string, edge_type: string, hop: int, is_seed: boolean, stopped_reason: string>>>"
_LISTS = ["edge_types", "space_ids", "semantic_roles", "scenario_tags", "symbolic_tags", "consolidation_kinds", "trace_stop_reasons", "route_sources"]
_EXPECTED = f"struct<evidence_node_ids: array<string>, minimum_evidence_matches: int, path: {_STEPS}, route: {_STEPS}, activation_trace: {_TRACE}, activation_snapshot: {_TRACE}, path_scope: string, route_scope: string, {', '.join(f'required_{c}: array<string>' for c in _LISTS)}, required_contradiction_pairs: array<array<string>>, min_activation_trace_length: int, max_activation_trace_length: int, required_lifecycle_states: map<string, string>>"
SCHEMA = f"dataset_id string, dataset_name string, domain_pack_name string, document_directory string, cases array<struct<case_id: string, query: string, tags: array<string>, expectation: {_EXPECTED}>>"
MODES = ["subsequence", "prefix", "exact"]
#: Names of the expectations as operators.benchmark has them.
NAMES = {"edge_types": "edge_types", "space_ids": "space_ids", "semantic_roles": "roles", "scenario_tags": "scenario_tags", "symbolic_tags": "symbolic_tags", "consolidation_kinds": "kinds", "trace_stop_reasons": "stop_reasons", "route_sources": "route_sources"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cases of the datasets at path, in order: dataset_id, domain_pack_name, document_directory, ord, query_id, text, tags and what is expected.

    Reading fails where a dataset lacks a name or cases, a case its id, query or evidence, asks for more matches than it
    has evidence, has a path without steps, an unknown match mode or scope, or bounds of a trace that exclude each other.
    """
    rows = spark.read.schema(SCHEMA).json(path, multiLine=True)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = F.lit(False)
    for c in ("dataset_id", "dataset_name", "domain_pack_name", "document_directory"):
        bad = bad | blank(F.col(c))
    kind = rows.schema["cases"].dataType
    bad = bad | (F.size(F.coalesce("cases", F.array().cast(kind))) == 0)
    rows = rows.withColumn("cases", F.when(bad, F.raise_error(F.lit("a dataset needs its names and cases")).cast(kind)).otherwise(F.col("cases")))
    rows = rows.select("dataset_id", "dataset_name", "domain_pack_name", "document_directory", F.posexplode("cases").alias("ord", "c")).select("*", "c.case_id", "c.query", "c.tags", "c.expectation.*").drop("c")
    least = F.coalesce("minimum_evidence_matches", F.lit(1))
    wrong = blank(F.col("case_id")) | blank(F.col("query")) | F.col("evidence_node_ids").isNull() | (F.size("evidence_node_ids") == 0) | (least < 1) | (least > F.size("evidence_node_ids"))
    for c in ("path", "route", "activation_trace", "activation_snapshot"):
        shape = F.col(c)
        wrong = wrong | (shape.isNotNull() & ((F.size(F.coalesce(shape["steps"], F.array().cast(rows.schema[c].dataType["steps"].dataType))) == 0) | ~F.coalesce(shape["match_mode"], F.lit("subsequence")).isin(MODES) | F.exists(shape["steps"], lambda s: blank(s["node_id"]))))
        if c in ("path", "route"):
            wrong = wrong | F.coalesce(F.exists(shape["steps"], lambda s: F.coalesce(F.trim(s["via_edge_type"]) == "", F.lit(False))), F.lit(False))
    wrong = wrong | ~F.coalesce("path_scope", F.lit("any_path")).isin("any_path", "best_path") | ~F.coalesce("route_scope", F.lit("best_route")).isin("any_route", "best_route")
    wrong = wrong | F.coalesce(F.col("max_activation_trace_length") < F.col("min_activation_trace_length"), F.lit(False))
    text = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.concat(F.lit("case "), F.coalesce("case_id", F.lit("?")), F.lit(" breaks a rule"))).cast("string")).otherwise(F.col("query"))
    shaped = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.coalesce(F.col(c)["match_mode"], F.lit("subsequence")).alias("match_mode"), F.col(c)["steps"].alias("steps")))
    listed = [F.coalesce(f"required_{c}", F.array().cast("array<string>")).alias(n) for c, n in NAMES.items()]
    return rows.select("dataset_id", "domain_pack_name", "document_directory", "ord", F.col("case_id").alias("query_id"), text.alias("text"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("evidence_node_ids").alias("evidence"), least.alias("minimum"), shaped("path").alias("path"), shaped("route").alias("route"), shaped("activation_trace").alias("trace"), shaped("activation_snapshot").alias("snapshot"), F.coalesce("path_scope", F.lit("any_path")).alias("path_scope"), F.coalesce("route_scope", F.lit("best_route")).alias("route_scope"), *listed, F.col("required_contradiction_pairs").alias("contradictions"), F.col("min_activation_trace_length").alias("least_trace"), F.col("max_activation_trace_length").alias("most_trace"), F.col("required_lifecycle_states").alias("lifecycle"), F.lit(0).cast("long").alias("graph_id"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Plain question files as cases: (id, query, tags, evidence_node_ids) of which one match is enough."""
    rows = spark.read.schema("id string, query string, tags array<string>, evidence_node_ids array<string>").json(path, multiLine=True)
    return rows.select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("query_id"), F.col("query").alias("text"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("evidence_node_ids").alias("evidence"), F.lit(1).alias("minimum"))
