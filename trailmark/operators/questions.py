"""Earlier entry points: plain question files over contracts, summarised as dictionaries.  suite.run() and run_suite() replace them."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from trailmark.operators import suite
from trailmark.sources import datasets, sectioned, storage

MODES = {"lexical_baseline": "baseline", "embedding_baseline": "embedding", "structure_only": "structure_only", "weighted_graph": "weighted"}


def _ready(spark: SparkSession, contracts: str, questions: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = sectioned.ingest(sectioned.read(spark, contracts), "example_contract_pack")
    cases = datasets.read_questions(spark, questions)
    return cases.withColumn("ord", cases["query_id"]), storage.keep(nodes, "contracts"), storage.keep(edges, "contract-edges")


def _summary(reports: DataFrame, detailed: bool) -> dict:
    rows = sorted((r.asDict(True) for r in reports.collect()), key=lambda r: str(r["query_id"]))
    rate = lambda c: sum(bool(r[c]) for r in rows) / len(rows) if rows else 0.0
    out = {"questions": len(rows), "evidence_hit_rate": rate("evidence_hit"), "evidence_recall": rate("hit"), "avg_latency_ms": round(sum(r["latency_ms"] for r in rows) / len(rows), 3) if rows else 0.0}
    return out | ({"details": rows} if detailed else {})


def _deprecated(name: str) -> None:
    warnings.warn(f"{name} is deprecated, use operators.suite", DeprecationWarning, stacklevel=3)


def evaluate_questions(spark: SparkSession, contracts: str, questions: str, mode: str, k: int = 3, detailed: bool = False) -> dict:
    """Hit rates of one mode over a question file; one match of a question's evidence is a hit."""
    _deprecated("evaluate_questions")
    return _summary(suite.run(*_ready(spark, contracts, questions), mode, k), detailed)


def evaluate_all(spark: SparkSession, contracts: str, questions: str, k: int = 3, detailed: bool = False) -> dict:
    """evaluate_questions() for the four modes, with what each question's best modes are."""
    _deprecated("evaluate_all")
    ready = _ready(spark, contracts, questions)
    every, _, both = suite.run_suite(*ready, list(MODES), k)
    out = {name: _summary(every.where(every["mode"] == mode), detailed) for mode, name in MODES.items()}
    compared = sorted((r.asDict(True) for r in both.collect()), key=lambda r: str(r["query_id"]))
    return out | {"comparison": [{"question_id": r["query_id"], "best_modes": r["best_modes"], "missed_by_all": r["missed_by_all"]} for r in compared]}
