"""Sinks: reports as JSON through Spark's writer, and as Markdown or text for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines; another run replaces them."""
    reports.write.mode("overwrite").json(path)


def suite_row(dataset_id: str, summaries: DataFrame, reports: DataFrame) -> DataFrame:
    """A whole suite as one row: dataset_id and, by mode, its summary and case reports; for suites of bounded size."""
    cases = reports.groupBy("mode").agg(F.sort_array(F.collect_list(F.struct("query_id", *[c for c in reports.columns if c not in ("query_id", "mode")]))).alias("case_reports"))
    rows = summaries.join(cases, "mode", "left")
    return rows.agg(F.sort_array(F.collect_list(F.struct("mode", *[c for c in rows.columns if c != "mode"]))).alias("modes")).select(F.lit(dataset_id).alias("dataset_id"), "modes")


def compact(results: DataFrame) -> DataFrame:
    """What a public benchmark says of each mode, without its cases."""
    return results.select("mode", "cases", "hit_at_5", "hit_at_10", "ndcg_at_10")


def case_summary(results: DataFrame) -> DataFrame:
    """What was recalled of each case's gold."""
    return results.select("query_id", "mode", "gold", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks"), (F.size("ranks") > 0).alias("recalled"))


def markdown(summaries: DataFrame, title: str, metrics: list[str]) -> str:
    """A table of metrics by mode, with the number of cases; summaries: (mode, metric, rate, cases), a row per mode and metric."""
    rows = {(r["mode"], r["metric"]): r for r in summaries.collect()}
    names = sorted({m for m, _ in rows})
    out = [f"# {title}", "", "| Mode | " + " | ".join(metrics) + " |", "|---|" + "---|" * len(metrics)]
    for mode in names:
        cells = [f"{r['rate']:.3f} ({r['cases']})" if (r := rows.get((mode, m))) else "-" for m in metrics]
        out.append(f"| {mode} | " + " | ".join(cells) + " |")
    return "\n".join(out) + "\n"


def rates(summary: DataFrame, hits: list[str]) -> DataFrame:
    """mode_report() with a row for each mode and kind of hit: (mode, metric, rate, cases)."""
    parts = F.array(*[F.struct(F.lit(f"{h}_rate").alias("metric"), F.col(f"{h}_rate").alias("rate"), F.col(f"{h}_cases").alias("cases")) for h in hits])
    return summary.select("mode", F.inline(parts))


def told(paths: DataFrame, trace: DataFrame) -> str:
    """Paths and their traces as lines of text, for a handful of questions."""
    out = []
    steps = {}
    for r in trace.orderBy("query_id", "seed", "step").collect():
        steps.setdefault((r["query_id"], r["seed"]), []).append(r)
    for p in paths.orderBy("query_id", F.desc("final_score"), "seed").collect():
        out.append(f"{p['query_id']}: {p['answer']} [{p['final_score']:.3f}]")
        out += [f"  {s['node_id']}" + (f" via {s['via_edge_type']}" if s["via_edge_type"] else "") + f": {s['reason']} [{s['score']:.3f}]" for s in p["steps"]]
        out += [f"    {r['source_id'] or 'seed'} -> {r['node_id']} hop {r['hop']}: {r['propagated']:.3f}" + (f" ({r['stopped_reason']})" if r["stopped_reason"] else "") for r in steps.get((p["query_id"], p["seed"]), [])]
    return "\n".join(out)
