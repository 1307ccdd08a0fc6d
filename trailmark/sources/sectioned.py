"""Sectioned Markdown as nodes and edges of a recall graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import cues, scores, text

@dataclass(frozen=True)
class Pack:
    """How sectioned texts of a domain become nodes and edges.  rules: (edge type, cues, bidirectional), the first that fits decides."""

    name: str
    node_type: str
    weights: dict
    rules: list
    actions: list = field(default_factory=list)
    #: Packs whose graphs are built from samples have no documents to parse.
    parses: bool = True


# fixed values: the weights and edge rules of the two packs, and the words of an action
CONTRACT = Pack("example_contract_pack", "clause", text.CONTRACT_WEIGHTS, [("depends_on", ["subject to", "conditioned on", "if"], False), ("exception_to", ["except", "unless", "notwithstanding"], True), ("causes", ["shall pay", "liable", "terminate", "damages"], False)])
RUNBOOK = Pack("example_runbook_pack", "step", text.RUNBOOK_WEIGHTS, [("depends_on", ["if", "when", "after", "once"], False), ("exception_to", ["unless", "except"], True), ("causes", ["notify", "restart", "roll back", "escalate", "page"], False)], ["notify", "restart", "roll back", "escalate", "verify"])

PACKS: dict[str, Pack] = {p.name: p for p in (CONTRACT, RUNBOOK)} | {"contract_pack": CONTRACT, "contract": CONTRACT, "runbook": RUNBOOK}
for _name in ("hotpotqa_sentence_pack", "longmemeval_session_pack"):
    PACKS[_name] = Pack(_name, "", {}, [], parses=False)


def register(pack: Pack) -> None:
    PACKS[pack.name] = pack


def pack(name: str) -> Pack:
    if name not in PACKS:
        raise ValueError(f"Unknown domain pack {name!r}. Available: {', '.join(sorted(PACKS))}")
    return PACKS[name]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, text) of each Markdown file below path."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return files.select(name.alias("path"), F.regexp_extract(name, r"([^/]+)\.md$", 1).alias("stem"), F.col("value").alias("text"))


def units(documents: DataFrame) -> DataFrame:
    """(path, stem, line, section, number, body, run) of each numbered line; a heading of level two begins a section.

    ``run`` counts the headings so far.  Other lines are passed over.  Null or empty texts have no units.
    """
    lines = documents.select("path", "stem", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("i", "raw")).select("path", "stem", (F.col("i") + 1).alias("line"), F.trim("raw").alias("raw"))
    title = F.when(F.col("raw").rlike(r"^##\s+\S"), text.slug(F.regexp_extract("raw", r"^##\s+(.+)$", 1)))
    so_far = Window.partitionBy("path").orderBy("line")
    marked = lines.withColumn("_title", title).withColumn("section", F.coalesce(F.last("_title", True).over(so_far), F.lit("root"))).withColumn("run", F.count("_title").over(so_far))
    shape = r"^(\d+(?:\.\d+)*)\s+(.+)$"
    return marked.where(F.col("raw").rlike(shape)).select("path", "stem", "line", "section", F.regexp_extract("raw", shape, 1).alias("number"), F.regexp_extract("raw", shape, 2).alias("body"), "run")


def nodes(parsed: DataFrame, pack_name: str) -> DataFrame:
    """Nodes of the pack's type with role, tags, weights, evidence and attributes; ``ord`` is (path, line)."""
    own = pack(pack_name)
    place = {"document_id": F.col("stem"), "section": F.col("section"), "unit_number": F.col("number"), f"{own.node_type}_number": F.col("number"), "domain_pack": F.lit(own.name)}
    n = parsed.select(F.concat_ws(":", "stem", "number").alias("node_id"), F.struct("path", "line").alias("ord"), F.lit(own.node_type).alias("type"), F.col("body").alias("content"), F.concat_ws(":", "stem", "section").alias("space_id"), "run", *[c.alias(k) for k, c in place.items()], F.struct(F.col("path").alias("source_path"), F.col("number").alias("section_id"), F.col("line").alias("line_start"), F.col("line").alias("line_end")).alias("source_ref"))
    if own.actions:
        n = n.withColumn("contains_action", text.any_in(F.lower("content"), own.actions))
    n = n.withColumn("role", text.semantic_role(F.col("content"), F.col("type"))).select("*", *[c.alias(k) for k, c in text.weights(F.col("content"), own.weights).items()])
    n = n.select("*", scores.bounded_weight(F.col("importance"), F.col("risk"), F.col("novelty"), F.col("confidence")).alias("weight"), text.scenario_tags(F.col("content")).alias("scenario_tags"), text.symbolic_tags(F.col("content"), F.col("role")).alias("symbolic_tags"))
    return n.select("*", cues.trigger_phrases(F.col("content"), F.col("scenario_tags")).alias("phrases"), cues.trigger_situations(F.col("scenario_tags"), F.col("symbolic_tags")).alias("situations"))


def next_edges(built: DataFrame) -> DataFrame:
    """Each node to the next of its section, weight 0.4, valid both ways."""
    w = Window.partitionBy("ord.path", "run").orderBy("ord.line")
    rows = built.select(F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst")).where("dst is not null")
    return rows.select("src", "dst", F.lit("next_unit").alias("edge_type"), F.lit(0.4).alias("weight"), F.lit(True).alias("bidirectional"))


def ingest(documents: DataFrame, pack_name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges tables (operators.graph) of one graph from documents (path, stem, text), in the order of their paths.

    Edges stand in the order in which they would be added: node after node, first the step to it, then its edges to
    earlier nodes.  Units are few beside what the texts hold, so their numbering by one sort is no bottleneck for the
    documents of a graph; graphs of a corpus are told apart by graph_id and numbered each on its own.
    """
    own = pack(pack_name)
    if not own.parses:
        raise ValueError(f"the graphs of {own.name} are built from samples")
    docs = documents if "graph_id" in documents.columns else documents.withColumn("graph_id", F.lit(0).cast("long"))
    built = nodes(units(docs), pack_name).join(docs.select("graph_id", F.col("path").alias("_path")), F.col("ord.path") == F.col("_path")).drop("_path")
    once = Window.partitionBy("graph_id", "node_id").orderBy(F.desc("ord"))
    # a number that comes again replaces the payload and keeps its first place
    built = built.withColumn("_first", F.min("ord").over(Window.partitionBy("graph_id", "node_id"))).withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    built = built.withColumn("number_", F.row_number().over(Window.partitionBy("graph_id").orderBy("_first")).cast("long"))
    at = built.select("graph_id", "node_id", "number_", "content", "run", "ord")
    steps = at.withColumn("dst", F.lead("node_id").over(Window.partitionBy("graph_id", "ord.path", "run").orderBy("ord.line"))).withColumn("to", F.lead("number_").over(Window.partitionBy("graph_id", "ord.path", "run").orderBy("ord.line"))).where("dst is not null")
    steps = steps.select("graph_id", F.col("node_id").alias("src"), "dst", F.struct(F.col("to").alias("a"), F.lit(-1).cast("long").alias("b")).alias("_at"), F.lit("next_unit").alias("edge_type"), F.lit(0.4).alias("weight"), F.lit(True).alias("bidirectional"))
    found = semantic_edges(at.select("graph_id", "node_id", F.col("number_").alias("ord"), "content"), pack_name)
    place = lambda c, name: at.select("graph_id", F.col("node_id").alias(c), F.col("number_").alias(name))
    found = found.join(place("src", "_a"), ["graph_id", "src"]).join(place("dst", "_b"), ["graph_id", "dst"]).select("graph_id", "src", "dst", F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")).alias("_at"), "edge_type", "weight", "bidirectional")
    edges = steps.unionByName(found).withColumn("ord", F.row_number().over(Window.partitionBy("graph_id").orderBy("_at")).cast("long"))
    edges = edges.select("graph_id", "src", "dst", "ord", "edge_type", "weight", F.lit(0.95).alias("confidence"), "bidirectional")
    return built.drop("ord", "_first").withColumnRenamed("number_", "ord"), edges


def ingest_contract(documents: DataFrame, pack_name: str = "example_contract_pack") -> tuple[DataFrame, DataFrame]:
    """ingest() for contracts only."""
    if pack(pack_name) is not CONTRACT:
        raise ValueError("only contracts are ingested here")
    return ingest(documents, pack_name)


def _rule(content: Column, rules: list, pick) -> Column:
    low, out = F.lower(content), F.when(F.lit(False), F.lit(pick(rules[0])))
    for rule in rules:
        out = out.when(text.any_in(low, rule[1]), F.lit(pick(rule)))
    return out


def semantic_edges(built: DataFrame, pack_name: str, shared: int = 2) -> DataFrame:
    """(src, dst, edge_type, weight, bidirectional): each later node with a cue to the earlier ones that share tokens.

    With graph_id, nodes meet within their graph only, and rows carry it.  All rules ask for the same number of shared
    tokens, so the first rule whose cue the later text has decides, and only nodes with a rule are sought.  Pairs meet
    through their two rarest tokens' postings: of two texts that share two tokens, one of the shared tokens is not
    the most frequent token of the later text, so each later node leaves its most frequent token out of the search
    and the pair is still met; the pairs met are then counted over all tokens.
    """
    rules = pack(pack_name).rules
    key = ["graph_id"] if "graph_id" in built.columns else []
    tokens = F.array_distinct(text.tokens(F.col("content")))
    rows = built.select(*key, "node_id", "ord", "content", tokens.alias("_t"))
    post = rows.select(*key, "node_id", "ord", F.explode("_t").alias("token"))
    often = post.groupBy(*key, "token").agg(F.count(F.lit(1)).alias("_df"))
    later = rows.withColumn("edge_type", _rule(F.col("content"), rules, lambda r: r[0])).where("edge_type is not null and size(_t) >= " + str(shared))
    own = later.select(*key, F.col("node_id").alias("src"), F.col("ord").alias("_o"), "edge_type", F.explode("_t").alias("token")).join(often, [*key, "token"])
    rank = F.row_number().over(Window.partitionBy(*key, "src").orderBy("_df", "token"))
    rarest = own.withColumn("_r", rank).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key, "src"))).where(F.col("_r") <= F.col("_n") - (shared - 1))
    met = rarest.select(*key, "src", "_o", "edge_type", "token").join(post.select(*key, F.col("node_id").alias("dst"), "ord", "token"), [*key, "token"]).where((F.col("ord") < F.col("_o")) & (F.col("src") != F.col("dst"))).select(*key, "src", "dst", "edge_type").distinct()
    words = lambda c: rows.select(*key, F.col("node_id").alias(c), F.col("_t").alias(f"_{c}"))
    kept = met.join(words("src"), [*key, "src"]).join(words("dst"), [*key, "dst"]).where(F.size(F.array_intersect("_src", "_dst")) >= shared)
    return kept.select(*key, "src", "dst", "edge_type", F.lit(0.7).alias("weight"), F.col("edge_type").isin([r[0] for r in rules if r[2]]).alias("bidirectional"))
