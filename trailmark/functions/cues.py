"""How well a memory answers the wording of a question: triggers, intent, roles, places and kinds of routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions import text

# fixed values: phrases and situations that call up a memory, and the words of questions
SCENARIO_PHRASES = {
    "payment dispute": ["payment dispute", "defective goods", "invoice dispute"],
    "rollback failure": ["rollback failure", "rollback does not recover", "queue drain"],
    "exception override": ["exception override", "unless clause", "override rule"],
    "incident escalation": ["incident escalation", "page on call", "escalate immediately"],
    "causal recovery": ["service dependency", "depends on", "recovery cause"],
}
LITERAL_PHRASES = ["rollback failure", "payment dispute", "exception override", "queue drain", "worker restart", "defective goods"]
SITUATIONS = {
    "urgency": "when urgency is high",
    "exception": "when an exception applies",
    "escalation": "when escalation is required",
    "causal": "when a dependency chain is involved",
}
ROLE_QUESTIONS = [
    (["escalation"], ["escalate", "escalation", "page", "who should"], 1.0),
    (["exception"], ["unless", "except", "override", "exception", "notwithstanding"], 1.0),
    (["remedy", "action"], ["recover", "restart", "resolve", "what should", "what do"], 0.8),
    (["condition"], ["if", "when", "after", "once", "under what"], 0.6),
]
ROUTE_QUESTIONS = [
    ("timeline", ["timeline", "sequence", "before", "after", "first", "next"]),
    ("dependency", ["dependency", "depends", "because", "cause", "causal"]),
    ("exception", ["exception", "override", "unless", "contradict"]),
    ("semantic-summary", ["summary", "general rule", "abstract", "pattern"]),
]
# fixed values: the kinds of edges on each kind of route, the order of sources of routes, and the shares of a place's parts
ROUTE_EDGES = {
    "timeline": ["next"],
    "dependency": ["depends_on", "part_of", "causes"],
    "exception": ["exception_to", "contradicts"],
    "semantic-summary": ["summarizes", "recalls", "part_of"],
}
EDGE_KINDS = [("exception", ["exception_to", "contradicts"]), ("dependency", ["depends_on", "part_of", "causes"]), ("semantic-summary", ["summarizes", "recalls"]), ("timeline", ["next"])]
ROUTE_PRIORITY = {"route_memory": 3, "native_activation": 2, "legacy_path": 1}
PLACE_SHARES = {"building": 0.35, "floor": 0.2, "room": 0.35, "locus": 0.15, "tags": 0.15, "name": 0.2}


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def trigger_phrases(content: Column, scenarios: Column) -> Column:
    """The phrases of each scenario (a scenario without phrases is its own) and the literal ones that stand in content; sorted."""
    known = F.array(*[F.when(F.array_contains(scenarios, s), _strings(p)).otherwise(_strings([])) for s, p in SCENARIO_PHRASES.items()])
    own = F.filter(scenarios, lambda s: ~s.isin(list(SCENARIO_PHRASES)))
    said = F.filter(_strings(LITERAL_PHRASES), lambda p: F.contains(F.lower(content), p))
    return F.sort_array(F.array_distinct(F.concat(F.flatten(known), own, said)))


def trigger_situations(scenarios: Column, symbols: Column) -> Column:
    around = F.flatten(F.transform(scenarios, lambda s: F.array(F.concat(F.lit("during "), s), F.concat(F.lit("after "), s))))
    by_symbol = F.array_compact(F.array(*[F.when(F.array_contains(symbols, s), F.lit(w)) for s, w in SITUATIONS.items()]))
    return F.sort_array(F.array_distinct(F.concat(around, by_symbol)))


def trigger_score(query: Column, words: Column, phrases: Column, situations: Column, scenarios: Column, symbols: Column) -> Column:
    """0.3 a phrase said, 0.18 a situation with two words asked for, 0.25 a scenario asked for in full, 0.12 a symbol named; at most 1.

    words: the query's distinct tokens, as a column of their own, so that they are not cut again for each element.
    """
    low = F.lower(query)
    said = F.size(F.filter(phrases, lambda p: (p != "") & F.contains(low, p)))
    met = F.size(F.filter(situations, lambda s: F.size(F.array_intersect(text.tokens(s), words)) >= 2))
    asked = F.size(F.filter(F.transform(scenarios, text.tokens), lambda t: (F.size(t) > 0) & (F.size(F.array_except(t, words)) == 0)))
    named = F.size(F.filter(symbols, lambda s: F.contains(low, s)))
    return F.round(F.least(F.lit(1.0), 0.3 * said + 0.18 * met + 0.25 * asked + 0.12 * named), 9)


def role_question(query: Column, role: Column) -> Column:
    """How far the question's wording asks for a role."""
    low, out = F.lower(query), F.when(F.lit(False), F.lit(0.0))
    for roles, asks, score in ROLE_QUESTIONS:
        out = out.when(role.isin(roles) & text.any_in(low, asks), F.lit(score))
    return out.otherwise(F.lit(0.0))


def intent_score(query: Column, query_scenarios: Column, query_symbols: Column, scenarios: Column, symbols: Column, role: Column) -> Column:
    common = lambda a, b, most: F.least(F.size(F.array_intersect(a, b)), F.lit(most))
    total = 0.22 * common(query_scenarios, scenarios, 1) + 0.08 * common(query_symbols, symbols, 2) + 0.18 * role_question(query, role)
    return F.round(F.least(F.lit(0.45), total), 9)


def seed_reason(source: Column, trigger: Column, intent: Column) -> Column:
    return F.concat(source, F.when(trigger > 0, "+trigger").otherwise(""), F.when(intent > 0, "+intent").otherwise(""))


def seed_score(semantic: Column, trigger: Column, intent: Column, multiplier: Column, kind: str) -> Column:
    """Of lexical or embedding seeds: the semantic part with its shares of trigger and intent, times the state's multiplier."""
    of_trigger, of_intent = {"lexical": (0.35, 0.3), "embedding": (0.2, 0.25)}[kind]
    return F.round(F.least(F.lit(1.0), F.least(F.lit(1.0), semantic + of_trigger * trigger + of_intent * intent) * multiplier), 9)


def place_score(words: Column, place: dict[str, Column]) -> Column:
    """The shares of the parts of a place (texts; tags an array of them) that have any of the question's tokens; at most 1."""
    total = F.lit(0.0)
    for part, share in PLACE_SHARES.items():
        if part in place:
            own = F.concat_ws(" ", place[part])
            total = total + F.when(F.arrays_overlap(text.tokens(own), words), F.lit(share)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), total), 9)


def asked_route(query: Column) -> Column:
    """The kind of route a question asks for; null if none."""
    low, out = F.lower(query), F.when(F.lit(False), F.lit(""))
    for kind, asks in ROUTE_QUESTIONS:
        out = out.when(text.any_in(low, asks), F.lit(kind))
    return out


def walked_route(edge_types: Column) -> Column:
    """The kind of a route by the edges on it."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, types in EDGE_KINDS:
        out = out.when(F.arrays_overlap(edge_types, _strings(types)), F.lit(kind))
    return out.otherwise(F.lit("graph_expansion"))


def kind_bonus(kind: Column, asked: Column) -> Column:
    return F.when(kind == asked, 0.2).otherwise(0.0)


def route_priority(source: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, value in ROUTE_PRIORITY.items():
        out = out.when(source == name, F.lit(value))
    return out.otherwise(F.lit(0))
