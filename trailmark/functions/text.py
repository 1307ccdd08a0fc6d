"""Text functions of the recall engine as Columns: tokens, overlap, hashed buckets, roles, tags, weights."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 256

# fixed values: keyword lists of the rules
ROLE_CUES = [
    ("exception", ["unless", "except", "notwithstanding"]),
    ("remedy", ["terminate", "damages", "withhold", "recover"]),
    ("escalation", ["escalate", "page"]),
    ("action", ["restart", "roll back", "verify", "notify"]),
    ("condition", ["if", "when", "after", "once", "subject to"]),
    ("obligation", ["shall", "must"]),
]
SCENARIO_WORDS = {
    "payment dispute": ["payment", "invoice", "refund", "defective", "goods", "chargeback", "liable"],
    "rollback failure": ["rollback", "recover", "recovery", "deployment", "restart", "queue"],
    "exception override": ["unless", "except", "override", "exception", "notwithstanding"],
    "incident escalation": ["escalate", "page", "incident", "sev", "notify"],
    "causal recovery": ["because", "cause", "causal", "depends", "dependency", "after"],
}
SYMBOLIC_CUES = {
    "conflict": ["contradict", "conflict", "dispute"],
    "urgency": ["urgent", "immediately", "asap", "sev", "critical"],
    "exception": ["unless", "except", "override", "exception", "notwithstanding"],
    "escalation": ["escalate", "page", "notify leadership"],
    "causal": ["because", "depends", "dependency", "cause", "after", "once", "if", "when"],
}
CONTRACT_WEIGHTS = {"risk": (["terminate", "damages", "indemnify", "breach", "penalty"], 0.9, 0.3), "importance": (["shall", "must", "liable", "exclusive"], 0.8, 0.4), "novelty": (["except", "unless", "notwithstanding"], 0.85, 0.25)}
RUNBOOK_WEIGHTS = {"risk": (["severity", "incident", "outage", "rollback", "page", "degrade"], 0.9, 0.35), "importance": (["must", "immediately", "within", "verify", "required"], 0.85, 0.45), "novelty": (["unless", "except", "manual approval"], 0.8, 0.2)}

# fixed values: words that are no terms, compared after stemming
STOP = ["the", "a", "an", "and", "or", "if", "when", "after", "once", "then", "must", "should", "does", "not", "within", "for", "with", "into", "from", "that", "this", "what", "which", "where"]

#: A token and the suffix that it loses: ing of over 5 letters, ed or es of over 4, s of over 3; the longer of es and s.
SUFFIX = "(?<![a-z0-9])([a-z0-9]{3,}?)(?:ing|ed|es|s)(?![a-z0-9])"


def stemmed(text: Column) -> Column:
    """Lower-cased text whose runs of a-z and 0-9 have lost their suffix; one regular expression, so it stays in generated code."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SUFFIX, "$1")


def tokens(text: Column) -> Column:
    """Stemmed runs of a-z and 0-9 in order, repeats kept; none for null."""
    return F.regexp_extract_all(stemmed(text), F.lit("[a-z0-9]+"), F.lit(0))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that text has; 0 if either has none."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)))


def bucket(token: Column, dimension: int = DIMENSION) -> Column:
    """The token's dimension in a hashed embedding: the first two bytes of its MD5."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 4), 16, 10).cast("int") % dimension).cast("int")


def any_in(text: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(text, F.lit(cue))
    return out


def semantic_role(text: Column, node_type: Column) -> Column:
    """The first role whose cue is a substring of the lower-cased text; without one, action for steps and else obligation."""
    low, out = F.lower(text), F.when(F.lit(False), F.lit(""))
    for role, cues in ROLE_CUES:
        fits = any_in(low, cues)
        out = out.when(fits & node_type.isin("clause", "step") if role == "obligation" else fits, F.lit(role))
    return out.otherwise(F.when(node_type == "step", F.lit("action")).otherwise(F.lit("obligation")))


def plain_stem(token: str) -> str:
    """A token's stem in plain Python, for constants."""
    return re.sub(SUFFIX, r"\1", token)


def scenario_tags(text: Column) -> Column:
    own = tokens(text)
    tags = [F.when(F.arrays_overlap(own, F.array(*[F.lit(plain_stem(w)) for w in words])), F.lit(tag)) for tag, words in SCENARIO_WORDS.items()]
    return F.array_sort(F.array_compact(F.array(*tags)))


def symbolic_tags(text: Column, role: Column) -> Column:
    low = F.lower(text)
    tags = [F.when(any_in(low, cues), F.lit(tag)) for tag, cues in SYMBOLIC_CUES.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags, F.when(role.isin("exception", "escalation"), role)))))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def weights(text: Column, rules: dict) -> dict[str, Column]:
    low = F.lower(text)
    return {name: F.when(any_in(low, cues), F.lit(high)).otherwise(F.lit(rest)) for name, (cues, high, rest) in rules.items()} | {"confidence": F.lit(0.95)}
