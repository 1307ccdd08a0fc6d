"""Scoring expressions of the recall engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def bounded_weight(importance: Column, risk: Column, novelty: Column, confidence: Column) -> Column:
    return clamp(0.35 * importance + 0.35 * risk + 0.15 * novelty + 0.15 * confidence)


def effective_weight(bounded: Column, usage: Column, decay: Column) -> Column:
    return clamp((bounded + F.least(0.02 * usage, F.lit(0.15))) * decay)


#: How readily a node in each state is recalled.
STATE_FACTORS = {"encoded": 0.95, "active": 1.2, "stabilizing": 1.08, "consolidated": 1.12, "fading": 0.65, "archived": 0.3}


def recall_multiplier(state: Column, stability: Column) -> Column:
    base = F.when(F.lit(False), F.lit(0.0))
    for name, factor in STATE_FACTORS.items():
        base = base.when(state == name, F.lit(factor))
    bonus = F.when(state.isin("active", "stabilizing", "consolidated"), F.least(F.lit(0.1), 0.12 * stability)).otherwise(0.0)
    return F.greatest(F.lit(0.2), F.least(F.lit(1.35), base.otherwise(F.lit(0.95)) + bonus))


def structural(depth: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - 0.25 * depth)


def exception_score(role: Column) -> Column:
    return F.when(role == "exception", 1.0).when(role.isin("remedy", "escalation"), 0.45).otherwise(0.0)


def activation_bonus(role: Column) -> Column:
    return F.when(role == "exception", 0.15).when(role.isin("remedy", "escalation"), 0.08).otherwise(0.0)


def anomalous(risk: Column, novelty: Column) -> Column:
    return F.when((risk >= 0.8) | (novelty >= 0.8), 1.0).otherwise(0.0)


def weighted_total(semantic: Column, structure: Column, anomaly: Column, importance: Column, exception: Column, contradiction: Column, alignment: Column, multiplier: Column) -> Column:
    """Semantic and structural parts plus bonuses that the semantic part gates, times the state's multiplier."""
    bonus = 0.15 * anomaly + 0.1 * importance + 0.075 * exception + 0.075 * contradiction + 0.12 * alignment
    return (0.45 * semantic + 0.15 * structure + semantic * bonus) * multiplier


def structure_total(semantic: Column, structure: Column) -> Column:
    return 0.45 * semantic + 0.15 * structure


def salience(importance: Column, risk: Column, novelty: Column, confidence: Column, emotional: Column, recency: Column) -> Column:
    return clamp(0.28 * importance + 0.22 * risk + 0.16 * novelty + 0.16 * confidence + 0.08 * emotional + 0.1 * recency)
