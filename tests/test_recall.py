"""The recall engine's functions and operators on small inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions import scores, text
from trailmark.operators import evaluate, recall, state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stems_and_tokens(spark):
    assert one(spark, text.tokens(F.lit("Pages failing, fixed boxes is bus; ring"))) == ["pag", "fail", "fix", "box", "is", "bus", "ring"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_overlap_is_of_the_query(spark):
    assert one(spark, text.lexical_overlap(F.lit("a b c d"), F.lit("a b x"))) == 0.5
    assert one(spark, text.lexical_overlap(F.lit(""), F.lit("a"))) == 0.0


def test_bucket_is_md5(spark):
    assert one(spark, text.bucket(F.lit("queue"))) == int.from_bytes(hashlib.md5(b"queue").digest()[:2], "big") % 256


def test_roles_match_substrings(spark):
    assert one(spark, text.semantic_role(F.lit("Pay unless goods are late"), F.lit("clause"))) == "exception"
    assert one(spark, text.semantic_role(F.lit("a specific thing"), F.lit("clause"))) == "condition"
    assert one(spark, text.semantic_role(F.lit("do it"), F.lit("step"))) == "action"


def test_bonuses_need_a_semantic_score(spark):
    f = lambda s: one(spark, scores.weighted_total(F.lit(s), F.lit(0.5), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert f(0.0) == pytest.approx(0.075)
    assert f(1.0) == pytest.approx(0.45 + 0.075 + 0.15 + 0.1 + 0.15 + 0.12)


def test_lifecycle(spark):
    log = spark.createDataFrame([(1, i, True) for i in range(4)] + [(2, i, False) for i in range(16)] + [(3, 0, True)], "n long, o long, t boolean")
    got = {r["n"]: (r["state"], r["count"]) for r in state.fold(log, "n", "o", "t").collect()}
    assert got == {1: ("consolidated", 4), 2: ("archived", 0), 3: ("active", 1)}


def test_ndcg(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, node_id long, rank int")
    gold = spark.createDataFrame([(1, 8)], "query_id long, node_id long")
    row = evaluate.ranking_metrics(ranked, gold, 10).first()
    assert row["ndcg"] == pytest.approx(0.63093, abs=1e-5) and row["hit"]


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK", 3)
    monkeypatch.setattr(evaluate, "ROWS", 7)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(40)]
    d = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {}
    for r in evaluate.nearest(d.where("vec_id % 4 = 0"), d, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["node_id"])
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)
    assert got == {i: sorted((j for j, _ in rows if j != i), key=lambda j: (-cos(v, rows[j][1]), j))[:3] for i, v in rows if i % 4 == 0}
    assert evaluate.nearest(d.limit(0), d, 3).count() == 0


def test_short_queries_meet_every_text(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK", 2)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b c", "c", "zz", "one two three four five six seven"])], "query_id long, text string")
    n = spark.createDataFrame([(1, "xa b cx"), (2, None), (3, "say one two three four five six seven")], "node_id long, text string")
    got = {(r["query_id"], r["node_id"]) for r in evaluate.verbatim_gold(q, n).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (0, 3), (4, 3)}
