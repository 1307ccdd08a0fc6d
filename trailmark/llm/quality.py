"""A quality classifier learned from positive and unlabelled texts.

Trusted positives are rows labelled good, unlabelled texts a sample of the web at large, and the class prior the share
of good rows that the labels show (with positive labels only, Elkan and Noto's estimate from held-back positives).
A logistic model minimises the non-negative unbiased risk: prior * risk(positives, +1) + max(0, risk(unlabelled, -1)
- prior * risk(positives, -1)); while the second part is negative, steps go against it, as the method prescribes.

Features: hashed lower-cased words, by how often they occur, shares of the 256 byte values, and counts of the text's
form (lengths of words and lines, repeats, capitals, odd word ends), all from whole texts.  The model is fitted on
bounded samples (``positives``, ``unlabelled``: at most so many rows, chosen by a hash of id and text; both are
parameters).  The prior is kept within PRIORS, as near 1 the negative part of the risk has nothing to learn from.

Texts null or empty get the score of an empty text; labels with nulls aren't learned from; with no positive label or no
text every score is 0.5.  Repeated rows are scored each, extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fold_column, slices

THRESHOLD = 0.3
WORDS = 512
FORM = 19
SIZE = WORDS + 256 + FORM
PRIORS = (0.01, 0.97)


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally = Counter(words)
    top = tally.most_common(1)[0][1] if words else 0
    line_tally = Counter(lines)
    ends = np.frombuffer(bytes([x[-1] for x in words]), np.uint8) if words else np.zeros(1, np.uint8)
    starts = np.frombuffer(bytes([x[0] for x in words]), np.uint8) if words else np.zeros(1, np.uint8)
    odd = ~(((ends | 32) >= 97) & ((ends | 32) <= 122) | (ends >= 128))
    form = [
        np.log1p(len(words)) / 10, np.log1p(len(raw)) / 12, lengths.mean() / 10, lengths.std() / 10, min(200, lengths.max()) / 50,
        len(tally) / w, top / w, len(lines) / w, len(line_tally) / len(lines), max(line_tally.values()) / len(lines),
        odd.mean(), ((starts >= 65) & (starts <= 90)).mean(), ((starts >= 48) & (starts <= 57)).mean(), share[65:91].sum(), share[48:58].sum(),
        share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum(), share[128:].sum(), (share[:32].sum() - share[10]), float(not words),
    ]
    low = Counter(raw.lower().split())
    said = np.bincount(np.fromiter(map(zlib.crc32, low), np.int64, len(low)) % WORDS, weights=np.fromiter(low.values(), np.float64, len(low)), minlength=WORDS)
    return np.concatenate((np.sqrt(said / w), np.sqrt(share), form)).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((rows - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def minimise(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 500, rate: float = 0.05, decay: float | None = None) -> Model:
    """Adam on the non-negative risk of a logistic model; p positives, u unlabelled.  Weights decay the more the fewer positives there are."""
    decay = max(1e-3, 1 / len(p)) if decay is None else decay
    both = np.concatenate((p, u))
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    clip = lambda x: np.clip((x - mean) / scale, -8, 8)
    p, u = clip(p), clip(u)
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        # log losses: -log s for +1, -log(1 - s) for -1; their slopes are s - 1 and s
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        slope = lambda d, x: np.append(d @ x, d.sum()) / len(x)
        rest = slope(su, u) - prior * slope(sp, p)
        g = prior * slope(sp - 1, p) + rest if negative >= 0 else -rest
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (0.1 ** (t / steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return Model(mean, scale, w, float(b), prior)


def _vectors(rows: DataFrame) -> np.ndarray:
    """Features of rows (_key, text), of which there is a bounded number, in the order of _key; half precision on the way."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"_key": batch.column(0), "x": pa.array([features(t).astype(np.float16).tobytes() for t in column(batch, "text")], pa.binary())})

    got = sorted((r["_key"], bytes(r["x"])) for r in rows.select("_key", "text").mapInArrow(made, "_key long, x binary").collect())
    return np.stack([np.frombuffer(x, np.float16) for _, x in got]).astype(np.float32) if got else np.zeros((0, SIZE), np.float32)


def sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows (doc_id, text), by a hash of both, as (_key, text): those of the smallest hashes."""
    n = rows.count()
    keyed = rows.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)).alias("_key"), "text")
    # the share bounds what is ordered; the limit what is kept
    share = min(1.0, 1.2 * most / max(1, n) + 100 / max(1, n))
    return keyed.where(F.col("_key") < int(share * (1 << 40))).orderBy("_key").limit(most)


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> Model | None:
    """Learn from labels (doc_id, quality) and from docs at large; None if there is no positive."""
    docs = docs.select("doc_id", "text")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).where("quality in (0, 1)").collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if not good:
        return None
    # ids first, so that only a bounded number meets the texts
    ids = known.where("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(positives)
    p = _vectors(docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select(F.pmod(F.xxhash64("doc_id", "text", F.lit(12)), F.lit(1 << 40)).alias("_key"), "text").orderBy("_key").limit(positives))
    u = _vectors(sampled(docs, unlabelled, 13))
    if not len(p) or not len(u):
        return None
    prior = good / (good + bad) if bad else elkan_noto(p, u)
    return minimise(p, u, float(np.clip(prior, *PRIORS)))


def elkan_noto(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among texts at large: how much lower a classifier of labelled against not rates those than held-back positives."""
    half = max(1, len(p) // 2)
    naive = minimise(p[:half], u, 0.5)
    held = p[half:] if len(p) > half else p
    return float(naive.score(u).mean() / max(1e-6, naive.score(held).mean()))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.stack([features(t) for t in column(batch, "text")])
            values = model.score(np.clip(rows, model.mean - 8 * model.scale, model.mean + 8 * model.scale)) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(values, pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.select("doc_id", "text"), labels.where(fold_column("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (fold_column("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
