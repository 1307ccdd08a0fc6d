"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte n-grams (one to three bytes of lower-cased letters, everything ASCII that is
no letter counting as a space), scaled to length one.  Each language has several centroids, found by spherical k-means,
and a text takes the language of the centroid with the largest cosine.  A text is rejected if its cosine with the
language's broad centroids (those that hold at least a hundredth of its texts) is below the language's limit.  Cosines
grow with the length of a text, so limits do too: for whole texts and for pieces of 8 to 512 bytes of them, the limit
lies halfway between the cosine that all but 5 in 1,000 of the language's own reach and the one that 95 in 100 of the
other languages' stay under.  With one language only, it is the former.

Document frequencies are counted over all labelled rows; the centroids and limits are fitted on a bounded sample of them
(``per_language``, ``total``: at most so many rows, chosen by a hash of id and text).  Every text is read whole.

Null texts and texts without a letter are ``und`` with score 0 and rejected.  Null or empty labels aren't learned
from.  With no labelled row at all everything is ``und``.  Repeated rows, null ids and extra columns are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, fold_column, slices, trimmed

DIMENSIONS = 8192
CENTROIDS = 4
#: Bytes of the pieces from which limits of short texts are learned; a text of n bytes has about 3 n n-grams.
PIECES = (8, 16, 32, 64, 128, 256, 512)
BROAD = 0.01

_letters = np.full(256, 32, np.uint8)
_letters[128:] = np.arange(128, 256)
_letters[97:123] = np.arange(97, 123)
_letters[65:91] = np.arange(97, 123)


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    x = _letters[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    gap = x == 32
    x = np.concatenate(([32], x[~(gap & np.concatenate(([True], gap[:-1])))], [32])).astype(np.uint32)
    total = np.bincount(x, minlength=DIMENSIONS).astype(np.float32)
    total[32] = 0
    for step in range(0, max(1, len(x) - 2), 1 << 20):
        y = x[step : step + (1 << 20) + 2]
        two = y[:-1] * np.uint32(257) + y[1:]
        three = two[:-1] * np.uint32(257) + y[2:]
        for grams in (two if step + (1 << 20) + 2 >= len(x) else two[:-1], three):
            mixed = grams * np.uint32(0x9E3779B1)
            total += np.bincount(mixed >> np.uint32(19), minlength=DIMENSIONS)
    return total


def piece(text: str, size: int) -> str | None:
    """size bytes of text from the start of a word in its second third, or None if it holds no more than that."""
    raw = text.encode("utf-8", "replace")
    at = raw.find(b" ", len(raw) // 3, len(raw) // 3 * 2) + 1 or len(raw) // 3
    return raw[at : at + size].decode("utf-8", "ignore") if len(raw) - at >= size else None


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    broad: np.ndarray  # whether a centroid counts for rejection
    limits: dict[str, tuple[list[float], list[float]]]  # of each language: logarithms of the number of n-grams, and the least cosine at each

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = np.log1p(rows) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def nearness(self, near: np.ndarray, lang: str) -> np.ndarray:
        """Of cosines with all centroids, the largest with a broad one of lang."""
        return near[:, self.broad & (np.array(self.languages) == lang)].max(axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        fit = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        names, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(fit), 256):
            own = fit[at : at + 256]
            rows = np.stack([counts(texts[i]) for i in own])
            near = self.vectors(rows) @ self.centroids.T
            size, inside = np.log2(np.maximum(rows.sum(axis=1), 1)), {lang: self.nearness(near, lang) for lang in self.limits}
            for at_, (i, b, s) in enumerate(zip(own, near.argmax(axis=1).tolist(), near.max(axis=1).tolist())):
                lang = self.languages[b]
                names[i], score[i], rejected[i] = lang, min(1.0, max(0.0, s)), inside[lang][at_] < np.interp(size[at_], *self.limits[lang])
        return names, score, rejected


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centroids are the mean and then the vectors furthest from those chosen."""
    mean = v.mean(axis=0)
    chosen = [mean / max(np.linalg.norm(mean), 1e-9)]
    near = v @ chosen[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(v[near.argmin()])
        near = np.maximum(near, v @ chosen[-1])
    c = np.stack(chosen)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many of the texts have a letter, and how many of those hold each n-gram; a task sends a row for each n-gram, added up by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in slices(batches):
            for t in column(batch, "text"):
                if has_letter(t):
                    n += 1
                    df += counts(t) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1)), "n": pa.array(np.append(df[at], n))})

    got = texts.select("text").mapInArrow(trimmed(counted), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS, np.int64)
    for r in got:
        if r["at"] >= 0:
            df[r["at"]] = r["n"]
    return sum(r["n"] for r in got if r["at"] < 0), df


def fit(labelled: DataFrame, per_language: int = 400, total: int = 4000) -> Model:
    """Learn from labelled (doc_id, text, lang): at most per_language rows of a language and total rows in all."""
    usable = labelled.where("text is not null and lang is not null and lang <> ''").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(total).collect()}
    nothing = Model([], np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, bool), {})
    if not sizes:
        return nothing
    bound = max(1, min(per_language, total // len(sizes)))
    spread = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, 1.5 * bound / n + 20 / n) * (1 << 30)))])
    sample = usable.where(spread < F.coalesce(share[F.col("lang")], F.lit(0)))
    # the filter has bounded what is ranked
    sample = sample.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(spread, "doc_id"))).where(F.col("_r") <= bound)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = []
            for lang, t in zip(column(batch, "lang"), column(batch, "text")):
                made += [(lang, k, counts(x)) for k in (0, *PIECES) if has_letter(t) and has_letter(x := piece(t, k) if k else t)]
            where = [np.flatnonzero(r) for _, _, r in made]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([m[0] for m in made], pa.string()), "size": pa.array([m[1] for m in made], pa.int32()), "at": pa.array([w.astype(np.uint16).tobytes() for w in where], pa.binary()), "n": pa.array([m[2][w].tobytes() for m, w in zip(made, where)], pa.binary())})

    got = sample.select("text", "lang").mapInArrow(sparse, "lang string, size int, at binary, n binary").collect()
    every = sorted((r["size"], r["lang"], bytes(r["at"]), bytes(r["n"])) for r in got if r["at"])
    got = [g[1:] for g in every if not g[0]]
    if not got:
        return nothing

    def dense(rows: list[tuple]) -> np.ndarray:
        out = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, (*_, at, n) in enumerate(rows):
            out[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
        return out

    whole = dense(got)
    texts, df = document_frequencies(usable)
    model = Model([], (np.log((1 + texts) / (1 + df)) + 1).astype(np.float32), nothing.centroids, nothing.broad, {})
    vectors = model.vectors(whole)
    del whole
    centroids, broad = [], []
    for lang in sorted({g[0] for g in got}):
        own = vectors[[g[0] == lang for g in got]]
        c = cluster(own, CENTROIDS)
        held = np.bincount((own @ c.T).argmax(axis=1), minlength=len(c))
        centroids.append(c)
        model.languages += [lang] * len(c)
        # one stray text is no language, though it may be a centroid
        broad.append((held >= max(2, BROAD * len(own))) | (held == held.max()))
    del vectors
    model.centroids, model.broad = np.concatenate(centroids).astype(np.float32), np.concatenate(broad)
    near, size = np.zeros((len(every), len(model.languages)), np.float32), np.zeros(len(every))
    for at in range(0, len(every), 256):
        rows = dense(every[at : at + 256])
        near[at : at + 256], size[at : at + 256] = model.vectors(rows) @ model.centroids.T, rows.sum(axis=1)
    size, kind, langs = np.log2(np.maximum(size, 1)), np.array([e[0] for e in every]), np.array([e[1] for e in every], object)
    for lang in sorted(set(model.languages)):
        inside, own, points = model.nearness(near, lang), langs == lang, []
        long = (kind == 0) & (size > np.log2(3 * PIECES[-1]))
        groups = [*[(kind == k, np.log2(3 * k)) for k in PIECES], (long, None)]
        if not any((g & own).any() for g, _ in groups):  # nothing but very short texts
            groups = [(kind == 0, None)]
        for group, where in groups:
            if (group & own).any():
                least = float(np.quantile(inside[group & own], 0.005))
                if (others := group & ~own).any():
                    least = min(least, (least + float(np.quantile(inside[others], 0.95))) / 2)
                points.append((float(np.median(size[group & own])) if where is None else float(where), least))
        model.limits[lang] = tuple(map(list, zip(*points)))
    return model


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep's columns of docs and lang_pred, score, rejected."""
    kinds = docs.select(*keep).schema.fields

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            names, score, rejected = model.predict(column(batch, "_text"))
            own = {f.name: batch.column(i) for i, f in enumerate(kinds)}
            yield pa.RecordBatch.from_pydict(own | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected)})

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(trimmed(predicted), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold_column("doc_id", 3) != 1))
    return identify(docs, model, ["doc_id"]).select("doc_id", (fold_column("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
