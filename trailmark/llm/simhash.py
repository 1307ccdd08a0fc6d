"""SimHash fingerprints and near-duplicate components by multi-index hashing.

A fingerprint has a bit for each of the 64 bits of the shingles' XXH64: 1 if set in over half of them.  Two of them
within 4 bits agree within 2 bits in one of their 32-bit halves, and then some value lies within 1 bit of both halves:
each distinct fingerprint enters the table of a half under the 33 values of its ball of radius 1, equal keys meet, and
full distances are verified.  In a bucket only a spanning forest of the verified links is kept, so a group of copies
yields as many edges as it has members, not their square.  Buckets of over ``most`` fingerprints are not compared
pairwise: their members enter a table of whole 64-bit values under the 2,081 values of their ball of radius 2, where
equal keys prove a distance of 4 or less; so every link is found in buckets of any size.

Equal fingerprints are one class before any of this.  Components come from alternating star contractions over the
kept links, each round stored in the shared folder.

Null or empty texts have fingerprint zero and are linked like any other.  Texts of under four words are one shingle.
Null ids sort last; repeated rows return repeated rows with the same component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, column, join_spread, materialize, slices, trimmed, words_of

SHINGLE = 4
DISTANCE = 4
MOST = 4096


def shingles_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, in order; one shingle for texts of fewer words, none for empty ones."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    whole = memoryview(b" ".join(words).lower())
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], end[: len(words) - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts, end[k - 1 :].tolist())), np.uint64, len(starts))


def bits_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: str | None) -> int:
    return bits_of(shingles_of(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint_of(t) for t in column(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "fp": pa.array(values)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, fp long")


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between distinct fps: breadth first, each member compared once with the rest."""
    left, froms, tos = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                froms.append(np.full(len(found), fps[at]))
                tos.append(fps[found])
                queue.extend(found.tolist())
    if not froms:
        return fps[:0], fps[:0]
    return np.concatenate(froms), np.concatenate(tos)


def links(classes: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of classes.fp exactly as all pairs within distance would.

    distance is at most 5: two halves, balls of radius 1 on both sides.
    """
    if distance > 5:
        raise ValueError("halves with balls of radius 1 reach a distance of 5")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    # the half's number stands above its 32 bits
    keys = F.concat(F.transform(flips, lambda x: low.bitwiseXOR(x)), F.transform(flips, lambda x: high.bitwiseXOR(x) + F.lit(1 << 32)))
    balls = classes.select("fp", F.explode_outer(keys).alias("key")).repartition("key").sortWithinPartitions("key", "fp")

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys: edges of small ones, (fp, null) for each member of larger ones."""
        key = np.zeros(0, np.int64)
        fps = np.zeros(0, np.uint64)
        flowing = None  # the key of a run that has proved too large

        def out(a, b, hot):
            a = np.concatenate([*a, *hot]) if a or hot else np.zeros(0, np.uint64)
            tail = sum(map(len, hot))
            b = np.concatenate([*b, np.zeros(tail, np.uint64)]) if b or hot else a
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64), mask=np.arange(len(a)) >= len(a) - tail)})

        def settle(key, fps):
            edge = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
            several = ends - starts > 1
            a, b, hot = [], [], []
            for s, e in zip(starts[several].tolist(), ends[several].tolist()):
                if e - s > most:
                    hot.append(fps[s:e])
                    continue
                x, y = _forest(fps[s:e], distance)
                if len(x):
                    a.append(x)
                    b.append(y)
            return a, b, hot

        for batch in batches:
            key = np.concatenate((key, column_array(batch, "key")))
            fps = np.concatenate((fps, column_array(batch, "fp").view(np.uint64)))
            if not len(key):
                continue
            if flowing is not None:
                n = int(np.searchsorted(key, flowing, "right"))
                if n:
                    yield out([], [], [fps[:n]])
                key, fps = key[n:], fps[n:]
                if not len(key):
                    continue
                flowing = None
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                a, b, hot = settle(key[:last], fps[:last])
                if a or hot:
                    yield out(a, b, hot)
                key, fps = key[last:], fps[last:]
            if len(key) > most:
                flowing = key[0]
                yield out([], [], [fps])
                key, fps = key[:0], fps[:0]
        if len(key):
            a, b, hot = settle(key, fps)
            if a or hot:
                yield out(a, b, hot)

    found = materialize(balls.mapInArrow(trimmed(bucketed), "a long, b long"), "simhash-links")
    small = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    one = [F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)]
    ball = F.array(F.lit(0).cast("long"), *one)
    # flips of two bits: i below j
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(63)), lambda j: F.transform(F.sequence(F.lit(0), j - 1), lambda i: F.element_at(ball, i + 2).bitwiseXOR(F.element_at(ball, j + 2)))))
    points = hot.select("fp", F.explode_outer(F.concat(ball, pairs)).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = points.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    if distance != 4:
        stars = stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return small.unionByName(stars)


def column_array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): root is the smallest node of node's component; edges (a, b).  Alternating large and small stars."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, and component_id, the smallest doc_id that links reach."""
    prints = materialize(fingerprints(docs), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = components(links(classes.select("fp"), distance, most))
    joined = materialize(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = materialize(joined.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("n")), "simhash-smallest")
    sizes = joined.agg(F.count(F.lit(1)).alias("classes"), F.sum("rows").alias("rows")).first()
    named = materialize(join_spread(joined, smallest, "root", sizes["classes"]).select("fp", "component", F.col("rows").alias("n")), "simhash-named")
    return join_spread(prints, named, "fp", sizes["rows"] or 0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
