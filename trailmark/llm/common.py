"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import json
import math
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the word rule ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` splits on the same six.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Null ids sort after every other one.
NO_ID = (1 << 63) - 1

#: The list that notes folders and tables; none: their readers may come at any time, so they stay.
_made: contextvars.ContextVar[list | None] = contextvars.ContextVar("made", default=None)

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where none is set, a folder of this machine, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return found or "file://" + tempfile.mkdtemp(prefix="corpus-")


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run to their end inside leave no shuffle files: their results are stored, so nobody reads those again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextlib.contextmanager
def noting() -> Iterator[list[tuple[str, str | None]]]:
    """The (folder, table) pairs that materialize() writes inside, for callers that drop() them when they have stored what they derived."""
    made: list[tuple[str, str | None]] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def drop(spark: SparkSession, path: str, table: str | None = None) -> None:
    if table:
        spark.sql(f"drop table if exists {table}")
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)


def _note(path: str, table: str | None = None) -> None:
    made = _made.get()
    if made is not None:
        made.append((path, table))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _note(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """Like materialize(), but as a table bucketed by key: later groupings by key don't shuffle it again."""
    spark = df.sparkSession
    name = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    with freeing_shuffles(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    _note(path, name)
    return spark.table(name)


#: Keys that hold over one row in so many are joined apart; so there are at most so many of them.
HOT = 1000


def join_spread(rows: DataFrame, names: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined by key with names, one row per key with ``n``, how many of the total rows have it; n is dropped.

    Keys of over total / HOT rows, at most HOT of them, are broadcast, so their rows stay where they are; the others
    meet by shuffle, and none of those keys holds over a thousandth of the rows.
    """
    hot = F.col("n") > max(1, total // HOT)
    value = [c for c in names.columns if c not in (key, "n")]
    few = names.where(hot).select(key, F.struct(*value).alias("_v"))
    met = rows.join(F.broadcast(few), key, "left")
    cold = met.where("_v is null").drop("_v").join(names.where(~hot).drop("n"), key)
    return met.where("_v is not null").select(*rows.columns, "_v.*").unionByName(cold.select(*rows.columns, *value))


def trim() -> None:
    """Give the worker's free memory back to the system: workers outlive their tasks, and what one stage needed is no use to the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that trims the worker when its task ends."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        trim()

    return mapped


def steady() -> None:
    """Let allocations of over 1 MB be mappings of their own, for as long as this process lives: they go back to the system when they are freed, not with the task's end."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which would grow to 32 MB by itself


def lean(function: Callable, *args):
    """function(*args) in a worker that holds little besides: for groups of applyInArrow."""
    steady()
    try:
        return function(*args)
    finally:
        trim()


def leanly(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        yield from function(batches)
        trim()

    return mapped


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def fold(doc_id: int | None, modulus: int) -> int:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def fold_column(doc_id: str | Column, modulus: int) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about most_bytes of text; a longer text stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        if not len(size):
            continue
        part = (np.cumsum(size) - size) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at most key: a search in chunks, so a row is compared with about 2 sqrt(len(cuts)) of them."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    at_most = lambda values: F.size(F.filter(values, lambda c: c <= key))
    coarse = at_most(array([c[0] for c in chunks]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + at_most(F.element_at(F.array(*[array(c) for c in chunks]), F.greatest(coarse, F.lit(1)))))


def with_next(df: DataFrame, order: list[Column], carry: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``next_<c>`` for each c of carry: its value in the following row by ascending order, the first row's in the last.

    The first order column must be a non-null long.  Rows go once through one shuffle, into ranges of that column;
    the first rows of each range go to the range before as well, so that no range needs another's rows.  Only one
    number for each range reaches the driver.  Rows with the same first column share a range.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_k", order[0])
    n = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = keyed.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], 10000).alias("q")).first()["q"] or []
    bucket = _range_of(F.col("_k"), sorted({int(c) for c in cuts}))
    keyed = keyed.withColumn("_b", bucket.cast("int"))
    first = keyed.groupBy("_b").agg(F.min("_k").alias("_first")).orderBy("_b").collect()
    if not first:
        return keyed.select(*df.columns, *[F.col(c).alias(f"next_{c}") for c in carry])
    before = {row["_first"]: (first[i - 1]["_b"] if i else first[-1]["_b"]) for i, row in enumerate(first)}
    top = first[0]["_first"]
    listed = json.dumps([{"_first": k, "_before": b} for k, b in before.items()])
    ahead = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<_first: bigint, _before: int>>")))
    keyed = keyed.join(F.broadcast(ahead), F.col("_k") == F.col("_first"), "left").drop("_first")
    copies = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("ahead"))))
    copies = copies.otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("ahead")), F.struct(F.col("_before").alias("b"), F.when(F.col("_k") == F.lit(top), 2).otherwise(1).alias("ahead"))))
    keyed = keyed.withColumn("_at", F.explode(copies)).withColumn("_b", F.col("_at.b")).withColumn("_ahead", F.col("_at.ahead")).drop("_at", "_before")
    w = Window.partitionBy("_b").orderBy((F.col("_ahead") == 2).cast("int"), F.col("_k"), *order[1:], F.col("_ahead"))
    for c in carry:
        keyed = keyed.withColumn(f"next_{c}", F.lead(c).over(w))
    return keyed.where(F.col("_ahead") == 0).drop("_b", "_k", "_ahead")

