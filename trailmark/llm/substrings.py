"""Removal of word sequences that occur in several documents, by super-k-mer partitioning.

A window is 13 consecutive words of a document.  Its minimiser is the smallest hash of its runs of four words;
consecutive windows with the same minimiser travel as one packed string to the minimiser's bucket, where windows are
sorted and those that also start in a document with a smaller doc_id are found.  Sorting is by hash, and neighbours
with equal hashes are compared word for word; if ever two different windows share a hash, the bucket's windows are
ranked by doubling instead, so the outcome is exact.

Before anything travels, each batch of documents drops repeats: a packed string goes out once with the occurrences in
its smallest document, and other documents of the batch lose its words at once.  So a passage that a third of all
documents share reaches its bucket once a batch.  Minimisers of four words aren't frequent as single words are.

Null texts have no words.  Null ids count as larger than any other.  Rows that repeat an id are one document for the
comparison (a document never loses words to itself) and each is returned.  Texts of under 13 words keep all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, column, materialize, slices, trimmed, words_of

WINDOW = 13
MINIMISER = 4
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min of x[i : i + width]."""
    span, least = 1, x
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + n)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def super_kmers(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of each super-k-mer: its document, first word, number of windows and minimiser; and all words in a row."""
    flat = [w for d in docs for w in d]
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    begin = np.cumsum(n) - n
    windows = np.maximum(n - WINDOW + 1, 0)
    at = _runs(begin, windows)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), flat
    h = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
    m = h[: len(h) - MINIMISER + 1].copy()
    for j in range(1, MINIMISER):
        m = _mix(m) + h[j : len(h) - MINIMISER + 1 + j]
    least = _sliding_min(_mix(m), WINDOW - MINIMISER + 1)[at]
    doc = np.repeat(np.arange(len(docs)), windows)
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    return doc[first], at[first], np.diff(np.append(first, len(at))), least[first], flat


def _bounds(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge covered word ranges that meet: (doc, from, to), ends excluded."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = start + windows[order] + WINDOW - 1
    if not len(doc):
        return doc, start, end
    # running maximum of the ends within a document
    top = np.maximum.accumulate(end + doc * (1 << 40)) - doc * (1 << 40)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > top[:-1])))
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def window_groups(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the windows ids[a : a + WINDOW] for a in at: equal exactly where the windows are equal."""
    r = _mix(ids.astype(np.uint64) + np.uint64(1))
    h = np.zeros(len(ids) - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0xD6E8FEB86659FD93) + r[j : j + len(h)]
    h = _mix(h)[at]
    order = np.argsort(h, kind="stable")
    sorted_h, sorted_at = h[order], at[order]
    same = sorted_h[1:] == sorted_h[:-1]
    pairs = np.flatnonzero(same)
    alike = np.ones(len(pairs), bool)
    for j in range(WINDOW):
        alike &= ids[sorted_at[pairs] + j] == ids[sorted_at[pairs + 1] + j]
    if not alike.all():
        return ranked_groups(ids, at)
    group = np.empty(len(at), np.int64)
    group[order] = np.concatenate(([0], np.cumsum(~same)))
    return group


def ranked_groups(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same without hashes: ranks of 1, 2, 4 and 8 words, then of two overlapping eights."""
    rank, span = ids.astype(np.int64), 1
    while 2 * span < WINDOW:
        rank = np.unique(rank[:-span] * (int(rank.max()) + 1) + rank[span:], return_inverse=True)[1]
        span *= 2
    return np.unique(rank[at] * (int(rank.max()) + 1) + rank[at + WINDOW - span], return_inverse=True)[1]


def _squeeze(*arrays: np.ndarray) -> list[bytes]:
    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(a.tobytes()) for a in arrays]


def _open(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


SENT = "bucket long, body binary, docs binary, keys binary, owner binary, place binary, kmer binary"


def send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed super-k-mers for the buckets; under bucket -1 the ranges that a document loses to its own batch."""
    for batch in slices(batches, "text", BATCH_BYTES):
        ids, keys = (np.array(column(batch, c), np.int64) for c in ("id", "key"))
        words = [words_of(t) for t in column(batch, "text")]
        doc, at, windows, least, flat = super_kmers(words)
        if not len(doc):
            continue
        begin = np.cumsum([0, *map(len, words)])[:-1]
        seen: dict[bytes, int] = {}
        number = np.fromiter((seen.setdefault(b" ".join(flat[a : a + n]), len(seen)) for a, n in zip(at.tolist(), (windows + WINDOW - 1).tolist())), np.int64, len(at))
        del flat, words
        smallest = np.full(len(seen), NO_ID)
        np.minimum.at(smallest, number, ids[doc])
        lost = ids[doc] > smallest[number]
        place = at - begin[doc]
        rows: dict[str, list] = {k: [] for k in ("bucket", "body", "docs", "keys", "owner", "place", "kmer")}

        def put(bucket, body, owners, *rest):
            used, own = np.unique(owners, return_inverse=True)
            for k, v in zip(rows, (bucket, body, *_squeeze(ids[used], keys[used], own.astype(np.uint32), *rest))):
                rows[k].append(v)

        if lost.any():
            d, a, b = _bounds(doc[lost], place[lost], windows[lost])
            put(-1, b"", d, a.astype(np.uint32), b.astype(np.uint32))
        texts = list(seen)
        del seen
        kept = np.flatnonzero(~lost)
        bucket = (_mix(least[kept]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        kept, bucket = kept[order], bucket[order]
        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(kept)]
        z = zstandard.ZstdCompressor(level=3)
        size = 0
        for x, y in zip(cut, cut[1:]):
            own = kept[x:y]
            distinct, kmer = np.unique(number[own], return_inverse=True)
            body = z.compress(b"\n".join([texts[i] for i in distinct.tolist()]))
            put(int(bucket[x]), body, doc[own], place[own].astype(np.uint32), kmer.astype(np.uint32))
            size += len(body)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pydict(rows, schema=_sent)
                rows, size = {k: [] for k in rows}, 0
        if rows["bucket"]:
            yield pa.RecordBatch.from_pydict(rows, schema=_sent)


_sent = pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in ("body", "docs", "keys", "owner", "place", "kmer"))])
_ranges = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("ranges", pa.binary())])


def _range_rows(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """One row per document of merged ranges, which are ordered by document."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    both = np.stack((a, b), axis=1).astype(np.uint32)
    cut = np.append(first, len(doc)).tolist()
    return pa.RecordBatch.from_arrays([pa.array(ids[doc[first]]), pa.array(keys[doc[first]]), pa.array([both[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], schema=_ranges)


def settle(table: pa.Table) -> pa.Table:
    """The ranges that documents lose in one bucket (or, for bucket -1, have lost to their own batch)."""
    rows = table.to_pylist()
    if rows[0]["bucket"] == -1:
        out = [_range_rows(_open(r["docs"], np.int64), _open(r["keys"], np.int64), _open(r["owner"], np.uint32).astype(np.int64), _open(r["place"], np.uint32), _open(r["kmer"], np.uint32)) for r in rows]
        return pa.Table.from_batches(out, _ranges)
    seen: dict[bytes, int] = {}
    ids, keys, owner, place, kmer, docs = [], [], [], [], [], 0
    for r in rows:
        own = np.fromiter((seen.setdefault(t, len(seen)) for t in zstandard.ZstdDecompressor().decompress(r["body"]).split(b"\n")), np.int64)
        kmer.append(own[_open(r["kmer"], np.uint32)])
        ids.append(_open(r["docs"], np.int64))
        keys.append(_open(r["keys"], np.int64))
        owner.append(_open(r["owner"], np.uint32).astype(np.int64) + docs)
        place.append(_open(r["place"], np.uint32).astype(np.int64))
        docs += len(ids[-1])
        r.clear()
    ids, keys, owner, place, kmer = map(np.concatenate, (ids, keys, owner, place, kmer))
    length = np.fromiter((t.count(b" ") + 1 for t in seen), np.int64, len(seen))
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(w, len(known)) for t in seen for w in t.split()), np.int64, int(length.sum()))
    del seen, known
    windows = length - WINDOW + 1
    offset = np.cumsum(windows) - windows
    group = window_groups(words, _runs(np.cumsum(length) - length, windows))
    smallest = np.full(len(windows), NO_ID)
    np.minimum.at(smallest, kmer, ids[owner])
    first = np.full(int(group.max()) + 1, NO_ID)
    np.minimum.at(first, group, np.repeat(smallest, windows))
    first = first[group]
    # only super-k-mers with a window that some smaller document has
    low = np.minimum.reduceat(first, offset)
    some = np.flatnonzero(ids[owner] > low[kmer])
    n = windows[kmer[some]]
    which = _runs(offset[kmer[some]], n)
    by = np.repeat(some, n)
    hit = first[which] < ids[owner[by]]
    which, by = which[hit], by[hit]
    d, a, b = _bounds(owner[by], place[by] + which - offset[kmer[by]], np.ones(len(by), np.int64))
    return pa.Table.from_batches([_range_rows(ids, keys, d, a, b)], _ranges)


def lost_ranges(docs: DataFrame) -> DataFrame:
    """(id, key, ranges): word ranges that documents lose; key is a hash of the text, so rows that share an id stay apart."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("key"), "text").where("text is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-3 * total // BUCKET_BYTES))
    sent = keyed.mapInArrow(trimmed(lambda batches: send(batches, buckets)), SENT)
    # ranges under -1 need no bucket: they are dealt by their documents
    local = F.when(F.col("bucket") == -1, F.xxhash64("docs")).otherwise(F.lit(0))
    return sent.groupBy("bucket", local.alias("part")).applyInArrow(lambda table: settle(table.drop_columns("part") if "part" in table.column_names else table), "id long, key long, ranges binary")


def remove_repeats(docs: DataFrame, keep: list[str], texts: bool = True) -> DataFrame:
    """keep's columns of docs, n_words, n_removed, and kept_text (the kept words joined by a space) or its kept_sha256."""
    ranges = materialize(lost_ranges(docs), "ranges").groupBy("id", "key").agg(F.collect_list("ranges").alias("_ranges"))
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("key"))
    joined = rows.join(ranges.hint("shuffle_hash"), ["id", "key"], "left").select(*[f"_{i}" for i in range(len(keep))], "text", "_ranges")
    own = joined.schema.fields[: len(keep)]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, removed, out = [], [], []
            for text, found in zip(column(batch, "text"), column(batch, "_ranges")):
                words = words_of(text)
                n.append(len(words))
                if found:
                    stay = np.ones(len(words), bool)
                    for a, b in np.frombuffer(b"".join(found), np.uint32).reshape(-1, 2).tolist():
                        stay[a:b] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                removed.append(n[-1] - len(words))
                whole = b" ".join(words)
                out.append(whole.decode("utf-8", "replace") if texts else hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(own))], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=[*[f.name for f in own], "n_words", "n_removed", "out"])

    schema = joined.select(*[f.name for f in own]).schema.add("n_words", "long").add("n_removed", "long").add("out", "string")
    done = joined.mapInArrow(trimmed(kept), schema)
    return done.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", F.col("out").alias("kept_text" if texts else "kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], texts=False)


OP4_SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
p as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as k from w, unnest(generate_series(1, len(ws) - 12)) as g(i)),
m as (select k, min(doc_id) as low from p group by k having min(doc_id) < max(doc_id)),
c as (select distinct doc_id, i + j as i from p join m using (k), unnest(generate_series(0, 12)) as o(j) where low < doc_id),
x as (select doc_id, i, ws[i] as word from w, unnest(generate_series(1, len(ws))) as g(i)),
s as (select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n from x anti join c using (doc_id, i) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join s using (doc_id)
"""
