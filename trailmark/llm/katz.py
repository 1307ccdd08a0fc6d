"""Scoring texts by a Katz backoff model of three words.

P(w | a b) is d * c(a b w) / c(a b) for triples seen in training, d being the Good-Turing discount of the triple's
count, and alpha(a b) * P(w | b) for others; P(w | b) is the same of pairs and backs off to P(w), which is discounted in
the same way, and what it leaves is the probability of an unknown word.  alpha(h) = (1 - the mass of h's n-grams) /
(1 - the lower-order mass of their words), so P(. | h) sums to exactly one.  A history whose counts leave no mass is
divided by one count more.  A history never seen has alpha 1.  A text begins after two begin marks and has an end token.

Triples (a, b, w) are kept in tables by a hash of b, so the triples of a history (a, b), the pairs of b and everything
that P(w | a b) backs off to but P(w) lie in one table.  A frequent b is spread over several tables by a hash of w, in
proportion to its share; there alone sums over histories have to be added up between tables.  Which words are frequent
is told by a sixteenth of the texts; it decides where triples lie and nothing else.

Batches of documents reduce their tokens to distinct triples, numbered by a dictionary of the batch's words for each
table, with counts over training documents and, for each triple, the documents that hold it, so a frequent triple
arrives once a batch.  Tables merge what arrives, from all batches, and ask further rounds for c(w), and for the sums of
spread b and of spread (a, b).  Then they sum the log probabilities of their triples by document.  Words are known by
64-bit hashes.

Null texts are empty: one end token.  Null ids count as the empty text in the fold.  Repeated rows are rows: each is
learned from and scored.  Without training rows every token is unknown, with probability one.  Empty tables give no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fold, lean, leanly, materialize, materialize_bucketed, slices

DISCOUNTED = 5
BATCH_TOKENS = 2_300_000
TABLE_BYTES = 12 << 20
#: A word that fills a table of average size is spread over so many tables for each of those that it would fill.
PARTS = 2
SAMPLED = 16
#: About so many of a batch's tokens, or of a table's triples, are worked on at a time, so that workers hold little besides what they keep.
PIECE = 1 << 18
BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def squeeze(a: np.ndarray, kind=None) -> bytes:
    """The bytes of equal weight side by side, compressed; so numbers take about as many bits as they have."""
    a = np.ascontiguousarray(a if kind is None else a.astype(kind))
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes))


def squeeze_sorted(a: np.ndarray) -> bytes:
    """Ascending hashes as differences."""
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def opened(data: bytes | pa.Buffer, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def opened_sorted(data: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(opened(data, np.uint64), dtype=np.uint64)


def row_of(batch: pa.Table | pa.RecordBatch, i: int) -> dict:
    """A row whose binary values are left where they are."""
    values = {k: batch.column(k)[i] for k in batch.schema.names}
    return {k: v.as_buffer() if isinstance(v, pa.BinaryScalar) else v.as_py() for k, v in values.items()}


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the number of each value among them."""
    order = np.argsort(values)
    ascending = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    distinct = ascending[new]
    del ascending
    rank = np.cumsum(new, dtype=np.uint32)
    rank -= np.uint32(1)
    number = np.empty(len(values), np.uint32)
    number[order] = rank
    return distinct, number


def pieces(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Ranges of runs that begin at starts, the last of which ends at n, of about PIECE rows; a run stays whole."""
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, n, PIECE)), len(starts))).tolist()
    return list(zip(edges, edges[1:]))


def discounts(n: list[int], k: int = DISCOUNTED) -> np.ndarray:
    """Good-Turing discounts of counts 0 to k from the counts of counts n[r]; 1 where they give none between 0 and 1."""
    d = np.ones(k + 1)
    if n[1] and (common := (k + 1) * n[k + 1] / n[1]) < 1:
        for r in range(1, k + 1):
            if n[r] and n[r + 1]:
                x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0) * c


class Words:
    """P(w) and the base score, from the statistics of word counts."""

    def __init__(self, n: list[int], total: int, distinct: int):
        self.d, self.total, self.distinct = discounts(n), total, distinct
        mass = sum(self.d[r] * r * n[r] for r in range(1, len(self.d))) + (total - sum(r * n[r] for r in range(1, len(self.d))))
        self.over = total if mass < total * (1 - 1e-12) else total + 1
        self.unknown = 1 - mass / self.over

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.over, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(c[c <= DISCOUNTED + 1], minlength=DISCOUNTED + 2).tolist()


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def table_of(b: np.ndarray, w: np.ndarray, spread: dict[int, int], tables: int) -> np.ndarray:
    """The table of triples with the middle word b and the last word w (hashes)."""
    ways = np.ones(len(b), np.uint64)
    if spread:
        names = np.array(sorted(spread), np.uint64)
        at = np.minimum(np.searchsorted(names, b), len(names) - 1)
        ways = np.where(names[at] == b, np.array([spread[int(x)] for x in names], np.uint64)[at], ways)
    return ((mix(b) + mix(w) % ways) % np.uint64(tables)).astype(np.int64)


def hashes_of(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def spread_words(docs: DataFrame, tables: int) -> dict[int, int]:
    """Of each frequent middle word (a hash) over how many tables its triples go; at most ``tables`` words, each with at least a table's share.

    A word with that share has half of it in batches where it has half of that share, so words that are rarer in a
    batch need not be sent; a word whose sent part falls short of the share stays in one table, twice the average at most.
    """
    least = 2 * tables

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            every = [hashes_of(t) for t in column(batch, "text")]
            words, n = np.unique(np.append(np.concatenate(every), np.repeat(BEGIN, len(every))), return_counts=True)
            some = n * least >= n.sum()
            yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(words[some], np.uint64(0)).view(np.int64)), "n": pa.array(np.append(n[some], 0)), "every": pa.array(np.append(np.zeros(some.sum(), np.int64), n.sum()))})

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLED)) == 0)
    counted = sample.mapInArrow(leanly(frequent), "word long, n long, every long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))
    total = counted.agg(F.sum("every")).first()[0] or 0
    hot = counted.where((F.col("n") > 0) & (F.col("n") * tables >= total)).collect()
    return {r["word"] % (1 << 64): max(2, min(tables, -(-r["n"] * PARTS * tables // total))) for r in hot}


_BLOBS = ("words", "pb", "pw", "pn", "ta", "tc", "en", "ed", "et")
SENT = pa.schema([("table", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in _BLOBS)])


def send(batches: Iterator[pa.RecordBatch], tables: int, modulus: int, spread: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Distinct triples of batches of documents for their tables; under table -1 the documents' ids and lengths."""
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 32, 0
    ids, hashes, held = [], [], 0

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal ids, hashes, held, made
        part = base + made
        made += 1
        n = np.fromiter(map(len, hashes), np.int64, len(hashes)) + 1
        # tokens as numbers of the batch's distinct hashes, the begin mark's among them
        w = np.empty(int(n.sum()) + 1, np.uint64)
        last = np.cumsum(n) - 1
        first = np.append(0, last[:-1] + 1)
        for x, own in zip(first.tolist(), hashes):
            w[x : x + len(own)] = own
        w[-1] = BEGIN
        w[last] = END
        own, hashes = None, []
        distinct, number = numbered(w)
        del w
        number, begin = number[:-1], number[-1]
        b = np.roll(number, 1)
        b[first] = begin
        a = np.roll(b, 1)
        a[first] = begin
        train = np.fromiter((fold(i, modulus) != 0 for i in ids), bool, len(ids))
        doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        table = np.empty(len(number), np.int32)
        for x in range(0, len(number), PIECE):
            y = x + PIECE
            table[x:y] = table_of(distinct[b[x:y]], distinct[number[x:y]], spread, tables)
        rows = {k: [] for k in SENT.names}

        def put(where, own_ids, *blobs):
            for k, v in zip(SENT.names, (where, part, own_ids, *blobs)):
                rows[k].append(v)

        def put_tables(low: int, high: int) -> None:
            """The triples of tables low to high - 1."""
            at = np.flatnonzero((table >= low) & (table < high))
            at = at[np.lexsort((a[at], number[at], b[at], table[at]))]  # stable, so documents ascend within a triple
            i, j, k, d = b[at], number[at], a[at], doc[at]
            # entries: a triple in a document
            starts = _firsts(i, j, k, d)
            tf = _sizes(starts, len(d)).astype(np.uint32)
            i, j, k, d, to = i[starts], j[starts], k[starts], d[starts], table[at[starts]]
            triple = _firsts(i, j, k)
            c = np.add.reduceat(tf * train[d], triple, dtype=np.int64)
            entries = _sizes(triple, len(d))
            i, j, k, to = i[triple], j[triple], k[triple], to[triple]
            entry = np.append(triple, len(d))
            cut = np.append(_firsts(to), len(to)).tolist()
            for x, y in zip(cut, cut[1:]):
                used = np.unique(np.concatenate((k[x:y], i[x:y], j[x:y])))
                own_b, own_w, own_a = (np.searchsorted(used, v[x:y]) for v in (i, j, k))
                pair = _firsts(own_b, own_w)
                e, f = entry[x], entry[y]
                put(int(to[x]), None, squeeze_sorted(distinct[used]), squeeze(np.diff(own_b[pair], prepend=0), np.uint32), squeeze(own_w[pair], np.uint32), squeeze(_sizes(pair, y - x), np.uint32), squeeze(own_a, np.uint32), squeeze(c[x:y], np.uint32), squeeze(entries[x:y], np.uint32), squeeze(d[e:f]), squeeze(tf[e:f], np.uint32))

        put(-1, ids, *[None] * 6, squeeze(n, np.uint32), None, None)
        ids, held = [], 0
        before = np.append(0, np.cumsum(np.bincount(table, minlength=tables)))
        for low, high in pieces(before[:-1], len(table)):
            put_tables(low, high)
            yield pa.RecordBatch.from_pydict(rows, schema=SENT)
            rows = {k: [] for k in SENT.names}

    for batch in slices(batches):
        for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text")):
            ids.append(doc_id)
            hashes.append(hashes_of(text))
            held += len(hashes[-1]) + 1
            if held >= BATCH_TOKENS:
                yield from settle()
    if ids:
        yield from settle()


KEPT = pa.schema([("table", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("n2", pa.list_(pa.int64())), ("n3", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("words", "pb", "pw", "pn", "ta", "tc", "n", "ep", "ed", "et", "parts"))])


class Table:
    """One table's triples in order of b, w, a: numbers of its words, pairs as runs of triples, b as runs of pairs."""

    def __init__(self, row: dict):
        self.words = opened_sorted(row["words"])
        self.pb, self.pw = np.cumsum(opened(row["pb"], np.uint32), dtype=np.uint32), opened(row["pw"], np.uint32)
        self.pn = opened(row["pn"], np.uint32)
        self.ta, self.tc = opened(row["ta"], np.uint32), opened(row["tc"], np.uint32)

    def pairs(self) -> np.ndarray:
        """The number of each triple's pair."""
        return np.repeat(np.arange(len(self.pn), dtype=np.uint32), self.pn)

    def pair_counts(self) -> np.ndarray:
        return np.add.reduceat(self.tc, np.cumsum(self.pn, dtype=np.int64) - self.pn, dtype=np.int64)


def merge(batch: pa.Table) -> pa.Table:
    """One table's triples from all batches."""
    number = batch.column("table")[0].as_py()
    if number == -1:
        out = [{"table": -1, "part": r["part"], "ids": r["ids"], "n": r["en"]} for r in batch.to_pylist()]
        return pa.Table.from_pydict({k: [r.get(k) for r in out] for k in KEPT.names}, schema=KEPT)
    rows = [row_of(batch, i) for i in range(batch.num_rows)]
    every, some = np.empty(0, np.uint64), []
    for i, r in enumerate(rows):
        some.append(opened_sorted(r["words"]))
        if i == len(rows) - 1 or sum(map(len, some)) > 4 * PIECE:
            every, some = np.unique(np.concatenate((every, *some))), []
    size = [zstandard.frame_content_size(r["ta"]) // 4 for r in rows]
    end = np.cumsum(size).tolist()
    own = [slice(y - n, y) for y, n in zip(end, size)]
    a, b, w, c = (np.empty(end[-1], np.uint32) for _ in range(4))
    for r, x in zip(rows, own):
        t = Table(r)
        to = np.searchsorted(every, t.words).astype(np.uint32)
        a[x], b[x], w[x], c[x] = to[t.ta], np.repeat(to[t.pb], t.pn), np.repeat(to[t.pw], t.pn), t.tc
    del t, to
    order = np.lexsort((a, w, b)).astype(np.uint32)
    a = a[order]
    b = b[order]
    w = w[order]
    starts = _firsts(a, b, w)
    a, b, w = a[starts], b[starts], w[starts]
    c = np.add.reduceat(c[order], starts, dtype=np.int64)
    rank = np.zeros(len(order), np.uint32)
    rank[starts[1:]] = 1
    name = np.empty(len(order), np.uint32)
    name[order] = np.cumsum(rank, dtype=np.uint32)
    del order, starts, rank
    pair = _firsts(b, w)
    row = {"table": number, "n2": counts_of_counts(np.add.reduceat(c, pair)), "n3": counts_of_counts(c), "words": squeeze_sorted(every), "pb": squeeze(np.diff(b[pair].astype(np.int64), prepend=0), np.uint32), "pw": squeeze(w[pair]), "pn": squeeze(_sizes(pair, len(a)), np.uint32), "ta": squeeze(a), "tc": squeeze(c, np.uint32)}
    del every, a, b, w, c, pair
    # entries stay as they came, one array after the other
    ep = np.concatenate([np.repeat(name[x], opened(r["en"], np.uint32)) for r, x in zip(rows, own)])
    row["ep"] = squeeze(np.diff(ep, prepend=np.uint32(0)).view(np.int32))
    del ep, name
    ed = [opened(r["ed"], np.uint32) for r in rows]
    row["parts"] = squeeze(np.array([(r["part"], int(d.max()) + 1, len(d)) for r, d in zip(rows, ed)], np.int64))
    row["ed"] = squeeze(np.concatenate(ed))
    del ed
    row["et"] = squeeze(np.concatenate([opened(r["et"], np.uint32) for r in rows]))
    return pa.Table.from_pydict({k: [row.get(k)] for k in KEPT.names}, schema=KEPT)


ASKED = pa.schema([("to", pa.int64()), ("table", pa.int64()), ("key", pa.binary()), ("value", pa.binary())])
TOLD = pa.schema([("table", pa.int64()), ("by", pa.int64()), ("kind", pa.string()), ("value", pa.binary()), ("nn", pa.list_(pa.int64()))])


def ask(table: int, keys: np.ndarray, values: np.ndarray, tables: int) -> pa.RecordBatch:
    """Sorted keys and the table's values of them (a row of numbers each), dealt by key."""
    to = (mix(keys) % np.uint64(tables)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cut = np.append(np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0))), len(to)).tolist()
    rows = [(int(to[order[x]]), table, squeeze_sorted(keys[order[x:y]]), squeeze(values[order[x:y]])) for x, y in zip(cut, cut[1:]) if y > x]
    return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(ASKED.names)}, schema=ASKED)


def answers(rows: list[dict], kind: str, keys: np.ndarray, tables: int, width: int, of) -> np.ndarray:
    """What tell() answered for keys, in their order."""
    to = (mix(keys) % np.uint64(tables)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    got = sorted((r["by"], r["value"]) for r in rows if r["kind"] == kind)
    out = np.empty((len(keys), width), of)
    out[order] = np.concatenate([opened(v, of).reshape(-1, width) for _, v in got]) if got else 0
    return out


def teller(kind: str, width: int, of):
    def tell(batch: pa.Table) -> pa.Table:
        """Sums of the values of equal keys over all tables that ask, told to each of them."""
        rows = batch.to_pylist()
        keys = [opened_sorted(r["key"]) for r in rows]
        values = np.concatenate([opened(r["value"], of).reshape(-1, width) for r in rows])
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(number, weights=values[:, i], minlength=len(distinct)) for i in range(width)], axis=1).astype(of)
        every, at, out = sums[number], 0, []
        for r, k in zip(rows, keys):
            out.append((r["table"], r["to"], kind, squeeze(every[at : at + len(k)]), None))
            at += len(k)
        if kind == "w":
            c = sums[:, 0].astype(np.int64)
            out.append((-1, rows[0]["to"], "n", None, [int(c.sum()), int((c > 0).sum()), *counts_of_counts(c)]))
        return pa.Table.from_pydict({k: [r[i] for r in out] for i, k in enumerate(TOLD.names)}, schema=TOLD)

    return tell


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"`{f.name}` {kinds.get(f.type, 'array<long>')}" for f in schema)


SUMS = pa.schema([("part", pa.int64()), ("first", pa.int64()), ("known", pa.binary()), ("base", pa.binary()), ("score", pa.binary()), ("ids", pa.list_(pa.int64())), ("n", pa.binary())])


class History:
    """over and alpha of histories from c, discounted mass and the lower-order mass of their seen words."""

    def __init__(self, c: np.ndarray, mass: np.ndarray, seen: np.ndarray):
        self.over = np.where(mass < c * (1 - 1e-12), c, c + 1)
        self.alpha = np.where(c > 0, (1 - mass / self.over) / np.maximum(1 - seen, 1e-300), 1.0)


def _sums(starts: np.ndarray, c: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Columns c, mass and seen of each run of n-grams with the counts c; lower: their words' lower-order probabilities."""
    out = np.empty((len(starts), 3))
    out[:, 0] = np.add.reduceat(c, starts, dtype=np.float64)
    out[:, 1] = np.add.reduceat(discounted(c, d), starts)
    out[:, 2] = np.add.reduceat(np.where(c > 0, lower, 0.0), starts)
    return out


class Round:
    """What a table can tell at each round, from its own triples and what it has been told."""

    def __init__(self, row: dict, told: list[dict], tables: int, model: Words, d2: np.ndarray, d3: np.ndarray, spread: dict[int, int]):
        self.t, self.told, self.tables, self.d2, self.d3 = Table(row), told, tables, d2, d3
        t = self.t
        self.cw = answers(told, "w", t.words, tables, 1, np.int64)[:, 0]
        self.c2 = t.pair_counts()
        self.p1 = model.p(self.cw)[t.pw]
        self.b = _firsts(t.pb)  # first pair of each b
        self.hot = np.isin(t.words[t.pb[self.b]], np.array(sorted(spread), np.uint64))
        self.sums_b = _sums(self.b, self.c2, d2, self.p1)

    def ask_b(self) -> pa.RecordBatch:
        keys = self.t.words[self.t.pb[self.b]]  # ascending, as numbers of words are
        return ask(self.t_number, keys[self.hot], self.sums_b[self.hot], self.tables)

    def with_b(self) -> None:
        """P(w | b) of all pairs."""
        sums = self.sums_b.copy()
        if self.hot.any():
            sums[self.hot] = answers(self.told, "b", self.t.words[self.t.pb[self.b]][self.hot], self.tables, 3, np.float64)
        t, h, of = self.t, History(*sums.T), np.repeat(np.arange(len(self.b), dtype=np.uint32), _sizes(self.b, len(self.t.pb)))
        self.p2 = self.p1
        for x in range(0, len(of), PIECE):
            y = x + PIECE
            c, own = self.c2[x:y], of[x:y]
            self.p2[x:y] = np.where(c > 0, discounted(c, self.d2) / h.over[own], h.alpha[own] * self.p1[x:y])
        del self.p1, self.c2
        # triples by history: a within b
        self.pair = t.pairs()
        group = of[self.pair]
        self.order = np.lexsort((t.ta, group)).astype(np.uint32)
        self.h = _firsts(group[self.order], t.ta[self.order])
        self.hot_h = self.hot[group[self.order[self.h]]]
        first = self.order[self.h[self.hot_h]]
        self.keys_h = mix(mix(t.words[t.ta[first]]) + t.words[t.pb[self.pair[first]]])  # of spread histories

    def histories(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of histories, their triples and sums."""
        for x, y in pieces(self.h, len(self.order)):
            own = self.order[self.h[x] : self.h[y] if y < len(self.h) else len(self.order)]
            yield x, y, own, _sums(self.h[x:y] - self.h[x], self.t.tc[own], self.d3, self.p2[self.pair[own]])

    def ask_h(self) -> pa.RecordBatch:
        at = np.argsort(self.keys_h, kind="stable")
        sums = np.concatenate([np.empty((0, 3)), *[sums[self.hot_h[x:y]] for x, y, _, sums in self.histories()]])
        return ask(self.t_number, self.keys_h[at], sums[at], self.tables)

    def probabilities(self) -> np.ndarray:
        """P(w | a b) of all triples."""
        told = np.empty((len(self.keys_h), 3))
        if len(told):
            at = np.argsort(self.keys_h, kind="stable")
            told[at] = answers(self.told, "h", self.keys_h[at], self.tables, 3, np.float64)
        out, done = np.empty(len(self.order)), 0
        for x, y, own, sums in self.histories():
            hot = np.flatnonzero(self.hot_h[x:y])
            sums[hot] = told[done : done + len(hot)]
            done += len(hot)
            h, of = History(*sums.T), np.repeat(np.arange(y - x), _sizes(self.h[x:y] - self.h[x], len(own)))
            c = self.t.tc[own]
            out[own] = np.where(c > 0, discounted(c, self.d3) / h.over[of], h.alpha[of] * self.p2[self.pair[own]])
        return out


def score_documents(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows whose fold isn't 0."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tables = max(4, -(-total // TABLE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spread = spread_words(rows, tables)
    sent = rows.mapInArrow(leanly(lambda batches: send(batches, tables, modulus, spread)), ddl(SENT))
    alone = F.when(F.col("table") == -1, F.col("part")).otherwise(0)
    kept = materialize_bucketed(sent.groupBy("table", alone.alias("_")).applyInArrow(lambda t: lean(merge, t), ddl(KEPT)), "katz-triples", "table", tables)
    triples = kept.where("table >= 0")
    nn = triples.select(*[F.sum(F.element_at(c, i + 1)).alias(f"{c}_{i}") for c in ("n2", "n3") for i in range(DISCOUNTED + 2)]).first()
    d2, d3 = (discounts([nn[f"{c}_{i}"] or 0 for i in range(DISCOUNTED + 2)]) for c in ("n2", "n3"))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = row_of(batch, i)
                t = Table(r)
                counts = np.bincount(t.pw, weights=t.pair_counts(), minlength=len(t.words)).astype(np.int64)
                yield ask(r["table"], t.words, counts, tables)

    shape = ["table", "words", "pb", "pw", "pn", "ta", "tc"]
    tell_words = teller("w", 1, np.int64)
    words = materialize(triples.select(*shape).mapInArrow(leanly(ask_words), ddl(ASKED)).groupBy("to").applyInArrow(lambda t: lean(tell_words, t), ddl(TOLD)), "katz-words")
    n = words.where("kind = 'n'").select([F.sum(F.element_at("nn", i + 1)).alias(f"n{i}") for i in range(DISCOUNTED + 4)]).first()
    n = [x or 0 for x in n]
    model = Words(n[2:], n[0], n[1])
    told = words.where("kind = 'w'").select("table", "by", "kind", "value")

    def opened_round(left: pa.Table, right: pa.Table) -> Round:
        row = row_of(left, 0)
        r = Round(row, right.to_pylist(), tables, model, d2, d3, spread)
        r.t_number = row["table"]
        return r

    def round_b(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([opened_round(left, right).ask_b()], ASKED)

    def round_h(left: pa.Table, right: pa.Table) -> pa.Table:
        r = opened_round(left, right)
        r.with_b()
        return pa.Table.from_batches([r.ask_h()], ASKED)

    # sums of spread histories, first of pairs and then, as they need P(w | b), of triples
    for kind, tell in (("b", round_b), ("h", round_h)):
        if spread:
            asked = triples.select(*shape).groupBy("table").cogroup(told.groupBy("table")).applyInArrow((lambda f: lambda x, y: lean(f, x, y))(tell), ddl(ASKED))
            told = told.unionByName(materialize(asked.groupBy("to").applyInArrow((lambda f: lambda t: lean(f, t))(teller(kind, 3, np.float64)), ddl(TOLD)), f"katz-{kind}").select("table", "by", "kind", "value"))

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        r = opened_round(left, right)
        r.with_b()
        p, row, w = r.probabilities(), row_of(left, 0), r.t.pw[r.pair]
        known, base = r.cw > 0, model.base(r.cw)
        del r
        np.log10(p, out=p)
        ep, ed, et = opened(row["ep"], np.int32), opened(row["ed"], np.uint32), opened(row["et"], np.uint32)
        out, at, before = [], 0, 0
        for part, k, m in opened(row["parts"], np.int64).reshape(-1, 3).tolist():
            x, at = at, at + m
            triple = np.cumsum(ep[x:at], dtype=np.int64) + before
            before, word, n = triple[-1], w[triple], et[x:at]
            columns = [np.bincount(ed[x:at], weights=n * v, minlength=k) for v in (known[word], base[word], p[triple])]
            out.append((part, 0, squeeze(columns[0], np.int32), squeeze(columns[1]), squeeze(columns[2]), None, None))
        return pa.Table.from_pydict({k: [x[i] for x in out] for i, k in enumerate(SUMS.names)}, schema=SUMS)

    by_table = triples.drop("part", "ids", "n2", "n3", "n").groupBy("table").cogroup(told.groupBy("table")).applyInArrow(lambda a, b: lean(sums, a, b), ddl(SUMS))
    names = kept.where("table = -1").select("part", F.lit(0).cast("long").alias("first"), *[F.lit(None).cast("binary").alias(k) for k in ("known", "base", "score")], "ids", "n")

    def finish(batch: pa.Table) -> pa.Table:
        rows = batch.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        totals = [np.zeros(len(own["ids"])) for _ in range(3)]
        for r in rows:
            if r["ids"] is None:
                for t, (k, of) in zip(totals, (("known", np.int32), ("base", np.float64), ("score", np.float64))):
                    x = opened(r[k], of)
                    t[: len(x)] += x
        n = len(own["ids"])
        return pa.table({"doc_id": pa.array(own["ids"], pa.int64()), "held_out": pa.array([fold(i, modulus) == 0 for i in own["ids"]], pa.bool_()), "n_tokens": pa.array(opened(own["n"], np.uint32).astype(np.int64)), "n_known": pa.array(totals[0].astype(np.int64)), "train_tokens": pa.array(np.full(n, model.total), pa.int64()), "base_score": pa.array(totals[1]), "score": pa.array(totals[2])})

    return by_table.unionByName(names).groupBy("part").applyInArrow(lambda t: lean(finish, t), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
