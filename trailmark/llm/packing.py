"""Packing of tokenised documents into training sequences, by tiers of context length.

Documents are tokenised, an end token is added, and whole windows of the longest context are cut off.  What remains of
a document goes to the smallest tier (1024, 512, 256, 128) that holds it.  Tiers are packed from the longest: each
remainder opens a window of its tier, whose gap is filled with the longest pieces of shorter tiers that fit and, where
none fits, with a part cut from the shortest.  So every window is full; the last one of a packing group is cut at
powers of two, which need no padding.  The sequences of a tier are dealt to step groups of equal tokens, largest
attention cost first and back and forth, so that steps take alike long.

A packing group is a run of documents of one input partition with about ``group_tokens`` tokens: nothing is shuffled,
memory is bounded, and a lost task packs the same group again.

Null texts count as empty: such a document is the end token alone.  Texts that contain the tokenizer's special tokens
are encoded as tokenizers does.  Repeated rows and null ids are packed like any other row.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, slices, trimmed

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 8192
GROUP_TOKENS = 2_000_000
#: How byte-level BPE cuts a text before it merges: a published pattern, a fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 200_000


class Encoder:
    """tokenizers' ids, with the pieces that a byte-level BPE encodes on their own kept by the worker.

    The pieces are cut here only for the definition whose rules PIECES states (no normalizer, byte-level, no prefix
    space), only if its merges come in the order of their tokens' ids, and only in texts of characters that both sides
    put into the same class; all else is encoded by tokenizers as a whole.
    """

    def __init__(self, definition: str):
        import regex
        import tiktoken
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(definition)
        self.pieces = regex.compile(PIECES).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rules = json.loads(definition)
        cut, model = rules.get("pre_tokenizer") or {}, rules.get("model") or {}
        known = not rules.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and model.get("type") == "BPE"
        known = known and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        # the same vocabulary as byte ranks, for pieces on their own
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        self.single = None
        if known and all(c in byte for t in vocabulary for c in t):
            merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
            if None not in merged and all(a < b for a, b in zip(merged, merged[1:])) and len(vocabulary) == len(merged) + 256:
                ranks = {bytes([byte[c] for c in t]): i for t, i in vocabulary.items()}
                self.single = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        store = sys.modules.setdefault("_corpus_piece_cache", types.ModuleType("_corpus_piece_cache"))
        self.cache: dict[str, bytes] = store.__dict__.setdefault(f"k{zlib.crc32(definition.encode())}", {})
        self.alike: dict[str, None] = store.__dict__.setdefault(f"c{zlib.crc32(definition.encode())}", {})  # characters cut alike

    def cut_alike(self, c: str) -> bool:
        """Whether tokenizers cuts around c as PIECES does: next to letters, digits, signs, spaces, itself and a short form."""
        probe = f"a{c}a1{c}1!{c}! {c} {c}{c}  {c}'s{c}'t\n{c}"
        spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        at, own = 0, []
        for x in self.pieces(probe):
            own.append((at, at + len(x)))
            at += len(x)
        return spans == own

    def known_text(self, text: str) -> bool:
        new = () if text.isascii() else set(text).difference(self.alike)
        self.alike.update((c, None) for c in new if self.cut_alike(c))
        return all(c in self.alike for c in new)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes | None] = []
        bytes_of = lambda ids: array("I", ids).tobytes()
        for text in texts:
            text = text or ""
            if self.single is None or any(s in text for s in self.special) or not self.known_text(text):
                out.append(bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            pieces = self.pieces(text)
            try:
                out.append(b"".join(map(self.cache.__getitem__, pieces)))
            except KeyError:
                if len(self.cache) > CACHED:
                    self.cache.clear()
                new = set(pieces).difference(self.cache)
                self.cache.update((p, bytes_of(self.single(p.encode("utf-8", "replace")))) for p in new)
                out.append(b"".join(map(self.cache.__getitem__, pieces)))
        return out


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) and the length of each sequence."""
    top = tiers[0]
    pieces, sequences = [], []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def route(length: int, doc: int, start: int) -> None:
        insort(pools[next(t for t in reversed(tiers) if t >= length)], (length, doc, start))

    rest = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - top + 1, top):
            pieces.append((doc, start, top, len(sequences), 0))
            sequences.append(top)
        if n % top:
            rest.append((n % top, doc, n - n % top))
    for length, doc, start in sorted(rest):
        pools[next(t for t in reversed(tiers) if t >= length)].append((length, doc, start))

    def filler(gap: int, below: int) -> tuple[int, int, int] | None:
        """The longest piece of tiers up to below that fits, else one to cut: the shortest there is."""
        for t in tiers:
            if t <= below and pools[t] and pools[t][0][0] <= gap:
                return pools[t].pop(bisect_right(pools[t], (gap, 1 << 60, 0)) - 1)
        for t in reversed(tiers):
            if pools[t]:
                return pools[t].pop(0)
        return None

    for i, tier in enumerate(tiers):
        below = tiers[min(i + 1, len(tiers) - 1)]
        while pools[tier]:
            window, held = [pools[tier].pop()], 0
            held = window[0][0]
            while held < tier and (piece := filler(tier - held, below)):
                length, doc, start = piece
                if length > tier - held:
                    route(length - (tier - held), doc, start + tier - held)
                    length = tier - held
                window.append((length, doc, start))
                held += length
            # a window that nothing fills ends at powers of two
            spans = [tier] if held == tier else [1 << b for b in reversed(range(held.bit_length())) if held >> b & 1]
            at, room = 0, 0
            for length, doc, start in window:
                while length:
                    if not room:
                        room, at = spans.pop(0), 0
                        sequences.append(room)
                    part = min(length, room)
                    pieces.append((doc, start, part, len(sequences) - 1, at))
                    length, start, at, room = length - part, start + part, at + part, room - part
    return pieces, sequences


def step_groups(pieces: list[tuple[int, int, int, int, int]], sequences: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step group of each sequence: one length and step_tokens tokens a group, with the attention costs balanced."""
    cost = np.zeros(len(sequences), np.int64)
    for _, _, length, sequence, _ in pieces:
        cost[sequence] += length * length
    size, group, n = np.array(sequences), np.zeros(len(sequences), np.int64), 0
    for length in sorted(set(sequences), reverse=True):
        own = np.flatnonzero(size == length)
        own = own[np.argsort(-cost[own], kind="stable")]
        steps = -(-len(own) * length // max(step_tokens, length))
        turn = np.arange(len(own)) % (2 * steps)
        group[own] = n + np.minimum(turn, 2 * steps - 1 - turn)
        n += steps
    return group.tolist()


def pack_documents(docs: DataFrame, tokenizer_path: str, end: int = 0, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group, and ids if asked for."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder, last = Encoder(definition), np.array([end], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 36
        doc_ids, ids, held, made, steps = [], [], 0, 0, 0

        def settle() -> pa.RecordBatch:
            nonlocal doc_ids, ids, held, made, steps
            lengths = [len(x) // 4 for x in ids]
            pieces, sequences = pack(lengths)
            group = step_groups(pieces, sequences)
            p = np.array(pieces, np.int64).reshape(-1, 5)
            crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces]
            columns = [pa.array([doc_ids[d] for d in p[:, 0].tolist()], pa.int64()), pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array(crc, pa.int64()), pa.array(np.array(lengths)[p[:, 0]]), pa.array(base + made + p[:, 3]), pa.array(p[:, 4]), pa.array(np.array(sequences)[p[:, 3]]), pa.array(base + steps + np.array(group)[p[:, 3]])]
            if with_ids:
                columns.append(pa.array([np.frombuffer(ids[d], "<u4")[s : s + n].astype(np.int32) for d, s, n, _, _ in pieces], pa.list_(pa.int32())))
            made, steps = made + len(sequences), steps + max(group) + 1
            doc_ids, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

        for batch in slices(batches, "text", 2 << 20):
            for doc_id, x in zip(column(batch, "doc_id"), encoder.encode(column(batch, "text"))):
                doc_ids.append(doc_id)
                ids.append(x + last)
                held += len(x) // 4 + 1
                if held >= group_tokens:
                    yield settle()
        if ids:
            yield settle()

    schema = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(packed), schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
