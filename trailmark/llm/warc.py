"""WARC archives compressed with Zstandard, one frame per record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record follows as a frame
of its own, so records can be read from any offset.  ``write_archives`` turns pages into archives of bounded size,
``read_archives`` decodes and validates them: version line, mandatory fields, Content-Length against the block, the
closing blank lines, and the payload digest.  Archives are rows with a binary column, in the shared folder;
``export_archives`` makes files of them, and ``binaryFile`` frames of real ``.warc.zst`` files read the same way.  An
archive is one value, so a file may have 2 GB at most; its records are decoded one at a time.

All kinds of records are read.  Responses, requests and revisits have an HTTP head; a body in chunks is put together;
others (warcinfo, metadata, resource, conversion) have their block as payload.  Ids that aren't numbers of pages come as
``record_id`` and ``refers_to_id``, and page_id and refers_to are null.

Of records with equal payloads the one with the largest page_id holds the payload, the others are revisits that refer
to it.  Null html is an empty payload, a null url is ``about:blank``, a null page_id sorts below every other one and
is written as ``null``.  Rows that repeat a page_id and a payload: one holds the payload, the others refer to it.
Empty tables make no archive; extra columns aren't read.  A record that fails a check is returned with its fault in
``error`` and null fields, never skipped silently.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices

DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
#: Equal payloads are dealt over so many keys, so that a payload of a third of all pages isn't one task's.
SALTS = 32
FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit if refers_to names the page that holds the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url or 'about:blank')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from up to 200 pieces of the archive's first records; raw bytes of them if there are too few to train on."""
    pieces = [r[:2048] for r in records[:200]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(pieces)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> bytes:
    """One archive: the dictionary's frame, then a frame per record."""
    dictionary = train(records)
    raw = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(compressor.compress, records)])


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, in order; ValueError where the bytes are no archive."""
    if len(content) < 8 or struct.unpack_from("<I", content)[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start")
    size = struct.unpack_from("<I", content, 4)[0]
    if len(content) < 8 + size:
        raise ValueError("the dictionary frame is cut off")
    raw = content[8 : 8 + size]
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest = memoryview(content)[8 + size :]
    while rest:
        one = decompressor.decompressobj()
        try:
            data = one.decompress(rest)
        except zstandard.ZstdError as e:
            raise ValueError(f"bad frame: {e}") from None
        if not one.eof:
            raise ValueError("the last frame is cut off")
        yield data
        rest = rest[len(rest) - len(one.unused_data) :] if one.unused_data else rest[len(rest) :]


def parse(data: bytes) -> dict:
    """The fields, HTTP head and payload of a record; ValueError if it breaks a rule."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line[:40]!r}")
        fields[key.strip().lower()] = value.strip()
    if lost := [f for f in FIELDS if f.lower() not in fields]:
        raise ValueError(f"lacks {lost[0]}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        raise ValueError("Content-Length doesn't match the block")
    if rest[-4:] != b"\r\n\r\n":
        raise ValueError("no blank lines at the end")
    kind, block, digest = fields["warc-type"], rest[:-4], fields.get("warc-payload-digest", "")
    out = {"record_id": fields["warc-record-id"], "record_type": kind, "refers_to_id": fields.get("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload_digest": digest.removeprefix("sha1:") or None}
    out |= {"page_id": page_number(out["record_id"]), "refers_to": page_number(out["refers_to_id"] or "")}
    payload, stated, bodies = block, None, [block]
    if kind in ("response", "request", "revisit") and fields.get("content-type", "application/http").startswith("application/http"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep and kind != "revisit":
            raise ValueError("no HTTP head")
        bodies = [payload]
        if re.search(rb"(?i)\r\ntransfer-encoding:[^\r]*chunked", http):
            payload = joined(payload)
            bodies.append(payload)
        elif found := re.search(rb"(?i)\r\ncontent-length: *(\d+)", http):
            stated = int(found[1])
            if kind != "revisit" and len(payload) != stated and not fields.get("warc-truncated"):
                raise ValueError("the HTTP length doesn't match the payload")
    if kind == "revisit":
        if not out["refers_to_id"] and not digest:
            raise ValueError("a revisit that refers to nothing")
        return out | {"payload_bytes": stated, "payload": None}
    # digests are of the payload as sent or as put together
    if digest.startswith("sha1:") and not fields.get("warc-truncated") and out["payload_digest"] not in map(sha1_base32, bodies):
        raise ValueError("the payload digest doesn't match")
    return out | {"payload_bytes": len(payload), "payload": payload}


def page_number(name: str) -> int | None:
    return int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", name)) else None


def joined(body: bytes) -> bytes:
    """A body sent in chunks, without the marks of the chunks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("a chunk without a size")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if len(body) < end + 4 + n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add digest, holder (the page_id that holds an equal payload of at least least_bytes) and is_holder.

    Only digests with several pages are joined back, each copied SALTS times and met by pages dealt over the copies.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    lowest = -(1 << 63)
    pages = pages.withColumn("_sha", F.sha1(F.col("html").cast("binary"))).withColumn("_key", F.coalesce("page_id", F.lit(lowest)))
    # rows are numbered once and stored with their numbers, so both sides of the join mean the same rows, whatever is lost
    pages = materialize(pages.withColumn("_n", F.octet_length("html")).withColumn("_row", F.monotonically_increasing_id()), "pages")
    thin = pages.select("_sha", "_key", "_row", "_n").where(F.col("_n") >= least_bytes)
    many = thin.groupBy("_sha").agg(F.max(F.struct("_key", "_row")).alias("_top"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    salted = many.select("_sha", "_top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    pages = pages.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    joined = pages.join(salted, ["_sha", "_salt"], "left")
    held = F.col("_top").isNotNull() & (F.col("_top._row") != F.col("_row"))
    return joined.select("page_id", "url", "html", F.when(held, F.when(F.col("_top._key") == lowest, F.lit("null")).otherwise(F.col("_top._key").cast("string"))).alias("holder"))


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive_id, records, content): archives of the pages, stored in the shared folder."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "html", ARCHIVE_BYTES):
            rows = batch.to_pydict()
            records = [record(i, u, p := h.encode("utf-8", "replace"), sha1_base32(p), to) for i, u, h, to in zip(rows["page_id"], rows["url"], rows["html"], rows["holder"])]
            yield pa.RecordBatch.from_pydict({"archive_id": pa.array([(part << 32) + n], pa.int64()), "records": pa.array([len(records)], pa.int64()), "content": pa.array([pack(records)], pa.binary())})
            n += 1

    return materialize(plan_revisits(pages, least_bytes).mapInArrow(packed, "archive_id long, records long, content binary"), "archives")


def export_archives(archives: DataFrame, folder: str) -> None:
    """A .warc.zst file for each archive, in a folder that pyarrow's file systems reach; a task that runs again writes the same files."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with system.open_output_stream(f"{root}/{name}.warc.zst.part") as f:
                    f.write(content.as_buffer())
                system.move(f"{root}/{name}.warc.zst.part", f"{root}/{name}.warc.zst")
            yield pa.RecordBatch.from_pydict({"archive_id": batch.column(0)})

    archives.select("archive_id", "content").mapInArrow(written, "archive_id long").count()


FIELDS_READ = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "record_id": pa.string(), "refers_to_id": pa.string(), "error": pa.string()}


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of archives' content column (Spark's binaryFile frames fit): fields, payload if asked for, error."""
    kinds = FIELDS_READ | ({"payload": pa.binary()} if payloads else {})
    schema = ", ".join(f"{k} {({pa.int64(): 'long', pa.binary(): 'binary'}).get(v, 'string')}" for k, v in kinds.items())

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in rows], kind) for k, kind in kinds.items()})

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                try:
                    for data in frames(content.as_py() or b""):
                        try:
                            row = parse(data)
                        except ValueError as e:
                            row = {"error": str(e)}
                        rows.append(row if payloads else row | {"payload": None})
                        held += len(data)
                        if held > ARCHIVE_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                except ValueError as e:
                    rows.append({"error": str(e)})
                if rows:
                    yield batch_of(rows)

    return archives.select("content").mapInArrow(unpacked, schema)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha1(h) as x, max(page_id) over (partition by sha1(h)) as top from p)
select page_id, cast(n as bigint) as payload_bytes,
 array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(x, 1 + (i // 4) * 5, 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)), '') as payload_digest,
 case when page_id = top then 'response' else 'revisit' end as record_type,
 case when page_id = top then null else top end as refers_to, cast(null as varchar) as error
from d
"""
