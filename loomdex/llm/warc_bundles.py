"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a group of WARC
records, and ends in a skippable frame with a seek table (compressed and raw size of
every frame), as the public seekable format has it.  The index maps a record's id to
bundle, frame and offset in the frame, so one record costs one frame to read.

Roles: of records with equal payloads (by SHA-1 and length) of at least ``LEAST``
bytes, those of the largest id are responses and the others revisit it.

Writing: a task names its bundle anew in every attempt and its index rows come from
the attempt that succeeded, so a repeated task leaves at worst an unused file.

Cases: a null html is an empty payload; a null url is written as an empty target; of
repeated rows with the largest id all are responses; null ids rank below all others,
and are all responses if no other has the payload; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm import common as C

LEAST = 1000
#: Raw bytes after which a frame is closed, and stored bytes after which a bundle is.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 30
LEVEL = 3
#: Raw bytes of records that a task reads back.
READ_BYTES = 64 << 20

_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: (stored, raw) sizes, then count, flags and magic number."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, stored size, raw size) of every frame of an open bundle."""
    f.seek(0, io.SEEK_END)
    end = f.tell()
    f.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE or flags & 0x7C:
        raise ValueError("not a seekable bundle")
    each = 12 if flags & 0x80 else 8
    f.seek(end - 9 - each * count)
    body, out, at = f.read(each * count), [], 0
    for i in range(count):
        stored, raw = struct.unpack_from("<II", body, i * each)
        out.append((at, stored, raw))
        at += stored
    return out


def _line(value: str | None) -> str:
    return "".join(" " if c in "\r\n" else c for c in value or "")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block but the digest and length of what it stands for."""
    block = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", _line(url)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record at an offset."""
    raw = bytes(raw) if at == 0 and not isinstance(raw, bytes) else raw
    stop = raw.index(b"\r\n\r\n", at)
    lines = raw[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(head["content-length"])
    block = raw[stop + 4 : stop + 4 + size]
    return head, block, stop + 8 + size


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


class _Bundle:
    def __init__(self, folder: str, level: int) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, p = _open(self.path)
        fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
        self.out, self.size, self.frames, self.level = fs.open_output_stream(p, compression=None), 0, [], level

    def frame(self, raw: bytes) -> None:
        stored = zstandard.ZstdCompressor(level=self.level, write_content_size=True).compress(raw)
        self.out.write(stored)
        self.frames.append((len(stored), len(raw)))
        self.size += len(stored)

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def roles(pages: DataFrame, ident: str = "page_id", html: str = "html", least: int = LEAST) -> DataFrame:
    """``pages`` with payload (binary), payload_digest, record_type and refers_to."""
    own = ["payload", "payload_digest", "record_type", "refers_to"]
    body = C.set_aside(pages, F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"), F.col(ident).alias("id"))
    body = body.withColumn("payload_digest", F.sha1("payload"))
    # digest and length in one key; null for payloads that are too small to be told apart by it
    body = body.withColumn("key", F.when(F.octet_length("payload") >= least, F.concat_ws(":", "payload_digest", F.octet_length("payload"))))
    # groups are combined before the shuffle; the largest id of each goes back to its members
    first = body.filter("key is not null").groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("m")).filter("m > 1")
    out = C.spread_join(body, C.stored(first), "key", "m")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    out = out.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))})
    return C.put_back(out, own)


def write_bundles(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write rows of ``roles`` as bundles in a shared folder; the stored index: (page_id, bundle, frame, at, size)."""
    C.small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, held, size, rows = None, [], 0, []

        def flush():
            nonlocal held, size
            if held:
                bundle.frame(b"".join(held))
                held, size = [], 0

        for b in batches:
            for i, u, p, d, k, r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                if bundle is None:
                    bundle = _Bundle(folder, level)
                record = make_record(i, u, p, d, k, r)
                rows.append((i, bundle.path, len(bundle.frames), size, len(record)))
                held.append(record)
                size += len(record)
                if size >= frame_bytes:
                    flush()
                    if bundle.size >= bundle_bytes:
                        bundle.close()
                        bundle = None
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["page_id", "bundle", "frame", "at", "size"])
            rows = []
        if bundle is not None:
            flush()
            bundle.close()

    from pyspark.sql.pandas.types import to_arrow_type

    source = pages.select(F.col(ident).alias("id"), F.col(url).alias("url"), "payload", "payload_digest", "record_type", "refers_to")
    kind = to_arrow_type(source.schema["id"].dataType)
    return C.stored(source.mapInArrow(C.tidy(write), f"page_id {source.schema['id'].dataType.simpleString()}, bundle string, frame int, at long, size long"))


def read_record(bundle: str, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: reads the seek table and one frame."""
    fs, p = _open(bundle)
    with fs.open_input_file(p) as f:
        where, stored, size = read_seek_table(f)[frame]
        f.seek(where)
        raw = zstandard.ZstdDecompressor().decompress(f.read(stored), max_output_size=size)
    return parse_record(raw, at)[:2]


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of an index, read back frame by frame: headers as a map, block, and the index's page_id."""
    C.small_batches(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, frame, raw, table, f = None, None, b"", [], None
        for b in batches:
            heads, blocks = [], []
            for p, k, at in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "at")), strict=True):
                if p != path:
                    if f is not None:
                        f.close()
                    fs, q = _open(p)
                    path, frame, f = p, None, fs.open_input_file(q)
                    table = read_seek_table(f)
                if k != frame:
                    f.seek(table[k][0])
                    raw, frame = zstandard.ZstdDecompressor().decompress(f.read(table[k][1]), max_output_size=table[k][2]), k
                head, block, _ = parse_record(raw, at)
                heads.append(list(head.items()))
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], ["page_id", "headers", "block"])
        if f is not None:
            f.close()

    kind = index.schema["page_id"].dataType.simpleString()
    # tasks by the bytes that will be read, which the index knows; its own size would say too few
    total = index.agg(F.sum("size")).first()[0] or 0
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // READ_BYTES))
    rows = index.repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    return rows.mapInArrow(C.tidy(read), f"page_id {kind}, headers map<string,string>, block binary")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write_bundles(roles(pages).drop("html"), C.shared_folder(spark))
    back = read_bundles(index)
    h = F.col("headers")
    refers = F.regexp_extract(h["warc-refers-to"], "<urn:page:(-?[0-9]+)>", 1).cast("long")
    # a response's digest and length are taken from the payload that came back
    own = h["warc-type"] == "response"
    return back.select(
        "page_id",
        F.when(own, F.octet_length("block")).otherwise(h["warc-payload-length"].cast("int")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("block")).otherwise(F.substring_index(h["warc-payload-digest"], ":", -1)).alias("payload_digest"),
        h["warc-type"].alias("record_type"),
        refers.alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM r
"""
