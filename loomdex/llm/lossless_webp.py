"""Media columns: bytes held as lossless WebP images, and pixel arrays read from them.

``store`` packs a payload into images and adds them as a binary column; ``pixels``
decodes any lossless WebP column (see ``vp8l``) to width, height and an RGBA array;
``features`` reads the payload back and describes it.

A payload is cut into pieces of at most ``PIECE`` bytes, each an image, whose files follow
one another in the column (a WebP file says how long it is), so payloads of any length
are held and no worker needs more than a piece's arrays.  Every image has Huffman codes
and back-references.  Which transforms it has besides turns in equal shares with the
payload's checksum (``FORMS``), so that any table puts the whole decoder to use and equal
texts stay equal: a palette; a colour cache; predictors; or two bytes to a pixel with
cross-colour and predictors.

Cases: a null text is an empty payload of 64 zero bytes; equal texts give equal files; a
null or broken image gives null pixels and an error text; empty tables pass, and so do
other columns, but those that have the name of a result give way to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm import common as C
from loomdex.llm import vp8l

UNIT = 64


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def shape_of(size: int, each: int) -> tuple[int, int]:
    """Width and height of an image of ``size`` bytes: wider than high, at least 16 wide."""
    n = -(-size // each)
    width = min(vp8l.MAX_SIDE, max(16, 1 << ((n.bit_length() + 3) // 2)))
    height = -(-n // width)
    if height > vp8l.MAX_SIDE:
        raise ValueError("the payload is larger than an image can be")
    return width, height


def to_argb(payload: bytes, each: int) -> tuple[np.ndarray, int, int]:
    """Pixels of ``each`` bytes, 1 (green), 2 (green, blue) or 4 (red, green, blue, alpha), with zeros at the end; width and height.

    Alpha is 255 if it holds no payload.
    """
    width, height = shape_of(len(payload), each)
    flat = np.zeros(width * height * each, np.uint8)
    flat[: len(payload)] = np.frombuffer(payload, np.uint8)
    part = flat.reshape(-1, each).T.astype(np.uint32)
    if each == 4:
        return part[3] << 24 | part[0] << 16 | part[1] << 8 | part[2], width, height
    return 0xFF000000 | part[0] << 8 | (part[1] if each == 2 else np.uint32(0)), width, height


def to_image(payload: bytes, each: int = 4) -> np.ndarray:
    """The same as an array (height, width, RGBA)."""
    argb, width, height = to_argb(payload, each)
    return argb.astype("<u4").view(np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]


#: By the payload's checksum: bytes to a pixel and what ``vp8l.encode`` is asked for.
FORMS = (
    (1, {"palette": True}),
    (1, {"cache_bits": 6}),
    (1, {"predictor": True}),
    (2, {"cross": True, "predictor": True}),
)
PIECE = 1 << 20


def to_media(payload: bytes) -> bytes:
    each, wanted = FORMS[zlib.crc32(payload) % len(FORMS)]
    return b"".join(vp8l.encode_argb(*to_argb(payload[i : i + PIECE], each), **wanted) for i in range(0, len(payload), PIECE))


def files_of(media: bytes) -> Iterator[bytes]:
    """The WebP files that follow one another."""
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + size]
        at += size


def from_media(media: bytes, size: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The payload of ``size`` bytes, and its images' widths and heights."""
    parts, shapes = [], []
    for k, one in enumerate(files_of(media)):
        argb, width, height = vp8l.decode_argb(one)
        own = min(PIECE, size - k * PIECE)
        green = (argb >> 8).astype(np.uint8)
        if width * height >= own:
            parts.append(green[:own])
        else:  # two bytes to a pixel: what a last row lacks is never half of all
            parts.append(np.stack([green, argb.astype(np.uint8)], 1).reshape(-1)[:own])
        shapes.append((width, height))
    return np.concatenate(parts), shapes


def _binary_batch(b: pa.RecordBatch, columns: list[tuple[str, pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("_row"), *(pa.array(v, t) for _, t, v in columns)], ["_row", *(n for n, _, _ in columns)])


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less its text, with n_bytes, payload_bytes and media (lossless WebP files)."""
    C.small_batches(docs.sparkSession, 256)
    own = ["n_bytes", "payload_bytes", "media"]
    body = C.set_aside(docs, F.col(text).alias("text"), without=text)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, whole, media = [], [], []
            for t in b.column("text"):
                raw = (t.as_py() or "").encode()
                payload = padded(raw)
                size.append(len(raw))
                whole.append(len(payload))
                media.append(to_media(payload))
            yield _binary_batch(b, list(zip(own, (pa.int64(), pa.int64(), pa.binary()), (size, whole, media), strict=True)))

    kinds = (T.LongType(), T.LongType(), T.BinaryType())
    out = T.StructType([body.schema["_row"], *(T.StructField(c, k) for c, k in zip(own, kinds, strict=True))])
    return C.put_back(body.mapInArrow(C.tidy(write), out), own)


def pixels(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with width, height, pixels (RGBA bytes, row by row) and error, of the first file in ``column``."""
    C.small_batches(media.sparkSession, 256)
    own = ["width", "height", "pixels", "error"]
    body = C.set_aside(media, F.col(column).alias("media"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column("media"):
                try:
                    img = vp8l.decode(m.as_py())
                    rows.append((img.shape[1], img.shape[0], img.tobytes(), None))
                except (ValueError, TypeError, IndexError) as e:
                    rows.append((None, None, None, str(e) or "broken image"))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield _binary_batch(b, [(c, t, [r[k] for r in rows]) for k, (c, t) in enumerate(zip(own, kinds, strict=True))])

    kinds = (T.IntegerType(), T.IntegerType(), T.BinaryType(), T.StringType())
    out = T.StructType([body.schema["_row"], *(T.StructField(c, k) for c, k in zip(own, kinds, strict=True))])
    return C.put_back(body.mapInArrow(C.tidy(read), out), own)


def features(media: DataFrame) -> DataFrame:
    """Rows of ``store`` less the files, with what their decoded payload and the files themselves amount to."""
    C.small_batches(media.sparkSession, 256)
    own = ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    body = C.set_aside(media, F.col("media"), F.col("payload_bytes"), without="media")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m, n in zip(b.column("media"), b.column("payload_bytes").to_pylist(), strict=True):
                raw = m.as_py()
                flat, shapes = from_media(raw, n)
                step = np.abs(np.diff(flat.astype(np.int16))).sum(dtype=np.int64)
                shape = "+".join(f"{w}x{h}" for w, h in shapes)
                text = f"{shape} sum={flat.sum(dtype=np.int64)} kinds={np.count_nonzero(np.bincount(flat, minlength=256))} steps={step}"
                payload = flat.tobytes()
                rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), text))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield _binary_batch(b, [(c, t, [r[k] for r in rows]) for k, (c, t) in enumerate(zip(own, kinds, strict=True))])

    kinds = (T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    out = T.StructType([body.schema["_row"], *(T.StructField(c, k) for c, k in zip(own, kinds, strict=True))])
    return C.put_back(body.mapInArrow(C.tidy(read), out), own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return features(store(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("feature"))
