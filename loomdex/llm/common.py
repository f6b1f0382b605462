"""What several corpus operators share: word scanning, hashing and shared storage.

Texts are handled as the raw UTF-8 bytes of Arrow string buffers, so no Python
string is made per row.  A word is a maximal run of bytes other than 0x20 and
0x09-0x0D, which is what ``[^\\x20\\x09-\\x0D]+`` finds in the text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.sources.store import shared_folder, stored  # noqa: F401  (the operators take them from here)

WORD = "[^\\x20\\x09-\\x0D]+"
#: Texts are scanned in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: A key is hot if more rows than this have it, and more than a HOT_SHARE-th of all.
HOT_ROWS, HOT_SHARE = 10_000, 1_000

_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            x = np.full(n, b, _U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    out = _powers[0][:n], _powers[1][:n]
    if n > 4 * CHUNK_BYTES:  # a giant text must not pin its tables in the worker
        _powers[:] = [np.ones(1, _U), np.ones(1, _U)]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection under which any input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * base**position, from which any range's hash follows."""
    out = np.zeros(len(symbols) + 1, _U)
    np.cumsum(symbols * powers(max(1, len(symbols)))[0][: len(symbols)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for arrays of starts and ends, independent of where they lie."""
    inv = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inv[start])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes (a longer row alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def find_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_SEP[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < len(data))]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def byte_codes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    return _BYTE_CODE[_LOWER[data]] if lower else _BYTE_CODE[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word; ``lower`` folds A-Z first."""
    if not len(starts):
        return np.zeros(0, _U)
    return range_hash(prefix_sums(byte_codes(data, lower)), starts, ends) + _U(2) * (ends - starts).astype(_U)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slicing_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, cur = 1, x
    while have * 2 <= width:
        cur = np.minimum(cur[: len(cur) - have], cur[have:])
        have *= 2
    return np.minimum(cur[:n], cur[width - have : width - have + n]) if have < width else cur[:n]


def small_batches(spark: SparkSession, rows: int = 512, size: str = "4m") -> None:
    """Hand Python workers short Arrow batches: texts are long, and a worker holds a few copies of a batch."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        spark.conf.set(key, str(most))


def set_aside(docs: DataFrame, *columns: Column, without: str | None = None) -> DataFrame:
    """``columns`` beside the row (``without`` one column) as a struct, so that no caller's name can clash with an operator's."""
    names = [c for c in docs.columns if c != without] or docs.columns[:1]
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), *columns)


def put_back(out: DataFrame, own: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``_row`` (some of them ``changed``), then an operator's own.

    Where names are alike, the operator's column takes the place of the caller's.
    """
    taken, changed = {c.lower() for c in own}, changed or {}
    names = [c for c in out.schema["_row"].dataType.names if c.lower() not in taken]
    return out.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in names], *own)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow that hands freed memory back to the system at its end.

    Workers wait for further tasks, and what their allocators keep counts against the
    executor while stages without Python run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _powers[:] = [np.ones(1, _U), np.ones(1, _U)]
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # a system with another allocator
                pass

    return run


def with_key(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """Add _k1 and _k2, two hashes of id and text, by which later stages find the row again.

    Joins go by _k1; _k2 (with the length) tells rows apart that collide in it.
    Repeated rows share both and are treated alike.
    """
    return docs.withColumns({"_k1": F.xxhash64(F.col(ident), F.col(text)), "_k2": F.xxhash64(F.lit(7), F.col(text), F.col(ident))})


def spread_join(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """``left`` with the columns of ``right`` (null where it has none), ``right`` having a key once and in ``size`` its rows in ``left``.

    Keys with more than a ``HOT_SHARE``-th of all these rows (so there are at most as many of
    them) are sent to every task, and their rows, like those of a null key, are spread over all,
    by their place: ``left`` must come from a table as it is read, so that a repeated task sees
    its rows in the same order.
    """
    values = [c for c in right.columns if c not in (key, size)]
    total = right.agg(F.sum(size)).first()[0] or 0
    line = max(HOT_ROWS, total // HOT_SHARE)
    hot = right.filter(F.col(size) > line)
    pack = F.struct(*values)
    out = left.withColumn("_hot", F.lit(None).cast(right.select(pack.alias("v")).schema["v"].dataType))
    if not hot.isEmpty():
        out = left.join(F.broadcast(hot.select(key, pack.alias("_hot"))), key, "left")
    apart = F.col(key).isNull() | F.col("_hot").isNotNull()
    out = out.withColumns({"_key": F.when(~apart, F.col(key)), "_salt": F.when(apart, F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(F.lit(0))})
    cold = right.filter(F.col(size) <= line).select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_salt"), pack.alias("_cold"))
    out = out.join(cold, ["_key", "_salt"], "left")
    return out.select(*left.columns, *[F.coalesce(F.col("_hot").getField(v), F.col("_cold").getField(v)).alias(v) for v in values])
