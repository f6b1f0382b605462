"""Substring dedup over bytes by blockwise suffix sorting with a difference cover.

A block of contexts (see ``repeats.py``) gets the suffix array of its windows: all
places from which ``window`` bytes lie in one context, in the order of these bytes.
It is built one bucket at a time.  First a sample is ranked: the positions whose
remainder modulo ``PERIOD`` lies in a difference cover, a fifth of all, by their first 32
bytes and then by doubling.  Suffixes are split into buckets by their first bytes; a
bucket is sorted by up to 32 bytes, and ties, which may be hundreds of bytes long, are
resolved by the sample: for any two suffixes some shift below ``PERIOD`` brings both
onto it, so each comparison is one or two look-ups of ranks (and the last bytes of the
window).  Ties of a bucket are sorted by three-way partitioning around a pivot for every
group at once.  Memory beyond the block's own is that of one bucket, whatever the depth.
Neighbours in the array that agree in the whole window are repeats.

Cases: a null text counts as empty; texts shorter than ``window`` are left alone;
matches never cross documents; overlapping occurrences count; repeated rows are
occurrences of each other; an empty table gives an empty one; other columns stay, but
those that have the name of a result give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm import common as C
from loomdex.llm import repeats as R

WINDOW = 400
GRAM = 32
#: A perfect difference set: every remainder modulo PERIOD is a difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Suffixes sorted at a time.
BUCKET = 1 << 16
#: Different contexts of one k-gram that are sorted together (they are longer than the words').
HOT = 8_000

_IN = np.zeros(PERIOD, bool)
_IN[list(COVER)] = True
#: SHIFT[a, b]: the least d for which positions with remainders a and b, moved by d, are both in the sample.
SHIFT = np.array([[next(d for d in range(PERIOD) if _IN[(a + d) % PERIOD] and _IN[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At every position its next eight bytes as a number, so that numbers are ordered as the bytes (zeros after the end)."""
    n = len(data)
    wide = np.zeros(n + 16, np.uint8)
    wide[:n] = data
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        part = out[r::8]
        part[:] = wide[r : r + 8 * len(part)].view(">u8")
    return out


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples in their order, the first key being the major one."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def reach(window: int) -> int:
    """Depth of the sample's ranks: the most that fits into a window after any shift (0 if it is too short for ranks)."""
    return 32 + (window - PERIOD + 1 - 32) // PERIOD * PERIOD if window >= 32 + PERIOD - 1 else 0


def sample_ranks(eight: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the sample's suffixes by their first ``depth`` bytes: a table from position to rank's index, and the ranks.

    By 32 bytes at first, then by doubling with moves that keep to the sample.
    """
    n = len(eight)
    pos = np.flatnonzero(_IN[np.arange(n) % PERIOD])
    index = np.full(n + 1, -1, np.int32)
    index[pos] = np.arange(len(pos))
    at = lambda k: np.where(pos + k < n, eight[np.minimum(pos + k, n - 1)], np.uint64(0))
    rank = _ranked(*(at(k) for k in (0, 8, 16, 24)))
    have = 32
    while have < depth:
        move = min(have, depth - have) // PERIOD * PERIOD
        nxt = index[np.minimum(pos + move, n)]
        second = np.where(nxt >= 0, rank[np.maximum(nxt, 0)], -1)  # beyond the block's end comes first
        both = rank * (len(pos) + 1) + second + 1
        rank = np.unique(both, return_inverse=True)[1]
        have += move
    return index, rank


class _Order:
    """Comparison of windows that agree in their first 32 bytes."""

    def __init__(self, eight: np.ndarray, window: int) -> None:
        self.eight, self.window, self.depth = eight, window, reach(window)
        self.index, self.rank = sample_ranks(eight, self.depth) if self.depth else (None, None)

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of positions."""
        if not self.depth:  # a short window: its bytes themselves
            return self._bytes(i, j, 32)
        d = SHIFT[i % PERIOD, j % PERIOD]
        out = self._ranks(i + d, j + d)
        open_ = np.flatnonzero(out == 0)
        known = d + self.depth
        while len(open_):  # further ranks, a period on, as long as they lie in the window
            known[open_] += PERIOD
            fits = (known[open_] <= self.window) & (known[open_] - PERIOD < self.window - 32)
            open_ = open_[fits]
            if not len(open_):
                break
            move = known[open_] - self.depth
            out[open_] = self._ranks(i[open_] + move, j[open_] + move)
            open_ = open_[out[open_] == 0]
        equal = np.flatnonzero(out == 0)
        if len(equal):
            out[equal] = self._bytes(i[equal], j[equal], self.window - 32)
        return out

    def _ranks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.sign(self.rank[self.index[i]] - self.rank[self.index[j]])

    def _bytes(self, i: np.ndarray, j: np.ndarray, begin: int) -> np.ndarray:
        """By the bytes from ``begin`` to the window's end."""
        out = np.zeros(len(i), np.int64)
        n = len(self.eight) - 1
        for k in range(begin, self.window, 8):
            cut = np.uint64(8 * max(0, k + 8 - self.window))
            x, y = (self.eight[np.minimum(p + k, n)] >> cut for p in (i, j))
            out = np.where(out != 0, out, (x > y).astype(np.int64) - (x < y))
        return out


def _sorted_ties(pos: np.ndarray, group: np.ndarray, order: _Order) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each group (consecutive rows) in the order of their windows, and which equal the one before."""
    pos, same = pos.copy(), np.zeros(len(pos), bool)
    slot = np.arange(len(pos))
    while len(slot):
        now = pos[slot]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(head, len(slot)))
        pivot = now[np.repeat(head + size // 2, size)]
        side = order.compare(now, pivot)
        moved = np.argsort(group * 3 + side + 1, kind="stable")
        pos[slot] = now[moved]
        part = (group * 3 + side + 1)[moved]
        first = np.concatenate(([True], part[1:] != part[:-1]))
        settled = part % 3 == 1  # those that equal the pivot
        same[slot] = settled & ~first
        one = first & np.concatenate((first[1:], [True]))
        left = ~settled & ~one
        slot, group = slot[left], np.cumsum(first)[left]
    return pos, same


def suffix_array(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the ``window`` bytes from them, and whether each one's window equals that before it.

    Every window must lie in ``data``.
    """
    eight = eight_bytes(data)
    order = _Order(eight, window)
    sizes = np.bincount(data[starts].astype(np.int64) << 8 | data[starts + 1], minlength=1 << 16)
    lead = data[starts].astype(np.int64) << 8 | data[starts + 1]
    # buckets: ranges of first bytes with at most BUCKET suffixes, if one pair of bytes hasn't more
    total = np.cumsum(sizes)
    arrays, flags, a = [], [], 0
    while a < 1 << 16:
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + BUCKET, "right")))
        if total[b - 1] > before:
            own = starts[(lead >= a) & (lead < b)] if total[b - 1] - before < len(starts) else starts
            sa, same = _bucket(own, order)
            arrays.append(sa)
            flags.append(same)
        a = b
    return np.concatenate(arrays), np.concatenate(flags)


def _bucket(pos: np.ndarray, order: _Order) -> tuple[np.ndarray, np.ndarray]:
    """One bucket's suffixes in order: by up to 32 bytes, eight at a time, then by the sample."""
    eight, window = order.eight, order.window
    pos = pos[np.argsort(_clipped(eight[pos], window, 0), kind="stable")]
    new = np.ones(len(pos), bool)
    key = _clipped(eight[pos], window, 0)
    new[1:] = key[1:] != key[:-1]
    for k in range(8, min(32, window), 8):
        tied = _tied(new)
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        key = _clipped(eight[pos[tied] + k], window, k)
        o = np.lexsort((key, group))
        pos[tied], key = pos[tied][o], key[o]
        new[tied[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    same = np.zeros(len(pos), bool)
    tied = _tied(new)
    if len(tied):
        if window <= 32:
            same = ~new
        else:
            pos[tied], same[tied] = _sorted_ties(pos[tied], np.cumsum(new)[tied], order)
    return pos, same


def _clipped(key: np.ndarray, window: int, at: int) -> np.ndarray:
    """Keys of the bytes from ``at`` on, less what lies beyond the window."""
    return key >> np.uint64(8 * max(0, at + 8 - window))


def _tied(new: np.ndarray) -> np.ndarray:
    """Rows that don't stand alone between two beginnings."""
    return np.flatnonzero(~(new & np.append(new[1:], True)))


def tied_windows(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, number: np.ndarray | None = None) -> np.ndarray:
    """Repeated window starts of a block of contexts, ascending (a ``repeats.Solver``)."""
    count = np.maximum(last - first - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    starts = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    if not len(starts):
        return starts
    sa, same = suffix_array(symbols, starts, window)
    hit = np.zeros(len(symbols), bool)
    hit[sa[same]] = True
    hit[sa[:-1][same[1:]]] = True
    if number is not None:  # an entry that stands for several equal suffixes
        hit[starts[number[row] > 1]] = True
    return np.flatnonzero(hit)


def repeated_byte_spans(docs: DataFrame, text: str = "text", ident: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(_k1, _spans) of rows with a repeated window; spans are byte ranges, ends excluded."""
    return R.repeated_spans(C.with_key(docs.select(ident, text), text, ident), text, ident, "byte", window, gram, tied_windows, hot)


def dedup_bytes(docs: DataFrame, text: str = "text", ident: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """All rows and columns, with ``text`` less its repeated bytes.

    A cut may split a UTF-8 sequence; such bytes become U+FFFD in ``text``, while
    kept_sha256 is of the exact bytes.  Adds n_bytes, n_removed, n_spans, kept_sha256.
    """
    body = C.with_key(C.set_aside(docs, F.col(text).alias("text"), F.col(ident).alias("id")), "text", "id")
    spans = R.repeated_spans(body, "text", "id", "byte", window, gram, tied_windows, hot)
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType()]
    out = T.StructType([body.schema["_row"], body.schema["text"], *(T.StructField(c, k) for c, k in zip(own, kinds, strict=True))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = [], []
            for t, spans, k2 in zip(b.column("text"), b.column("_spans"), b.column("_k2"), strict=True):
                raw = t.as_py()
                data = raw.encode() if raw is not None else b""
                ranges = R.covered(spans.as_py(), k2.as_py())
                if ranges:
                    ends = [0] + [e for _, e in ranges]
                    kept = b"".join(data[p:s] for p, s in zip(ends, [s for s, _ in ranges] + [len(data)], strict=True))
                else:
                    kept = data
                texts.append(kept.decode("utf-8", "replace") if ranges else raw)
                rows.append((len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            cols = [b.column("_row"), pa.array(texts, b.schema.field("text").type)]
            cols += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["_row", "text", *own])

    joined = body.join(spans, "_k1", "left").select("_row", "text", "_k2", "_spans")
    return C.put_back(joined.mapInArrow(C.tidy(cut), out).withColumnRenamed("text", "_text"), own, {text: F.col("_text")})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same by plain comparison of all windows, for tables of a size that bears it.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT rid, doc_id, h, length(h) // 2 AS n FROM d),
k AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT rid, h, unnest(range(0, n - 399)) AS i FROM n WHERE n >= 400)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1),
b AS (SELECT rid, i, sum(CASE WHEN i - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM r)),
s AS (SELECT rid, min(i) AS s, max(i) + 400 AS e FROM b GROUP BY rid, run),
p AS (SELECT rid, s, e, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY s) AS before FROM s),
q AS (SELECT rid, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept, count(*) AS spans FROM p JOIN n USING (rid) GROUP BY rid)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, (n.n - length(coalesce(q.kept, n.h)) // 2)::BIGINT AS n_removed, coalesce(q.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(q.kept, n.h))) AS kept_sha256
FROM n LEFT JOIN q ON n.rid = q.rid
"""
