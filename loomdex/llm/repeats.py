"""Finding every window of a corpus that occurs more than once, exactly.

Shared by the substring and the suffix-array operator, which differ in the unit
(words or bytes) and in how a block of contexts is solved.

1. *Anchors.*  Within every window of W units the k-gram of least hash is its
   anchor; consecutive windows with the same anchor form a run, whose windows and
   their tails are its context.  Equal windows have equal anchors at equal offsets,
   so a window can only repeat if its anchor's k-gram repeats.  About 2 / (W - k) of
   all positions are anchors.
2. *Pruning.*  k-grams are counted with map-side combining; a run whose k-gram occurs
   once has only leaves of the suffix tree above depth W and is dropped.
3. *Blocks.*  Equal contexts of a k-gram are counted and travel once, with their
   number.  They go to the partition of their k-gram, are streamed in k-gram order and
   solved in blocks of bounded size.  The solver alone says which windows repeat: those
   of different contexts, and, by its leaves' numbers, those of equal ones.
4. *Hot k-grams* (more than ``HOT`` different contexts) have their prefix lengthened to
   the whole window at once: every group is then one node at depth W, and its leaves are
   counted with map-side combining (128-bit keys), so no task holds a k-gram's group.

Joins by k-gram have unique rows on one side, so a hot key's rows on the other side are
split over tasks (skew joins of adaptive execution); all groupings combine before the shuffle.

The result has a row per document with a repeated window: ``_k1`` and ``_spans``,
an array of (tag, s, e): units [s, e) are covered by repeated windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm import common as C

#: Different contexts of one k-gram above which it is matched window by window.
HOT = 20_000
#: Bytes of context solved at once.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_POS_BITS = 28
_LOW = _U((1 << _POS_BITS) - 1)
#: Positions handled at once within one text; more are cut into overlapping pieces.
_PIECE = 1 << 21
#: Bits of _k2 that go along with _k1.
TAG = (1 << 24) - 1
_PLACE = (1 << 31) - 1
#: Keys of rows just handled that a task remembers.
_NEAR = 4_096

#: (symbols, first symbol of each context, one past its last symbol, window, number of each context) -> repeated window starts
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray], np.ndarray]


def runs_of(symbols: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor runs in a chunk of rows: row, first and last window start in the row, hashes of k-gram and context.

    ``first``: index of each row's first symbol, and the total at the end.
    """
    n = len(symbols)
    empty = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, _U), np.zeros(0, _U))
    if n < window:
        return empty
    sums = C.prefix_sums(symbols)
    at = np.arange(n - gram + 1)
    hashes = C.range_hash(sums, at, at + gram)
    least = C.slicing_min((hashes & ~_LOW) | at.astype(_U), window - gram + 1)
    lengths = np.diff(first)
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths - window + 1, 0))
    if not len(row):
        return empty
    count = np.maximum(lengths - window + 1, 0)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    anchor = (least[start] & _LOW).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1
    r = row[head]
    return r, start[head] - first[r], start[tail] - first[r], hashes[anchor[head]], C.range_hash(sums, start[head], start[tail] + window)


def _symbols(data: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a chunk of rows and each row's first one."""
    if unit == "byte":
        return C.byte_codes(data), off
    ws, we, first = C.find_words(data, off)
    return C.word_hashes(data, ws, we), first


def _scan(batch: pa.RecordBatch, unit: str, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(kfp, c, _k1, at) of all runs; at: 24 bits of _k2, 31 of the first window's place, 9 of the count less one."""
    data, off = C.text_buffers(batch.column("text"))
    k1, tag = np.asarray(batch.column("_k1")), np.asarray(batch.column("_k2")) & TAG
    for i, j in C.chunks(off):
        symbols, first = _symbols(data[off[i] : off[j]], off[i : j + 1] - off[i], unit)
        # windows of a long text are enumerated piece by piece
        alone = j == i + 1
        for p in range(0, max(1, len(symbols)) if alone else 1, _PIECE):
            q = min(len(symbols), p + _PIECE + window - 1)
            if alone:
                r, a, b, h, c = runs_of(symbols[p:q], np.array([0, q - p]), window, gram)
            else:
                r, a, b, h, c = runs_of(symbols, first, window, gram)
            if len(r):
                at = tag[i + r] << 40 | (a + p * alone) << 9 | (b - a)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(h)), pa.array(C.signed(c)), pa.array(k1[i + r]), pa.array(at)], ["kfp", "c", "_k1", "at"])


_CONTEXT = "kfp long, c long, _k1 long, tag long, i0 long, n long, sub long, ctx binary"


def _cut(batch: pa.RecordBatch, unit: str, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of _CONTEXT for the runs listed with each text."""
    data, off = C.text_buffers(batch.column("text"))
    k1, tag = np.asarray(batch.column("_k1")), np.asarray(batch.column("_k2")) & TAG
    for row in range(batch.num_rows):
        part = data[off[row] : off[row + 1]]
        ws, we, _ = C.find_words(part, np.array([0, len(part)])) if unit == "word" else (None, None, None)
        own = [x for x in batch.column("runs")[row].as_py() if (x["at"] >> 40 & TAG) == tag[row]]
        ctx = []
        for x in own:
            a = x["at"] >> 9 & _PLACE
            e = a + (x["at"] & 511) + window
            ctx.append(part[ws[a] : we[e - 1]].tobytes() if unit == "word" else part[a:e].tobytes())
        if own:
            m = len(own)
            get = lambda name: pa.array([x[name] for x in own], pa.int64())  # noqa: B023, E731
            same = lambda value: pa.array([int(value)] * m, pa.int64())  # noqa: B023, E731
            cols = [get("kfp"), get("c"), same(k1[row]), same(tag[row]), pa.array([x["at"] >> 9 & _PLACE for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, get("n"), get("sub"), pa.array(ctx, pa.binary())], ["kfp", "c", "_k1", "tag", "i0", "n", "sub", "ctx"])


def _context_symbols(column: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    data, off = C.text_buffers(column)
    if unit == "byte":
        return data, off
    ws, we, first = C.find_words(data, off)
    return C.word_hashes(data, ws, we), first


_FOUND = "kfp long, c long, n long, _k1 long, tag long, s long, e long"


def _spans(rows: pa.Table, first: np.ndarray, hit: np.ndarray, window: int) -> pa.RecordBatch:
    """Merge repeated window starts (indices into symbols, ascending) into spans of their contexts: rows of _FOUND."""
    row = np.searchsorted(first, hit, "right") - 1
    new = np.ones(len(hit), bool)
    new[1:] = (row[1:] != row[:-1]) | (hit[1:] > hit[:-1] + window)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(hit)) - 1
    r = row[head]
    i0 = rows.column("i0").to_numpy()[r]
    s, e = hit[head] - first[r] + i0, hit[tail] - first[r] + i0 + window
    names = ["kfp", "c", "n", "_k1", "tag"]
    own = [pa.array(rows.column(c).to_numpy()[r]) for c in names]
    return pa.RecordBatch.from_arrays([*own, pa.array(s.astype(np.int64)), pa.array(e.astype(np.int64))], [*names, "s", "e"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Whole k-gram groups, in blocks of about ``size`` bytes (input sorted by kfp)."""
    held: list[pa.RecordBatch] = []
    nbytes = 0
    for b in batches:
        while b.num_rows:
            if nbytes >= size:  # cut where the k-gram changes
                kfp = np.asarray(b.column("kfp"))
                cut = int(np.searchsorted(kfp != held[-1].column("kfp")[-1].as_py(), True))
                if cut:
                    held.append(b.slice(0, cut))
                if cut < b.num_rows:
                    yield pa.Table.from_batches(held)
                    held, nbytes = [], 0
                    b = b.slice(cut)
                else:
                    break
            take = b.num_rows
            _, off = C.text_buffers(b.column("ctx"))
            take = max(1, int(np.searchsorted(off, size - nbytes, "right")) - 1)
            take = min(take, b.num_rows)
            held.append(b.slice(0, take))
            nbytes += int(off[take]) + 64 * take
            b = b.slice(take)
    if held:
        yield pa.Table.from_batches(held)


def repeated_spans(docs: DataFrame, text: str, ident: str, unit: str, window: int, gram: int, solve: Solver, hot: int = HOT) -> DataFrame:
    """See the module's text.  ``docs`` must already carry _k1 and _k2 (common.with_key)."""
    if window - gram > 511:
        raise ValueError("a run may hold 512 windows: raise gram")
    C.small_batches(docs.sparkSession)
    slim = docs.select("_k1", "_k2", F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _scan(b, unit, window, gram)

    runs = slim.mapInArrow(C.tidy(scan), "kfp long, c long, _k1 long, at long")
    seen = runs.groupBy("kfp").agg(F.count("*").alias("m")).filter("m > 1").select("kfp")
    kept = C.stored(runs.join(seen, "kfp"))
    contexts = C.stored(kept.groupBy("kfp", "c").agg(F.count("*").alias("n"), F.first("_k1").alias("_k1"), F.first("at").alias("at")))

    # one run stands for each context; the texts are joined once per document
    sub = contexts.groupBy("kfp").agg(F.count("*").alias("sub"))
    run = F.struct("kfp", "c", "at", "n", "sub")
    chosen = contexts.join(sub, "kfp").groupBy("_k1").agg(F.collect_list(run).alias("runs"))  # no more than a text has

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: set[tuple[int, int]] = set()
        for b in batches:
            # of repeated rows each would give the same contexts: one is enough (and a few more do no harm)
            keys = list(zip(b.column("_k1").to_pylist(), b.column("_k2").to_pylist(), strict=True))
            new = [k not in recent and k not in keys[:i][-_NEAR:] for i, k in enumerate(keys)]
            recent = set() if len(recent) > _NEAR else recent
            recent.update(keys)
            yield from _cut(b.filter(pa.array(new)) if not all(new) else b, unit, window)

    texts = docs.join(chosen, "_k1").select("_k1", "_k2", F.col(text).alias("text"), "runs")
    texts = C.stored(texts.mapInArrow(C.tidy(cut), _CONTEXT))

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK_BYTES):
            symbols, first = _context_symbols(block.column("ctx"), unit)
            hit = solve(symbols, first[:-1], first[1:], window, block.column("n").to_numpy())
            if len(hit):
                yield _spans(block, first, hit, window)

    cold = texts.filter(F.col("sub") <= hot).repartition(F.col("kfp")).sortWithinPartitions("kfp")
    found = cold.mapInArrow(C.tidy(light), _FOUND)
    if not sub.filter(F.col("sub") > hot).isEmpty():
        found = found.unionByName(_hot_spans(texts.filter(F.col("sub") > hot), unit, window))
    found = C.stored(found)
    # a context that occurs once is the representative's own; one that occurs more often repeats as a whole
    single = found.filter("n = 1").select("_k1", "tag", "s", "e")
    place = F.shiftright("at", 9).bitwiseAND(_PLACE)
    tag, end = F.shiftrightunsigned("at", 40).alias("tag"), (place + F.col("at").bitwiseAND(511) + window).alias("e")
    equal = kept.join(found.filter("n > 1").select("kfp", "c").distinct(), ["kfp", "c"], "left_semi")
    spans = single.unionByName(equal.select("_k1", tag, place.alias("s"), end))
    # distinct first: a row that is repeated a million times has its spans as often
    return spans.distinct().groupBy("_k1").agg(F.collect_list(F.struct("tag", "s", "e")).alias("_spans"))


def _hot_spans(contexts: DataFrame, unit: str, window: int) -> DataFrame:
    """Rows of _FOUND for windows of hot k-grams, each a node at full depth: no task holds a k-gram's group."""
    names = ["kfp", "c", "n", "_k1", "tag"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, size = C.text_buffers(b.column("ctx"))
            for i, j in C.chunks(size, 1 << 18):
                part = b.slice(i, j - i)
                symbols, first = _context_symbols(part.column("ctx"), unit)
                if unit == "byte":
                    symbols = C.byte_codes(symbols)
                count = np.maximum(np.diff(first) - window + 1, 0)
                row = np.repeat(np.arange(len(count)), count)
                start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
                one = C.range_hash(C.prefix_sums(symbols), start, start + window)
                two = C.range_hash(C.prefix_sums(C.mix(symbols)), start, start + window)
                own = [pa.array(np.asarray(part.column(c))[row]) for c in names]
                at = np.asarray(part.column("i0"))[row] + start - first[row]
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(one)), pa.array(C.signed(two)), *own, pa.array(at)], ["h1", "h2", *names, "s"])

    w = contexts.mapInArrow(C.tidy(windows), "h1 long, h2 long, kfp long, c long, n long, _k1 long, tag long, s long")
    leaves = w.groupBy("h1", "h2").agg(F.sum("n").alias("leaves")).filter("leaves > 1").drop("leaves")
    return w.join(leaves, ["h1", "h2"], "left_semi").select(*names, "s", (F.col("s") + window).alias("e"))


def covered(spans: list | None, k2: int) -> list[tuple[int, int]]:
    """The disjoint, ascending ranges that a row's spans cover (touching ones merged)."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or () if x["tag"] == k2 & TAG):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
