"""Substring dedup over words by prefix-partitioned suffix trees.

Suffixes (at word positions) are split by prefixes of variable length into groups
that fit in memory, and a tree is built for each group, top down: an open node is a set
of suffixes that agree to some depth; its children are told apart by the next few words
(packed into one sort key, so siblings come in order and the depth at which neighbours
part is exact).  A suffix that is alone is a leaf, and the depth at which it parted from
its nearest neighbour is its parent's, the deepest internal node above it.  Internal
nodes of depth ``window`` and more are repeats; an occurrence of one that the occurrence
a word before doesn't reach past is a maximal repeat.  Equal contexts are one suffix
with several leaves.

Which suffixes can reach that depth at all is found beforehand (``repeats.py``),
so only text near a repeat is moved between machines.

Cases: a null text counts as empty; a text of fewer than ``window`` words is left
as it is; repeated rows are occurrences of each other's windows; windows that
overlap themselves count; an empty table gives an empty one; columns other than
text are kept untouched, but those that have the name of a result give way to it.
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

WINDOW = 35
GRAM = 6
#: Suffixes whose subtrees are built together; prefixes are lengthened until a group fits.
GROUP = 1 << 16
#: Words by which a prefix that is too common is lengthened.
STEP = 7

_OWN = ["n_words", "n_removed", "kept_sha256", "removed_spans"]


def subtree(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Depth of the deepest internal node above each of ``starts`` (0 for the root), among these suffixes.

    ``ids``: words as numbers from 1 with zeros after the last one; all ``starts`` agree to ``depth``.
    """
    parent = np.zeros(len(starts), np.int64)
    step = 63 // bits
    suffix, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)  # open suffixes in order, and their node
    while len(suffix) > 1:
        at, left = starts[suffix] + depth, ends[suffix] - starts[suffix] - depth
        key = np.zeros(len(suffix), np.int64)
        for k in range(step):  # a suffix is over where its context is
            key = key << bits | np.where(left > k, ids[at + k], 0)
        order = np.lexsort((key, node))
        suffix, node, key, left = suffix[order], node[order], key[order], left[order]
        # how many words neighbours in one node share beyond its depth
        differ = key[1:] ^ key[:-1]
        width = np.frexp(differ.astype(np.float64))[1]  # rounding up to the next power of two needs 2**53, more than a word's bits
        width = np.where(differ >> np.minimum(np.maximum(width - 1, 0), 62) == 0, width - 1, width)
        shared = np.where(differ == 0, step, step - -(-width // bits))
        shared = np.minimum(shared, np.minimum(left[1:], left[:-1]))
        together = node[1:] == node[:-1]
        shared = np.where(together, depth + np.maximum(shared, 0), 0)
        near = np.zeros(len(suffix), np.int64)
        near[1:] = shared
        near[:-1] = np.maximum(near[:-1], shared)
        parent[suffix] = np.maximum(parent[suffix], near)
        # children with two suffixes or more that go on are opened
        same = together & (differ == 0)
        more = np.zeros(len(suffix), bool)
        more[1:] = same
        more[:-1] |= same
        more &= left > step
        child = np.cumsum(np.concatenate(([True], ~same))) - 1
        suffix, node, depth = suffix[more], child[more], depth + step
    return parent


def parent_depths(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of at least ``window`` words, ascending, and the depth of the deepest internal node above each."""
    count = np.maximum(last - first - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    starts = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    ends = last[row]
    depth = np.zeros(len(starts), np.int64)
    if not len(starts):
        return starts, depth
    word, ids = np.unique(symbols, return_inverse=True)
    ids = np.append(ids.astype(np.int64) + 1, np.zeros(64, np.int64))
    bits = int(len(word) + 1).bit_length()
    sums = C.prefix_sums(symbols)
    todo = [(np.arange(len(starts)), 0)]
    while todo:
        group, agreed = todo.pop()
        if len(group) <= GROUP or agreed >= window:
            found = subtree(ids, starts[group], ends[group], min(agreed, window), bits)
            depth[group] = np.maximum(depth[group], found)
            continue
        # too many suffixes for one tree: lengthen the prefix and build a tree for every group that it makes
        to = min(agreed + STEP, window)
        key = C.range_hash(sums, starts[group], starts[group] + to)
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            if b - a > 1:  # alone with its prefix it is a leaf above the window's depth
                todo.append((group[order[a:b]], to))
    return starts, depth


def maximal_repeats(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of every occurrence of a maximal repeat of at least ``window`` words, by start.

    ``number``: how many leaves each context's suffixes have (1 if not given).
    """
    starts, depth = parent_depths(symbols, first, last, window)
    if number is not None:  # a suffix with several leaves is itself an internal node
        row = np.searchsorted(first, starts, "right") - 1
        depth = np.where(number[row] > 1, last[row] - starts, depth)
    # the tail of a repeat that starts a word before isn't maximal
    tail = np.zeros(len(starts), bool)
    tail[1:] = (starts[1:] == starts[:-1] + 1) & (depth[:-1] == depth[1:] + 1)
    keep = (depth >= window) & ~tail
    return starts[keep], depth[keep]


def deep_nodes(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, number: np.ndarray | None = None) -> np.ndarray:
    """Window starts of a block of contexts that lie in maximal repeats, ascending (a ``repeats.Solver``)."""
    starts, length = maximal_repeats(symbols, first, last, window, number)
    inside = length - window + 1
    begin = np.repeat(np.cumsum(inside) - inside, inside)
    return np.unique(np.arange(len(begin)) - begin + np.repeat(starts, inside))


def repeated_word_spans(docs: DataFrame, text: str = "text", ident: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = R.HOT) -> DataFrame:
    """(_k1, _spans) of rows with a repeated window; spans count words from 0, ends excluded."""
    return R.repeated_spans(C.with_key(docs.select(ident, text), text, ident), text, ident, "word", window, gram, deep_nodes, hot)


def dedup_substrings(docs: DataFrame, text: str = "text", ident: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = R.HOT) -> DataFrame:
    """All rows and columns, with words in repeated windows removed from ``text``.

    A text from which nothing is removed stays byte for byte; the kept words of
    others are joined by single spaces.  Adds n_words, n_removed, kept_sha256 and
    removed_spans (word ranges).
    """
    body = C.with_key(C.set_aside(docs, F.col(text).alias("text"), F.col(ident).alias("id")), "text", "id")
    spans = R.repeated_spans(body, "text", "id", "word", window, gram, deep_nodes, hot)
    joined = body.join(spans, "_k1", "left").select("_row", "text", "_k2", "_spans")
    span = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.ArrayType(span)]
    out = T.StructType([body.schema["_row"], body.schema["text"], *(T.StructField(c, k) for c, k in zip(_OWN, kinds, strict=True))])
    pairs = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, gone, sha, where = [], [], [], [], []
            for t, spans, k2 in zip(b.column("text"), b.column("_spans"), b.column("_k2"), strict=True):
                raw = t.as_py()
                words = raw.encode().split() if raw is not None else []
                ranges = R.covered(spans.as_py(), k2.as_py())
                kept, p = [], 0
                for s, e in ranges:
                    kept += words[p:s]
                    p = e
                kept += words[p:]
                whole = b" ".join(kept)
                texts.append(whole.decode() if ranges else raw)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(whole).hexdigest())
                where.append([{"s": s, "e": e} for s, e in ranges])
            cols = [b.column("_row"), pa.array(texts, b.schema.field("text").type), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sha, pa.string()), pa.array(where, pairs)], ["_row", "text", *_OWN])

    return C.put_back(joined.mapInArrow(C.tidy(cut), out).withColumnRenamed("text", "_text"), _OWN, {text: F.col("_text")})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed_spans").cast("long").alias("n_spans"))


#: The same by plain comparison of all windows, for tables of a size that bears it.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT rid, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
k AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM x),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1),
g AS (SELECT DISTINCT rid, i + o AS i FROM r, range(0, 35) AS t(o)),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
s AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.i) AS kept, count(*) AS n FROM w ANTI JOIN g ON w.rid = g.rid AND w.i = g.i GROUP BY w.rid),
spans AS (SELECT rid, count(*) AS n FROM (SELECT rid, i - lag(i, 1, -9) OVER (PARTITION BY rid ORDER BY i) AS gap FROM g) WHERE gap > 1 GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(s.n, 0))::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256, coalesce(spans.n, 0)::BIGINT AS n_spans
FROM d LEFT JOIN s ON d.rid = s.rid LEFT JOIN spans ON d.rid = spans.rid
"""
