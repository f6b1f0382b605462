"""Token counts of a byte-fallback BPE by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens where a space meets something else (no piece of such
a vocabulary crosses that edge; the loader checks it).  The distinct pre-tokens of a
batch are held as one ragged numpy array of symbols.  In each step every sequence
finds its pair of least rank and merges it, all sequences at once; a sequence without
a ranked pair is done and its surviving symbols are counted.  Counts of a batch's
pre-tokens are then summed by text.

Cases: a null text counts as empty (0 tokens); white space other than the space is
ordinary text, as in the library; the file's special strings inside a text are
ordinary text; a text may be of any length; an empty table gives an empty one; extra
columns are kept, but those that have the name of a result give way to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm import common as C

LIMIT = 4096
#: Distinct pre-tokens whose counts a worker remembers before it starts afresh.
MEMORY = 200_000
#: Characters above which a single pre-token is merged on its own, by a heap.
LONG = 512

_U = np.uint64
_SPACE = "▁"


class PieceModel:
    """Vocabulary and merge ranks of a piece file: pairs of symbols, by number, to (rank, symbol)."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("a BPE piece model with byte fallback, a leading space and no other normalisation is expected")
        normal = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        if any(_SPACE in p.lstrip(_SPACE) for p, _ in normal):
            raise ValueError("pieces with an inner space are not handled")
        self.known = {p for p, _ in normal}
        # symbols: single characters by their code point, longer pieces from 2**21 on
        number = {p: (ord(p) if len(p) == 1 else (1 << 21) + i) for i, (p, _) in enumerate(normal)}
        # ranks by falling score; equal scores share a rank, where the leftmost pair goes first
        rank = {s: r for r, s in enumerate(sorted({s for _, s in normal}, reverse=True))}
        keys, ranks, into = [], [], []
        for p, s in normal:
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                left = number.get(a) if len(a) > 1 else ord(a)
                right = number.get(b) if len(b) > 1 else ord(b)
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank[s])
                    into.append(number[p])
        order = np.argsort(np.array(keys, _U))
        self.keys, self.ranks, self.into = np.array(keys, _U)[order], np.array(ranks, np.int64)[order], np.array(into, np.int64)[order]
        self.table: dict[int, tuple[int, int]] | None = None
        self.single = np.array(sorted(ord(p) for p in self.known if len(p) == 1))

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens in each of the given pre-tokens (spaces written as U+2581)."""
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        if long:
            out = self.count([t if len(t) <= LONG else "" for t in tokens])
            for i in long:
                out[i] = self._cost(np.array(self._merge_long(tokens[i]), np.int64)).sum()
            return out
        if not any(tokens):
            return np.zeros(len(tokens), np.int64)
        sym = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).astype(np.int64)
        seq = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        total = np.zeros(len(tokens), np.int64)
        never = np.iinfo(np.int64).max
        done_sym, done_seq = [], []
        while len(sym):
            pair = sym[:-1].astype(_U) << _U(32) | sym[1:].astype(_U)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            ok = (self.keys[at] == pair) & (seq[:-1] == seq[1:])
            rank = np.append(np.where(ok, self.ranks[at], never), never)
            head = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            size = np.diff(np.append(head, len(seq)))
            least = np.minimum.reduceat(rank, head)
            live = least < never
            if not live.all():
                out = np.repeat(~live, size)
                done_sym.append(sym[out])
                done_seq.append(seq[out])
            if not live.any():
                break
            # the leftmost pair of least rank in each live sequence
            hit = np.flatnonzero(rank == np.repeat(np.where(live, least, -1), size))
            hit = hit[np.append(True, seq[hit][1:] != seq[hit][:-1])]
            sym = sym.copy()
            sym[hit] = self.into[at[hit]]
            keep = np.repeat(live, size)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        np.add.at(total, np.concatenate(done_seq), self._cost(np.concatenate(done_sym)))
        return total

    def _cost(self, sym: np.ndarray) -> np.ndarray:
        """Tokens a surviving symbol stands for: one, or the bytes of a character without a piece."""
        at = np.minimum(np.searchsorted(self.single, sym), len(self.single) - 1)
        return np.where((sym >= 1 << 21) | (self.single[at] == sym), 1, 1 + (sym > 0x7F) + (sym > 0x7FF) + (sym > 0xFFFF))

    def _merge_long(self, token: str) -> list[int]:
        """The same merges by a heap, for a pre-token so long that whole steps over it would add up."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.into.tolist(), strict=True), strict=True))
        sym: list[int] = [ord(c) for c in token]
        before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.table.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (found[0], i, j, sym[i] << 32 | sym[j]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, key = heapq.heappop(heap)
            if sym[i] < 0 or sym[j] < 0 or after[i] != j or sym[i] << 32 | sym[j] != key:
                continue
            sym[i], sym[j] = self.table[key][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in sym if s >= 0]


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _pre_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of a chunk's pre-tokens, and each row's first one.

    ``data`` holds every non-empty row with a space put before it and U+2581 written
    as a space, so a pre-token starts at a row's start and where a space follows another byte.
    """
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[off[:-1][np.diff(off) > 0]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, off)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; ``model_path`` must exist on every machine."""
    C.small_batches(docs.sparkSession)
    own = ["n_bytes", "n_tokens", "over_limit"]
    body = C.set_aside(docs, F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(model_path), {}
        for b in batches:
            data, off = C.text_buffers(b.column("text"))
            n = np.zeros(b.num_rows, np.int64)
            for i, j in C.chunks(off):
                texts = [data[off[r] : off[r + 1]].tobytes().replace(b"\xe2\x96\x81", b" ") for r in range(i, j)]
                texts = [b" " + t if t else t for t in texts]
                rows = np.cumsum([0] + [len(t) for t in texts])
                part = np.frombuffer(b"".join(texts), np.uint8)
                if not len(part):
                    continue
                starts, ends, first = _pre_tokens(part, rows)
                name = C.word_hashes(part, starts, ends)
                distinct, where, back = np.unique(name, return_index=True, return_inverse=True)
                if len(known) > MEMORY:
                    known.clear()
                new = [k for k, h in enumerate(distinct.tolist()) if h not in known]
                fresh = model.count([part[starts[where[k]] : ends[where[k]]].tobytes().decode().replace(" ", _SPACE) for k in new])
                known.update(zip(distinct[new].tolist() if new else [], fresh.tolist(), strict=True))
                each = np.array([known[h] for h in distinct.tolist()], np.int64)[back]
                sums = np.concatenate(([0], np.cumsum(each)))
                n[i:j] = sums[first[1:]] - sums[first[:-1]]
            size = np.diff(off)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(size), pa.array(n), pa.array(n > limit)], ["_row", *own])

    kinds = (T.LongType(), T.LongType(), T.BooleanType())
    out = T.StructType([body.schema["_row"], *(T.StructField(c, k) for c, k in zip(own, kinds, strict=True))])
    return C.put_back(body.mapInArrow(C.tidy(count), out), own)


def query(spark, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, str(public_tokenizers.path(model))).select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
