"""Word and byte dedup against brute force, on both routes and on the pieces they are made of."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomdex.llm import common as C
from loomdex.llm import repeats as R
from loomdex.llm import substring_dedup as S
from loomdex.llm import suffix_dedup as B

SHAPE = "doc_id long, text string, _spans_like string"


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in é漢 alpha beta gamma delta".split()) + rng.choice(["", "s", "x", "1"])
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(60), text(300)
    docs = [text(rng.randrange(5, 200)) for _ in range(12)]
    docs += [docs[0], docs[0], docs[3] + "\n" + shared, shared + "\t" + docs[4], text(30) + " " + shared + " " + text(30), long, long.replace("alpha", "omega", 1)]
    docs += ["a " * 120, "a " * 90 + "b", "z" * 900, "z" * 401, "", None, "   ", text(9000)]
    rows = [(i, t, "x") for i, t in enumerate(docs)]
    return [*rows, (3, docs[3], "y"), (None, docs[1], "n")]  # a repeated row, and one without an id


def brute_words(rows, window):
    texts = [(t or "").encode().split() for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for w in texts:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(rows, window):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(x[i : i + window] for x in texts for i in range(len(x) - window + 1))
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for a, b in zip(b"\0" + bytes(gone), gone, strict=False) if b and not a)
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, R.HOT])
def test_words(spark, hot):
    rows = corpus()
    got = S.dedup_substrings(spark.createDataFrame(rows, SHAPE), window=12, gram=4, hot=hot).collect()
    key = lambda i, t, x: (repr(i), x)
    want = dict(zip([key(*r) for r in rows], brute_words(rows, 12), strict=True))
    assert {key(r["doc_id"], r["text"], r["_spans_like"]): (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert len(got) == len(rows)
    for r in got:  # untouched texts stay as they are, and the cut ones are what was hashed
        if r["n_removed"]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] and sum(s["e"] - s["s"] for s in r["removed_spans"]) == r["n_removed"]


@pytest.mark.parametrize("hot", [2, R.HOT])
def test_bytes(spark, hot):
    rows = corpus(2)
    got = B.dedup_bytes(spark.createDataFrame(rows, SHAPE), window=80, gram=16, hot=hot).collect()
    key = lambda i, x: (repr(i), x)
    want = dict(zip([key(i, x) for i, _, x in rows], brute_bytes(rows, 80), strict=True))
    assert {key(r["doc_id"], r["_spans_like"]): (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_empty(spark):
    none = spark.createDataFrame([], SHAPE)
    assert S.dedup_substrings(none).count() == 0 and B.dedup_bytes(none).count() == 0


@pytest.mark.parametrize(("solve", "symbols", "window"), [(S.deep_nodes, 5, 9), (B.tied_windows, 3, 70)])
def test_solvers(solve, symbols, window, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 8)
    rng = np.random.default_rng(3)
    for _ in range(12):
        parts = [rng.integers(0, symbols, rng.integers(window - 3, 200)) for _ in range(4)]
        parts += [parts[0][:150], parts[1][5:], np.zeros(120, int)]
        seq = np.concatenate(parts)
        first = np.cumsum([0] + [len(p) for p in parts])
        seen = Counter(tuple(p[i : i + window]) for p in parts for i in range(len(p) - window + 1))
        want = [a + i for a, p in zip(first, parts, strict=False) for i in range(len(p) - window + 1) if seen[tuple(p[i : i + window])] > 1]
        kind = np.uint8 if solve is B.tied_windows else np.uint64
        assert sorted(solve(seq.astype(kind), first[:-1], first[1:], window).tolist()) == want


def test_difference_cover():
    for a in range(B.PERIOD):
        for b in range(B.PERIOD):
            assert {(a + B.SHIFT[a, b]) % B.PERIOD, (b + B.SHIFT[a, b]) % B.PERIOD} <= set(B.COVER)


def test_word_scan():
    import pyarrow as pa

    texts = ["ab  c", "", None, "\td\n", "é f", "gh"]
    data, off = C.text_buffers(pa.array(texts))
    ws, we, first = C.find_words(data, off)
    got = [[bytes(data[s:e]).decode() for s, e in zip(ws[a:b], we[a:b], strict=True)] for a, b in zip(first, first[1:], strict=False)]
    assert got == [(t or "").split() for t in texts]
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 50):
        assert C.slicing_min(x, w).tolist() == [min(x[i : i + w]) for i in range(50 - w + 1)]


def test_blocks_keep_groups_whole():
    import pyarrow as pa

    kfp = sorted(random.Random(1).choices(range(12), k=200))
    batches = [pa.RecordBatch.from_pydict({"kfp": kfp[i : i + 7], "ctx": [b"x" * 40] * len(kfp[i : i + 7])}) for i in range(0, 200, 7)]
    blocks = [b.column("kfp").to_pylist() for b in R._blocks(iter(batches), 900)]
    assert sum(blocks, []) == kfp and len(blocks) > 3
    assert all(set(a).isdisjoint(b) for a, b in zip(blocks, blocks[1:], strict=False))


def test_long_text_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 50, 3000).astype(np.uint64)
    whole = R.runs_of(x, np.array([0, len(x)]), 30, 5)
    starts = sorted(i for a, b in zip(whole[1], whole[2], strict=True) for i in range(a, b + 1))
    assert starts == list(range(len(x) - 29))
