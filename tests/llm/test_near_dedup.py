"""MinHash near-dedup against brute force, components against union-find."""

import random
from collections import defaultdict

import numpy as np

from loomdex.llm import minhash_dedup as M
from loomdex.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None and (least[find(i)] is None or d < least[find(i)]):
            least[find(i)] = d
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(4000)}"
            out.append(" ".join(own))
    out += [out[0], out[0].upper(), out[5] + "  ", "one two", "One  two", "one", "", None, "   "]
    return out


def test_against_brute_force(spark):
    for seed, k, percent in ((1, 3, 85), (2, 5, 80)):
        rows = [(100 - i, t) for i, t in enumerate(texts(seed))] + [(100, texts(seed)[0]), (None, texts(seed)[1]), (None, "quite alone here my friend yes")]
        df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, cls string")
        got = M.near_duplicates(df, shingle=k, percent=percent).collect()
        order = lambda r: (repr(r[0]), r[1], repr(r[2]))
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=order) == sorted(brute(rows, k, percent), key=order)
        assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_unsettled_buckets_are_compared_within(spark, monkeypatch):
    """A bucket's least member may link with none of two members that link with each other."""
    monkeypatch.setattr(M, "BLOCK", 3)
    monkeypatch.setattr(M, "SPLIT", 2)
    rows = [(i, t) for i, t in enumerate(texts(7))]
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=70).collect()}
    assert got == {d: c for d, _, c in brute(rows, 3, 70)}


def test_large_unsettled_buckets_are_split(spark, monkeypatch):
    """Split by other bands, over and over, they give what comparing all their members gives."""
    monkeypatch.setattr(M, "LARGE", 3)
    monkeypatch.setattr(M, "BLOCK", 3)
    split = []
    joined = M.components
    monkeypatch.setattr(M, "components", lambda edges: split.append(1) or joined(edges))
    rows = [(i, t) for i, t in enumerate(texts(7))]
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=70).collect()}
    assert got == {d: c for d, _, c in brute(rows, 3, 70)} and len(split) > 2


def test_large_buckets_without_a_second_one(spark, monkeypatch):
    """Links in a large bucket are found though the two share no other bucket, by which it could be split."""
    monkeypatch.setattr(M, "LARGE", 4)
    monkeypatch.setattr(M, "bands_for", lambda percent: 1)
    rng = random.Random(11)
    mult = M._multipliers(M.ROWS)
    common = [f"c{i}" for i in range(140)]

    def least(words):
        raw = " ".join(words).encode()
        x = (M.shingle_set(raw, 3) >> np.uint64(32)).astype(np.uint32)
        return [int((x * m).min()) for m in mult]

    rows, want = [], least(common)
    while len(rows) < 16:  # all in the bucket of what they have in common, two by two alike
        one = common + [f"w{rng.randrange(10**6)}" for _ in range(60 + 25 * (len(rows) % 3))]
        two = [*one[:-1], "end"]
        if least(one) == want == least(two):
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == {d: c for d, _, c in brute(rows, 3, 85)} == {d: d - d % 2 for d, _ in rows}


def test_keep_one(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (3, "A b c d e f", 2), (9, None, 3), (9, "", 3), (None, "a b c d e f", 4), (None, "x y z u v w", 5), (None, "x y z u v w", 5), (7, "quite other words in this one", 6)]
    got = M.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n long"))
    assert sorted(r["n"] for r in got.collect()) == [2, 3, 3, 5, 6] and got.columns == ["doc_id", "text", "n"]
    assert M.keep_one(got.limit(0)).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    rules = M.least_matches(85)
    assert [n for n, _ in rules] == [26, 52, 78, 104, 130] and all(m < 0.85 * n for n, m in rules) and rules[-1][1] > 60
    rng = np.random.default_rng(1)
    one = rng.integers(0, 2**16, 130).astype(np.uint16)
    near = np.where(rng.random((500, 130)) < 0.85, one, one + 1)
    far = np.where(rng.random((500, 130)) < 0.3, one, one + 1)
    assert M.plausible(one, near, rules).all() and not M.plausible(one, far, rules).any()


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    top = list(range(200))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1] or x in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
