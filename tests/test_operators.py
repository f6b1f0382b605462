"""Graph, diff, detector, packing and memory operators against hand-made values and small models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import detect, diff, graph, memory, pack, rank, resolve
from loomdex.sources import extract, store


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src long, dst long, kind string")


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def test_paths_and_bridges(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (1, 3)])
    assert [r["path"] for r in graph.k_paths(e, 1, 4, 3).collect()] == [[1, 3, 4], [1, 2, 3, 4]]
    assert [r["path"] for r in graph.k_paths(e, 4, 1, 3).collect()] == []
    assert [(r["id"], r["how"]) for r in graph.bridges(edges(spark, [(1, 3), (2, 3)]), 1, 2).collect()] == [(3, "called by both")]


def paths_model(pairs, source, target, k):
    """All loopless paths by extension, shortest first."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    found, paths = [], [[source]]
    while paths:
        paths = [[*p, b] for p in paths for b in sorted(after.get(p[-1], ())) if b not in p]
        found += sorted(p for p in paths if p[-1] == target)
        paths = [p for p in paths if p[-1] != target]
    return found[:k]


@pytest.mark.parametrize("small", [0, 1000])
def test_paths_match_a_model(spark, small):
    rng = random.Random(5)
    for _ in range(3 if small else 1):
        pairs = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(20)})
        got = [r["path"] for r in graph.k_paths(edges(spark, pairs), 0, 7, 6, small=small).collect()]
        assert got == paths_model(pairs, 0, 7, 6)


def test_paths_of_any_length(spark):
    chain = [(i, i + 1) for i in range(20)] + [(3, 30), (30, 4)]
    assert [r["hops"] for r in graph.k_paths(edges(spark, chain), 0, 20, 3).collect()] == [20, 21]


def test_resolution_against_a_model(spark):
    """Same file, then exported, then any, for common and for rare names; and only in files that come no later."""
    rng = random.Random(9)
    files = [(i, f"f{i}") for i in range(6)]
    symbols = [(i, rng.randrange(6), f"n{rng.randrange(5) if i % 2 else 0}", f"q{i}", i, rng.random() < 0.4) for i in range(60)]
    raw = [(f"f{s[1]}", s[3], f"n{rng.randrange(6)}", "calls") for s in symbols for _ in range(2)]
    frames = spark.createDataFrame(raw, "path string, from_fqn string, to_name string, kind string"), spark.createDataFrame(symbols, "id long, file_id long, name string, fqn string, start_line long, is_exported boolean"), spark.createDataFrame(files, "id long, path string")
    for parity in (False, True):
        want = set()
        for path, fqn, name, kind in raw:
            able = [s for s in symbols if s[2] == name and (not parity or f"f{s[1]}" <= path)]
            if able:
                want.add((int(fqn[1:]), min(able, key=lambda s: (0 if f"f{s[1]}" == path else 1 if s[5] else 2, s[0]))[0], kind))
        got = resolve.resolve_edges(*frames, parity=parity).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_failing_rule_is_left_out(spark, caplog):
    rows = spark.createDataFrame([("s", "f::a", "f", k, t) for k, t in (("added", 10), ("removed", 20), ("added", 30), ("added", 31))], "session_id string, symbol_fqn string, file_path string, change_kind string, detected_at long")
    broken = detect.Rule("broken", "", lambda c, o, n: c.select("nothing"))
    late = detect.Rule("late", "", lambda c, o, n: c.select("session_id", F.raise_error(F.lit("x")).alias("rule"), F.lit("").alias("summary"), F.array("file_path").alias("involved"), F.lit("").alias("severity")))
    found = detect.run_all(rows, rows, 40, (broken, late, *detect.RULES[:2])).collect()
    assert {r["rule"] for r in found} == {"dead_end", "file_thrashing"}


def test_dead_ends_at_the_edges_of_the_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["added", "removed"]), rng.randrange(2000)) for _ in range(150)]
    df = spark.createDataFrame(rows, "symbol_fqn string, change_kind string, detected_at long")
    want = sorted((a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] == "added" and b[1] == "removed" and 0 < b[2] - a[2] < 300)
    assert sorted((r["symbol_fqn"], r["t0"], r["t1"]) for r in detect.dead_end_pairs(df).collect()) == want


def test_indexed_bm25_equals_that_of_texts(spark):
    rng = random.Random(4)
    words = "alpha running runner run beta gamma tests testing".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))), None if i % 3 else "alpha tests") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    fields = {"a": 2.0, "b": 1.0}
    for stem in (False, True):
        index, lengths = rank.postings(df, "id", fields, stem), rank.text_lengths(df, "id", fields)
        for query in ("alpha", "running tests zzz", "zzz", "..."):
            one, two = ({r["id"]: r["bm25"] for r in f.collect()} for f in (rank.bm25(df, "id", fields, query, stem=stem), rank.bm25_indexed(index, lengths, "id", query, stem=stem)))
            assert one == pytest.approx(two)


def test_bfs_and_callers(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4)])
    at = lambda d: {r["id"] for r in graph.bfs(e, ids(spark, 1), "out", d).collect()}
    assert at(1) == {2} and at(2) == {2, 3}
    row = graph.transitive_callers(edges(spark, [(3, 2), (2, 1)]), ids(spark, 1)).first()
    assert (row["callers"], row["radius"]) == (2, "low")
    assert graph.transitive_callers(edges(spark, [(1, 1)]), ids(spark, 1)).first()["callers"] == 0


@pytest.mark.parametrize("small", [0, 100])
def test_pagerank(spark, small):
    rank = lambda pairs, *nodes: {r["id"]: r["centrality"] for r in graph.pagerank(ids(spark, *nodes), edges(spark, pairs), rounds=12, small=small).collect()}
    assert max(rank([(1, 2), (2, 3), (3, 1)], 1, 2, 3).values()) == pytest.approx(1)
    two = rank([(1, 2), (3, 4)], 1, 2, 3, 4)
    assert two[2] >= two[1] and two[4] >= two[3] and 0 <= rank([(1, 1)], 1)[1] <= 1


def test_small_pagerank_equals_large(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(30)]
    both = [{r["id"]: r["centrality"] for r in graph.pagerank(ids(spark, *range(12)), edges(spark, pairs), rounds=6, tolerance=None, small=n).collect()} for n in (0, 1000)]
    assert both[0] == pytest.approx(both[1])
    assert graph.pagerank(ids(spark), edges(spark, [])).count() == 0


def test_symbol_changes_and_renames(spark):
    shape = "fqn string, path string, signature string, is_exported boolean, body_hash string"
    a = spark.createDataFrame([("f::foo", "f", "fn foo(x: i32)", True, "1"), ("f::bar", "f", "s", True, "1"), ("f::same", "f", "s", True, "1"), ("f::validate", "f", "s", True, "2")], shape)
    b = spark.createDataFrame([("f::foo", "f", "fn foo(x: i64)", False, "2"), ("f::bar", "f", "s", False, "2"), ("f::same", "f", "s", True, "1"), ("f::validata", "f", "s", True, "2")], shape)
    c = diff.symbol_changes(a, b)
    got = {r["symbol_fqn"]: (r["change_kind"], r["old_value"], r["new_value"]) for r in c.collect()}
    assert got["f::foo"] == ("signature_changed", "fn foo(x: i32)", "fn foo(x: i64)") and got["f::bar"] == ("visibility_changed", "exported", "private")
    assert "f::same" not in got
    named = {r["symbol_fqn"]: r["change_kind"] for r in diff.resolve_renames(c).collect()}
    assert named["f::validata"] == "renamed" and "f::validate" not in named and len(named) == 3


CHANGES = "id long, symbol_fqn string, file_path string, change_kind string, session_id string, detected_at long"
OBS = "id long, session_id string, kind string, content string, created_at long"


def test_detectors(spark):
    now = 1000
    ch = spark.createDataFrame([(1, "test::foo", "a", "added", "s", 800), (2, "test::foo", "a", "removed", "s", 900), *((i, f"x{i}", "b", "body_changed", "s", 990) for i in range(3, 7)), *((i, f"x{i}", "c", "body_changed", "s", 990) for i in range(7, 10))], CHANGES)
    q = lambda i, kind="auto", text="Tool: t. Query: find the token. Result: r": (i, "s", kind, text, 900 + i)
    obs = spark.createDataFrame([q(1), q(2), q(3)], OBS)
    got = {r["rule"]: r for r in detect.run_all(ch, obs, now).collect()}
    assert got["dead_end"]["involved"] == ["test::foo"] and got["file_thrashing"]["involved"] == ["b"] and got["circular_search"]["severity"] == "info"
    broken = spark.createDataFrame([q(1), q(2), q(3, "manual", "note"), q(4), q(5)], OBS)
    assert detect.circular_searches(ch, broken, now).count() == 0
    none = ch.limit(0)
    assert detect.run_all(none, obs.limit(0), now).count() == 0


def test_packing(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 4), (4, 1)], "id long, tokens long")
    assert [r["id"] for r in pack.prefix_pack(rows, 10, "tokens", ["id"]).collect()] == [1]
    assert sorted(r["id"] for r in pack.pack_first_fit(rows, 10, "tokens", [F.col("id")], "id").collect()) == [1, 3, 4]
    cap = {"pivots": [{"path": "a", "content": "x" * 400}], "skeletons": [{"path": "b", "depth": 1, "skeleton": "y" * 300}, {"path": "c", "depth": 2, "skeleton": "z" * 300}], "memories": [], "warnings": [], "recent_changes": []}
    cut = pack.trim(cap, 260)
    assert [s["path"] for s in cut["skeletons"]] == ["b"] and cut["tokens_used"] <= 262
    assert "left out" in pack.trim(cap, 90)["pivots"][0]["content"]


def test_compression(spark):
    from loomdex import schema

    s = spark.createDataFrame([("s", 0, 0, False, None, None, None), ("t", 0, 9000, False, None, None, None)], schema.SESSIONS)
    o = spark.createDataFrame([(1, "s", "auto", "token token login", "h1", 2, False, 0, None), (2, "s", "insight", "login", "h2", 2, False, 0, None)], schema.OBSERVATIONS)
    links = spark.createDataFrame([(1, "b.ts::x"), (2, "a.ts::y")], schema.OBSERVATION_LINKS)
    done, left = memory.compress(s, o, links, 10_000, 7_200)
    row = done.filter("id = 's'").first()
    assert row["is_compressed"] and row["key_terms"] == "login,token" and row["key_files"] == "a.ts,b.ts" and row["summary"] == "h1; h2"
    assert [r["id"] for r in left.collect()] == [2] and not done.filter("id = 't'").first()["is_compressed"]


def test_store(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "i"))
    assert st.read("edges").count() == 0
    st.commit(edges=edges(spark, [(1, 2)]))
    st.commit(edges=st.read("edges").unionByName(edges(spark, [(2, 3)])))
    assert st.read("edges").count() == 2
    st.reset_code()
    assert st.read("edges").count() == 0
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, store.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, store.replace_rows(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


@pytest.mark.parametrize(
    ("path", "source", "symbols", "calls"),
    [
        ("a.ts", "export interface User { id: string }\nexport type Id = string;\nexport const f = (x: number) => g(x);\nfunction foo() { bar(); baz(); }\n", {("User", "interface", True), ("Id", "type", True), ("f", "function", True), ("foo", "function", False)}, {"bar", "baz", "g"}),
        ("a.py", "class A:\n    def m(self):\n        return f(1)\n\ndef _g():\n    pass\n", {("A", "class", True), ("m", "method", True), ("_g", "function", False)}, {"f"}),
        ("a.rs", "/// Doc.\npub fn run(x: i32) -> i32 {\n    helper(x)\n}\nfn helper(x: i32) -> i32 { x }\npub struct S { a: i32 }\nimpl S {\n    pub fn new() -> S { S { a: 1 } }\n}\n", {("run", "function", True), ("helper", "function", False), ("S", "struct", True), ("new", "method", True)}, {"helper"}),
        ("a.go", "package a\n\nfunc ProcessData(x int) int {\n\treturn helper(x)\n}\n\nfunc helper(x int) int { return x }\n\ntype T struct {\n\tA int\n}\n", {("ProcessData", "function", True), ("helper", "function", False), ("T", "struct", True)}, {"helper"}),
        ("A.java", "import java.util.List;\npublic class A {\n    public int get(int x) {\n        return help(x);\n    }\n    private int help(int x) { return x; }\n}\n", {("A", "class", True), ("get", "method", True), ("help", "method", False)}, {"help"}),
        ("a.rb", "class A\n  def go(x)\n    run(x)\n  end\nend\n", {("A", "class", True), ("go", "method", True)}, {"run"}),
        ("a.c", "#include <stdio.h>\nint add(int a, int b) {\n  return plus(a, b);\n}\nstruct P {\n  int x;\n};\n", {("add", "function", True), ("P", "struct", True)}, {"plus"}),
        ("a.cpp", "class A {\n public:\n  int get() {\n    return f();\n  }\n};\nnamespace n {\n}\n", {("A", "class", True), ("get", "method", False), ("n", "module", True)}, {"f"}),
        ("a.cs", "using System;\npublic class A {\n    public int Get(int x) {\n        return Help(x);\n    }\n}\n", {("A", "class", True), ("Get", "method", True)}, {"Help"}),
        ("a.sh", "greet() {\n  echo hi\n}\nfunction bye {\n  echo bye\n}\n", {("greet", "function", True), ("bye", "function", True)}, set()),
        ("a.php", "<?php\nclass A {\n    public function go() {\n        return run();\n    }\n    private function no() {}\n}\n", {("A", "class", True), ("go", "method", True), ("no", "method", False)}, {"run"}),
        ("a.zig", "pub fn main() void {\n    run();\n}\nconst S = struct {\n    a: i32,\n};\n", {("main", "function", True), ("S", "struct", False)}, {"run"}),
    ],
)
def test_extraction(path, source, symbols, calls):
    found, raw = extract.parse(path, source)
    assert {(s.name, s.kind, s.exported) for s in found} == symbols
    assert {e[1] for e in raw if e[2] == "calls"} >= calls


def test_broken_sources():
    assert extract.parse("a.py", "def (:") == ([], []) and extract.parse("a.txt", "x") == ([], []) and extract.parse("a.ts", "")[0] == []


def test_first_fit_query_takes_whole_groups(spark, tmp_path):
    """Sources of more than 50 documents, against a Python model."""
    rng = random.Random(8)
    rows = [(i, "x" * rng.choice([0, 7, 400, 3000, 20_000]), rng.choice(["a", "b", "c", None])) for i in range(400)] + [(400, None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    used, want = {}, []
    for i, t, s in rows:
        n = math.ceil(len(t or "") / 3.5)
        if used.get(s, 0) + n <= 3000:
            used[s] = used.get(s, 0) + n
            want.append((s, i))
    from loomdex.plans.catalogue import QUERIES

    assert sorted(map(tuple, QUERIES["first_fit_pack"](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_store_appends_and_vacuum(spark, tmp_path, monkeypatch):
    st = store.Store(spark, str(tmp_path))
    row = lambda *k: spark.createDataFrame([(i, f"s{i}") for i in k], "observation_id long, symbol_fqn string")
    ids = lambda: sorted(r["observation_id"] for r in st.read("observation_links").collect())
    st.append(observation_links=row(1))
    st.append(observation_links=row(2))
    before = st.read("observation_links")
    st.append(observation_links=row(3))
    assert ids() == [1, 2, 3] and before.count() == 2  # a reader keeps what it began with
    monkeypatch.setattr(store.Store, "PARTS", 3)
    st.append(observation_links=row(4))  # too many parts: they become one
    assert ids() == [1, 2, 3, 4] and len(st._pointer()["tables"]["observation_links"]) == 1
    assert st.vacuum() == [] and len(st.vacuum(older_than=0)) == 4 and ids() == [1, 2, 3, 4]
    st.commit(observation_links=row(9))
    assert ids() == [9]


def test_pivots_are_packed_by_size(spark, tmp_path):
    """Files of more bytes than a text can have: only their sizes count.  Contents come for those that are taken, and not through a broadcast."""
    from loomdex.plans import catalogue_more

    big = 1_500_000_000
    docs = [(1, "a", big), (2, "a", big), (3, "b", 96), (4, None, big), (5, "c", big // 2)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, catalogue_more.pivot_packing(spark, str(tmp_path)).collect())) == [("b", 1), ("c", 2 if big // 2 % 97 > big % 97 else 3)]
    found = spark.createDataFrame([("a", 0.5, "a::x", "function", "w"), ("a", 0.9, "a::y", "function", "w"), ("b", 0.8, "b::z", "class", "w"), ("c", 0.1, "c::q", "class", "w")], "path string, score double, fqn string, kind string, why string")
    sources = spark.createDataFrame([("a", "x" * 35), ("b", "y" * 350), ("c", "z" * 7), ("d", "z")], "path string, content string")
    taken = pack.pivot_files(found, sources, 20)
    assert [(r["path"], r["pos"], r["tokens"], r["content"], [s["fqn"] for s in r["symbols"]], r["best"]) for r in taken.orderBy("pos").collect()] == [("a", 1, 10, "x" * 35, ["a::y", "a::x"], 0.9), ("c", 3, 2, "z" * 7, ["c::q"], 0.1)]
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Join")].endswith("SortMerge")  # the outermost, which fetches the contents


def test_renames_of_many_files_match_a_model(spark):
    """Names that resemble several others are paired in order, file by file, without a call for each file."""
    rng = random.Random(4)
    rows = [(f"f{f}::{name}{i}", f"f{f}", kind, None, None) for f in range(300) for kind, name in (("removed", "alphabet"), ("added", "alphabex")) for i in rng.sample(range(60), rng.randrange(4))]
    found = diff.resolve_renames(spark.createDataFrame(rows, "symbol_fqn string, file_path string, change_kind string, old_value string, new_value string"))
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    near = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) <= 3 if len(a) == len(b) else abs(len(a) - len(b)) == 1
    want = set()
    for f in range(300):
        gone, come = (sorted(r[0] for r in rows if r[1] == f"f{f}" and r[2] == k) for k in ("removed", "added"))
        pairs = {}
        for old in gone:
            new = next((c for c in come if c not in pairs.values() and near(old.split("::")[1], c.split("::")[1])), None)
            if new:
                pairs[old] = new
        want |= {(new, "renamed", old) for old, new in pairs.items()} | {(x, "removed", None) for x in gone if x not in pairs} | {(x, "added", None) for x in come if x not in pairs.values()}
    assert {(r["symbol_fqn"], r["change_kind"], r["old_value"]) for r in found.collect()} == want


def test_a_search_of_a_large_graph_leaves_its_edges_as_they_are(spark, monkeypatch):
    """Repeated edges, and such without an end, cost nothing and change nothing; only what is reached is made distinct."""
    def fail(*_):
        raise AssertionError("all edges in both directions")

    rng = random.Random(8)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(25)] * 4 + [(1, None), (None, 2)]
    e = edges(spark, pairs)
    want = {way: {tuple(r) for r in graph.bfs(e, ids(spark, 1, 2), way, 3).collect()} for way in ("out", "in", "both")}
    monkeypatch.setattr(graph, "_directed", fail)
    for way in want:
        got = graph.bfs(e, ids(spark, 1, 2), way, 3, small=0).collect()
        assert {tuple(r) for r in got} == want[way] and len(got) == len(want[way]), way
    assert len(want["both"]) > len(want["out"])


def test_terms_are_counted_where_their_rows_are(spark):
    """Counts and weights of rows, also in odd forms, match a model and take no shuffle; rows of one id count as one."""
    from collections import Counter

    from loomdex.functions import text as X

    rng = random.Random(6)
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randrange(12)))
    rows = [(f"i{k}", text(), text()) for k in range(700)]
    df = spark.createDataFrame(rows, "id string, x string, y string")
    index = rank.postings(df, "id", {"x": 1.0, "y": 3.0})
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    want = {(i, t): (sum(n * w for n, w in ((Counter((x or "").split())[t], 1), (Counter((y or "").split())[t], 3))), len((x or "").split() + (y or "").split())) for i, x, y in rows for t in {*(x or "").split(), *(y or "").split()}}
    got = index.collect()
    assert {(r["id"], r["term"]): (r["f"], r["dl"]) for r in got} == want and len(got) == len(want)
    tf = {(r["id"], r["term"]): (r["n"], r["tf"]) for r in rank.term_frequencies(spark.createDataFrame([(1, "a b"), (1, "a c c"), (2, "a"), (None, "a"), (3, None)], "id long, x string"), "id", X.fts_terms(F.col("x"))).collect()}
    assert tf == {(1, "a"): (2, 0.4), (1, "b"): (1, 0.2), (1, "c"): (2, 0.4), (2, "a"): (1, 1.0), (None, "a"): (1, 1.0)}
