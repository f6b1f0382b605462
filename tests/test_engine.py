"""The engine on a small source tree: indexing, searching, packing, memory."""

import pytest
from pyspark.sql import functions as F

from loomdex.operators import graph, rank
from loomdex.plans.engine import Engine
from loomdex.sources import files

TREE = {
    "src/auth.ts": "import { Db } from './database';\n/** Checks a token. */\nexport function validateToken(t: string): boolean {\n  return decode(t) !== null;\n}\nfunction decode(t: string) {\n  return t;\n}\nexport class AuthService {\n  login(u: string): boolean {\n    return validateToken(u);\n  }\n}\n",
    "src/database.ts": "export class DatabasePool {\n  connect(url: string): void {\n    open(url);\n  }\n}\nexport function open(url: string): void {}\n",
    "src/middleware.ts": "import { validateToken } from './auth';\nexport function authMiddleware(r: string) {\n  return validateToken(r);\n}\n",
    "tool.py": "import os\n\n\nclass Runner:\n    \"\"\"Runs things.\"\"\"\n\n    def run(self):\n        return helper()\n\n\ndef helper():\n    return os.getcwd()\n",
}


def table(spark, tree):
    return spark.createDataFrame(list(tree.items()), "path string, content string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    e.first = e.index(table(spark, TREE), now=1000)
    return e


def test_index_and_incremental(engine, spark):
    assert engine.first["added"] == 4
    fqns = {r["fqn"]: r for r in engine.store.read("symbols").collect()}
    assert fqns["src/auth.ts::validateToken"]["is_exported"] and fqns["src/auth.ts::validateToken"]["kind"] == "function"
    assert fqns["src/auth.ts::validateToken"]["docstring"] == "Checks a token."
    assert fqns["src/auth.ts::AuthService::login"]["kind"] == "method"
    assert fqns["tool.py::Runner"]["docstring"] == "Runs things."
    ids = {r["id"]: r["fqn"] for r in fqns.values()}
    edges = {(ids[r["src"]], ids[r["dst"]]) for r in engine.store.read("edges").collect()}
    assert ("src/middleware.ts::authMiddleware", "src/auth.ts::validateToken") in edges
    assert ("src/auth.ts::AuthService::login", "src/auth.ts::validateToken") in edges
    assert ("tool.py::Runner::run", "tool.py::helper") in edges
    again = engine.index(table(spark, TREE), now=1001)
    assert again["unchanged"] == 4 and again["added"] == again["changed"] == 0
    top = engine.store.read("centrality").agg(F.max("centrality")).first()[0]
    assert top == pytest.approx(1.0)


def test_search_and_capsule(engine, spark):
    found, relaxed = engine.search("validateToken")
    rows = found.collect()
    assert not relaxed and rows[0]["fqn"] == "src/auth.ts::validateToken"
    none, relaxed = engine.search("zzzqqq")
    assert relaxed and none.isEmpty()
    cap = engine.run_pipeline("fix the bug in validateToken", table(spark, TREE), max_tokens=2000, now=2000)
    assert cap["intent"] == "debug" and cap["tokens_used"] <= 2000
    paths = {p["path"] for p in cap["pivots"]}
    assert "src/auth.ts" in paths and not paths & {s["path"] for s in cap["skeletons"]}
    assert any(h["fqn"] == "src/auth.ts::validateToken" and h["callers"] >= 2 for h in cap["impact_hints"])
    empty = engine.capsule("zzzqqq", table(spark, TREE), now=2000)
    assert empty["no_results_reason"] and not empty["pivots"]


def test_skeleton_impact_flow(engine):
    bones = engine.skeleton(["src/auth.ts"]).first()
    assert "  login(u: string): boolean" in bones["skeleton"] and "/// Checks a token." in bones["skeleton"]
    near = engine.impact_graph("src/auth.ts::validateToken", 2)
    assert {n["fqn"] for n in near["nodes"] if n["direction"] == "caller"} >= {"src/middleware.ts::authMiddleware"}
    flow = engine.logic_flow("authMiddleware", "src/auth.ts::decode")
    assert flow["paths"][0]["hops"] == 2
    assert engine.logic_flow("src/auth.ts::AuthService::login", "authMiddleware")["bridges"] == [{"fqn": "src/auth.ts::validateToken", "how": "called by both"}]
    with pytest.raises(graph.SymbolError):
        engine.logic_flow("nothing", "decode")


def test_memory_changes_and_warnings(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    s = e.start_session(now=100)
    e.index(table(spark, TREE), s, now=110)
    note = e.save_observation(s, "JWT authentication uses validateToken", "insight", "jwt", ["src/auth.ts::validateToken"], now=120)
    e.save_observation(s, "The database pool is small", "insight", "db", now=121)
    assert e.search_memory("JWT authentication", now=130).first()["id"] == note
    changed = dict(TREE) | {"src/auth.ts": TREE["src/auth.ts"].replace("(t: string): boolean", "(t: string, x: number): boolean")}
    stats = e.index(table(spark, changed), s, now=140)
    assert stats["changed"] == 1 and stats["unchanged"] == 3
    kinds = {(r["symbol_fqn"], r["change_kind"]) for r in e.store.read("symbol_changes").filter("detected_at = 140").collect()}
    assert ("src/auth.ts::validateToken", "signature_changed") in kinds
    assert e.store.read("observations").filter(F.col("id") == note).first()["is_stale"]
    for i in range(3):
        e.capture(s, "get_context_capsule", "1 pivot", "debug", "find token validation", now=150 + i)
    assert e.capture(s, "reindex", "done") is None
    assert e.note_warnings(now=160) >= 1 and e.note_warnings(now=161) == 0
    assert e.store.read("observations").filter("kind = 'warning' and content like '[circular_search]%'").count() == 1
    assert e.compress_sessions(now=100_000_000) == 1
    row = e.session_context().first()
    assert row["is_compressed"] and row["key_files"] == "src/auth.ts" and "jwt" in row["summary"]
    assert e.store.read("observations").filter("kind = 'auto'").count() == 0
    with pytest.raises(ValueError):
        e.save_observation(s, "  ")
    assert e.status(now=200)["files"] == 4


def test_walk_and_tree(spark, tmp_path):
    for name, body in {"a.py": "x = 1\n", "__init__.py": "", ".hidden.py": "", "skip/b.py": "", "c.txt": "", "d.rs": "fn main() {}\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / ".gitignore").write_text("skip/\n")
    (tmp_path / "big.py").write_text("#" * (1 << 20) + "\n\n")
    assert files.walk(str(tmp_path)) == ["__init__.py", "a.py", "d.rs"]
    got = files.read_tree(spark, str(tmp_path))
    assert {r["path"] for r in got.collect()} == {"__init__.py", "a.py", "d.rs"}
    e = Engine(spark, str(tmp_path / ".idx"))
    e.index_tree(str(tmp_path), now=1)
    (tmp_path / "d.rs").unlink()
    session = e.start_session(now=1)
    note = e.save_observation(session, "main starts it", "insight", links=["d.rs::main"], now=1)
    stats = e.index_paths(str(tmp_path), ["d.rs"], session_id=session, now=2)
    assert e.status(now=3)["files"] == 2 and stats["deleted"] == 1
    # what went with the file is logged, and notes on it are stale
    assert [(r["symbol_fqn"], r["change_kind"], r["session_id"]) for r in e.store.read("symbol_changes").filter("detected_at = 2").collect()] == [("d.rs::main", "removed", session)]
    assert e.store.read("observations").filter(F.col("id") == note).first()["is_stale"]


def test_fallback_scores_and_vectors(spark, tmp_path):
    e = Engine(spark, str(tmp_path), encoder=lambda texts: [[float(len(t)), 1.0] for t in texts])
    e.index(table(spark, TREE), now=1)
    found = rank.search_lexical(e.store.read("symbols"), e.store.read("files"), "validate token", 5)
    same = rank.search_lexical(e.store.read("symbols"), e.store.read("files"), "validate token", 5, index=(e.store.read("postings"), e.store.read("text_lengths")))
    rows = found.select("fqn", "score", "intent", "path").collect()
    assert rows and rows[0]["intent"] == "fallback"
    assert [(r["fqn"], pytest.approx(r["score"])) for r in rows] == [(r["fqn"], r["score"]) for r in same.collect()]
    assert e.embedding_coverage()["share"] == 1.0 and e.embed_missing(now=2) == 0
    s = e.start_session(now=3)
    note = e.save_observation(s, "tokens are validated in one place", "insight", now=3)
    e.search_memory("tokens", now=4, persist=True)
    assert e.store.read("observations").filter(F.col("id") == note).first()["score"] > 0


def test_overloads_are_stable(spark, tmp_path):
    """Of overloads the first stands for all, so that an unchanged one isn't logged with the others' changes."""
    code = "pub struct S { a: i32 }\nimpl S {\n    fn f(&self) {}\n}\nimpl S {\n    fn f(&self, x: i32) {}\n}\n"
    e = Engine(spark, str(tmp_path))
    e.index(table(spark, {"a.rs": code}), now=1)
    e.index(table(spark, {"a.rs": code + "\nfn g() {}\n"}), now=2)
    assert [(r["symbol_fqn"], r["change_kind"]) for r in e.store.read("symbol_changes").filter("detected_at = 2").collect()] == [("a.rs::g", "added")]


def test_service(spark, tmp_path):
    """Messages in, answers out; errors as the protocol has them; calls are noted."""
    import io
    import json

    from loomdex import service

    for name, body in TREE.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    e = Engine(spark, str(tmp_path / ".idx"))
    e.index_tree(str(tmp_path), now=1)
    call = lambda i, name, **a: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": a}}
    messages = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}}, {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "nothing"}, call(4, "nothing"), call(5, "get_skeleton"), call(6, "get_skeleton", files=[1]),
        call(7, "get_context_capsule", query="validate token"), call(8, "get_impact_graph", symbol_fqn="no::such"), call(9, "save_observation", content="a note", symbols=["x"]), call(10, "search_memory", query="note"),
        call(11, "get_skeleton", files=["src/auth.ts"]), call(12, "index_status"), call(13, "get_session_context"), [1],
    ]
    out = io.StringIO()
    service.serve(service.Service(e, str(tmp_path)), io.StringIO("\n".join(map(json.dumps, messages)) + "\n\nnot json\n"), out)
    answers = {a["id"]: a for a in map(json.loads, out.getvalue().splitlines()) if a["id"] is not None}
    nameless = [a["error"]["code"] for a in map(json.loads, out.getvalue().splitlines()) if a["id"] is None]
    assert nameless == [service.INVALID_REQUEST, service.PARSE_ERROR] and set(answers) == set(range(1, 14))
    assert len(answers[2]["result"]["tools"]) == 10 and all(t["inputSchema"]["type"] == "object" for t in answers[2]["result"]["tools"])
    assert [answers[i]["error"]["code"] for i in (3, 4, 5, 6)] == [service.NO_METHOD] + [service.BAD_PARAMS] * 3
    text = lambda i: json.loads(answers[i]["result"]["content"][0]["text"])
    assert any(p["path"] == "src/auth.ts" for p in text(7)["pivots"]) and answers[8]["result"]["isError"]
    assert text(10)[0]["content"] == "a note" and "login(u: string): boolean" in text(11)[0]["skeleton"] and text(12)["files"] == 4
    kinds = [r["kind"] for r in e.store.read("observations").collect()]
    assert kinds.count("auto") == 3 and kinds.count("manual") == 1  # capsule, skeleton and context; some tools aren't noted
