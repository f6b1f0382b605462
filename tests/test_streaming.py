"""Streaming operators on small logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomdex.streaming import watch


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_watch_and_latest(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("a.py", "modify", at(0)), ("a.py", "delete", at(1)), ("b.ts", "create", at(2)), ("node_modules/x.ts", "create", at(2))]
    spark.createDataFrame(rows, watch.EVENTS).write.parquet(log)
    seen = []
    stream = spark.readStream.schema(watch.EVENTS).parquet(log).filter(watch.wanted_paths(F.col("path"), ["py", "ts"]))
    watch.watch(stream, lambda b, n: seen.extend(map(tuple, b.collect())), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == [("a.py", "delete"), ("b.ts", "create")]


def test_watcher_indexes_what_changed(spark, tmp_path):
    """A batch's paths are indexed, ignored ones left out, and those that are gone deleted; the ignore file is read anew."""
    from loomdex.plans.engine import Engine

    root, log = tmp_path / "tree", str(tmp_path / "log")
    root.mkdir()
    for name in ("a.py", "b.py", "c.py"):
        (root / name).write_text(f"def {name[0]}():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "idx"))
    e.index_tree(str(root), now=1)
    (root / "a.py").write_text("def a2():\n    return 2\n")
    (root / "b.py").unlink()
    (root / "c.py").write_text("def c2():\n    return 2\n")
    (root / ".gitignore").write_text("c.py\n")
    spark.createDataFrame([("a.py", "modify", at(0)), ("b.py", "delete", at(1)), ("c.py", "modify", at(1)), ("x.txt", "create", at(2))], watch.EVENTS).write.parquet(log)
    stream = spark.readStream.schema(watch.EVENTS).parquet(log)
    watch.watch(stream, watch.index_changes(e, str(root), now=lambda: 5), str(tmp_path / "cp")).awaitTermination(120)
    assert {r["fqn"] for r in e.store.read("symbols").collect()} == {"a.py::a2", "c.py::c"}


def test_debounce(spark):
    df = spark.createDataFrame([("a", "m", at(0)), ("b", "m", at(0.3)), ("a", "m", at(0.7)), ("a", "m", at(5))], watch.EVENTS)
    assert sorted(r["n"] for r in watch.debounce(df).collect()) == [1, 3]


def test_detector_streams(spark, tmp_path):
    shape = "session_id string, symbol_fqn string, file_path string, change_kind string, ts timestamp"
    rows = [("s", "f", "a", "added", at(0)), ("s", "f", "a", "removed", at(100)), ("s", "g", "a", "added", at(0)), ("s", "g", "a", "removed", at(900)), ("s", "h", "a", "body_changed", at(20)), ("s", "h", "a", "body_changed", at(30))]
    path = str(tmp_path / "c")
    spark.createDataFrame(rows, shape).write.parquet(path)
    for name, stream, want in (("dead", watch.dead_end_stream, {"f"}), ("thrash", watch.thrashing_stream, {"a"})):
        mode = "append" if name == "dead" else "update"
        q = stream(spark.readStream.schema(shape).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(90)
        got = spark.table(name)
        assert {r["symbol_fqn" if name == "dead" else "file_path"] for r in got.collect()} == want


def test_circular_stream(spark, tmp_path):
    shape = "session_id string, kind string, content string, ts timestamp"
    ask = lambda s, i, q: (s, "auto", f"Tool: t. Query: {q}. Result: r", at(i))
    rows = [ask("s", i, "find the token check") for i in range(3)] + [ask("t", 0, "find token"), ask("t", 1, "database pool"), ask("t", 2, "find token")]
    rows += [ask("u", 0, "a token"), ask("u", 1, "a token"), ("u", "manual", "noted", at(2)), ask("u", 3, "a token")]
    path = str(tmp_path / "c")
    spark.createDataFrame(rows, shape).write.parquet(path)
    q = watch.circular_stream(spark.readStream.schema(shape).parquet(path)).writeStream.format("memory").queryName("circular").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [tuple(r) for r in spark.table("circular").collect()] == [("s", "find the token check", 3)]


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.log", "a/b.log", True), ("build/", "x/build/y.ts", True), ("/src/*.ts", "src/a.ts", True), ("/src/*.ts", "lib/src/a.ts", False), ("a/**/b", "a/x/y/b", True)])
def test_ignore_patterns(pattern, path, hit):
    import re

    assert bool(re.search(watch.pattern_to_regex(pattern), path)) is hit


def test_keyset(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, t long")
    assert [r["id"] for r in watch.keyset_page(df, "t", "id", 5, 1, 9).collect()] == [2, 3]
