"""Command line: python -m loomdex index|reindex|status|serve|search|skeleton|impact|flow|memory|activity ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from loomdex.plans.engine import Engine
from loomdex.service import Service, serve
from loomdex.sources import files


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomdex")
    parser.add_argument("--root", default=".", help="a folder in the workspace")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "reindex", "status", "serve"):
        sub.add_parser(name)
    for name in ("search", "capsule", "memory"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--limit", type=int, default=10)
        p.add_argument("--intent")
        p.add_argument("--max-tokens", type=int)
    p = sub.add_parser("skeleton")
    p.add_argument("files", nargs="+")
    p.add_argument("--no-docs", action="store_true")
    p = sub.add_parser("impact")
    p.add_argument("fqn")
    p.add_argument("--depth", type=int, default=3)
    p = sub.add_parser("flow")
    p.add_argument("source")
    p.add_argument("target")
    p = sub.add_parser("activity")
    p.add_argument("--limit", type=int, default=20)
    a = parser.parse_args(args)

    spark = SparkSession.builder.appName("loomdex").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    root = files.workspace_root(a.root)
    engine = Engine(spark, str(root / files.OWN_FOLDER))
    show = lambda rows: print("\n".join(json.dumps(r.asDict(True), default=str, ensure_ascii=False) for r in rows))
    match a.command:
        case "index":
            print(json.dumps(engine.index_tree(str(root))))
        case "reindex":
            print(json.dumps(engine.reindex(files.read_tree(spark, str(root)))))
        case "serve":
            serve(Service(engine, str(root)), sys.stdin, sys.stdout)
        case "status":
            print(json.dumps(engine.status()))
        case "search":
            found, relaxed = engine.search(a.query, a.limit, a.intent)
            show(found.select("score", "kind", "fqn", "path", "start_line", "why", "matched_terms").collect())
            if relaxed:
                print("(relaxed)")
        case "capsule":
            print(json.dumps(engine.run_pipeline(a.query, files.read_tree(spark, str(root)), max_tokens=a.max_tokens, intent=a.intent), ensure_ascii=False))
        case "memory":
            show(engine.search_memory(a.query, a.limit).select("memory_score", "kind", "content", "linked_fqns").collect())
        case "skeleton":
            for r in engine.skeleton(a.files, not a.no_docs).orderBy("path").collect():
                print(f"# {r['path']}\n{r['skeleton']}\n")
        case "impact":
            print(json.dumps(engine.impact_graph(a.fqn, a.depth)))
        case "flow":
            print(json.dumps(engine.logic_flow(a.source, a.target)))
        case "activity":
            show(engine.activity(a.limit).select("created_at", "kind", "headline").collect())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
