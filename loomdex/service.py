"""The engine's ten operations as tools over JSON-RPC 2.0, a message a line (the stdio transport of the Model Context Protocol).

A session begins with the first call.  Calls are noted as automatic observations (some
tools' aren't, see ``scalars.UNCAPTURED``); a note that can't be made is logged and the
answer given all the same.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import IO, Any

from loomdex.functions import scalars as S
from loomdex.operators import graph
from loomdex.plans.engine import Engine
from loomdex.sources import files

log = logging.getLogger(__name__)

PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602


class BadParams(ValueError):
    """Arguments that a tool can't take."""


@dataclass(frozen=True)
class Tool:
    """A tool: its arguments by name as (JSON type, required, description), and what it does."""

    description: str
    arguments: dict[str, tuple[str, bool, str]]
    call: Callable[[Service, dict], Any]

    def schema(self) -> dict:
        kinds = {"strings": {"type": "array", "items": {"type": "string"}}}
        properties = {n: {**kinds.get(kind, {"type": kind}), "description": text} for n, (kind, _, text) in self.arguments.items()}
        return {"type": "object", "properties": properties, "required": [n for n, (_, needed, _) in self.arguments.items() if needed]}

    def checked(self, given: dict) -> dict:
        """The arguments, if they are what the schema asks for."""
        kinds = {"string": str, "integer": int, "boolean": bool, "strings": list}
        for name, (kind, needed, _) in self.arguments.items():
            value = given.get(name)
            if value is None:
                if needed:
                    raise BadParams(f"{name} is missing")
                continue
            wrong = not isinstance(value, kinds[kind]) or kind == "integer" and isinstance(value, bool) or kind == "strings" and not all(isinstance(x, str) for x in value)
            if wrong:
                raise BadParams(f"{name} must be of type {kind}")
            if needed and kind == "string" and not value.strip():
                raise BadParams(f"{name} is empty")
        return {k: v for k, v in given.items() if k in self.arguments and v is not None}


def _rows(df) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def _capsule(service: Service, a: dict, hints: bool) -> dict:
    tree = files.read_tree(service.engine.spark, service.root)
    return service.engine.capsule(a.get("query") or a["task"], tree, a.get("max_tokens"), a.get("intent"), service.session, hints=hints)


_QUERY = {"max_tokens": ("integer", False, "budget of the answer"), "intent": ("string", False, "debug, test, refactor, modify, understand or explore")}
TOOLS = {
    "run_pipeline": Tool("Context for a task: capsule and impact in one", {"task": ("string", True, "what is to be done"), **_QUERY}, lambda s, a: _capsule(s, a, True)),
    "get_context_capsule": Tool("Pivot files, skeletons and memories for a query", {"query": ("string", True, "what is looked for"), **_QUERY}, lambda s, a: _capsule(s, a, False)),
    "get_skeleton": Tool("Signatures of files", {"files": ("strings", True, "paths"), "include_docs": ("boolean", False, "with documentation")}, lambda s, a: _rows(s.engine.skeleton([f.replace("\\", "/") for f in a["files"]], a.get("include_docs", True)).orderBy("path"))),
    "get_impact_graph": Tool("Callers and callees of a symbol", {"symbol_fqn": ("string", True, "full name"), "depth": ("integer", False, "levels, at most 10"), "direction": ("string", False, "callers, callees or both")}, lambda s, a: s.engine.impact_graph(a["symbol_fqn"], a.get("depth", 3), a.get("direction") != "callees", a.get("direction") != "callers")),
    "search_logic_flow": Tool("Call paths between two symbols", {"from_symbol": ("string", True, "full or short name"), "to_symbol": ("string", True, "full or short name"), "max_paths": ("integer", False, "at most 5")}, lambda s, a: s.engine.logic_flow(a["from_symbol"], a["to_symbol"], a.get("max_paths", graph.PATHS))),
    "search_memory": Tool("Observations that fit a query", {"query": ("string", True, "what is looked for"), "max_results": ("integer", False, "at most 50"), "kind": ("string", False, "only of this kind"), "include_stale": ("boolean", False, "also what has changed since")}, lambda s, a: _rows(s.engine.search_memory(a["query"], a.get("max_results", 5), a.get("kind"), a.get("include_stale", False), persist=True))),
    "save_observation": Tool("Note something for later", {"content": ("string", True, "the note"), "kind": ("string", False, "insight, decision, error or manual"), "headline": ("string", False, "in short"), "symbols": ("strings", False, "full names it is about")}, lambda s, a: {"id": s.engine.save_observation(s.session, a["content"], a.get("kind", "manual"), a.get("headline"), a.get("symbols", []))}),
    "get_session_context": Tool("Recent sessions and their notes", {"count": ("integer", False, "at most 20"), "include_compressed": ("boolean", False, "also compressed ones")}, lambda s, a: _rows(s.engine.session_context(a.get("count", 3), a.get("include_compressed", True)))),
    "index_status": Tool("What the index holds", {}, lambda s, a: s.engine.status() | s.engine.embedding_coverage()),
    "reindex": Tool("Build the index anew", {}, lambda s, a: s.engine.reindex(files.read_tree(s.engine.spark, s.root))),
}


class Service:
    """Answers messages about one workspace."""

    def __init__(self, engine: Engine, root: str) -> None:
        self.engine, self.root, self.session = engine, root, None

    def handle(self, message: Any) -> dict | None:
        """The answer to a message; None to a notification."""
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return self._error(None, INVALID_REQUEST, "not a request")
        if "id" not in message:
            return None
        ident, params = message["id"], message.get("params") or {}
        match message["method"]:
            case "initialize":
                info = {"name": "loomdex", "version": "0.2"}
                return self._result(ident, {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": info})
            case "ping":
                return self._result(ident, {})
            case "tools/list":
                return self._result(ident, {"tools": [{"name": n, "description": t.description, "inputSchema": t.schema()} for n, t in TOOLS.items()]})
            case "tools/call":
                return self._call(ident, params.get("name"), params.get("arguments") or {})
            case other:
                return self._error(ident, NO_METHOD, f"no method {other}")

    def _call(self, ident: Any, name: str, given: dict) -> dict:
        tool = TOOLS.get(name)
        if tool is None:
            return self._error(ident, BAD_PARAMS, f"no tool {name}")
        try:
            arguments = tool.checked(given)
        except BadParams as e:
            return self._error(ident, BAD_PARAMS, str(e))
        try:
            if self.session is None:
                self.session = self.engine.start_session()
            found = tool.call(self, arguments)
        except ValueError as e:  # a name that can't be resolved, a note that isn't one
            return self._result(ident, {"content": [{"type": "text", "text": str(e)}], "isError": True})
        self._note(name, arguments, found)
        return self._result(ident, {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False, default=str, separators=(",", ":"))}], "isError": False})

    def _note(self, name: str, arguments: dict, found: Any) -> None:
        if name in S.UNCAPTURED:
            return
        n = len(found) if isinstance(found, list) else len(found.get("pivots") or found.get("nodes") or found.get("paths") or ())
        pivots = [s["fqn"] for p in (found.get("pivots", ()) if isinstance(found, dict) else ()) for s in p["symbols"]]
        try:
            self.engine.capture(self.session, name, f"{n} results", found.get("intent") if isinstance(found, dict) else None, arguments.get("query") or arguments.get("task"), pivots)
            self.engine.note_warnings()
        except Exception:
            log.exception("the call of %s isn't noted", name)

    @staticmethod
    def _result(ident: Any, value: dict) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "result": value}

    @staticmethod
    def _error(ident: Any, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": text}}


def serve(service: Service, source: IO[str], sink: IO[str]) -> None:
    """Answer every line of ``source`` on ``sink`` until it ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            answer = service.handle(json.loads(line))
        except json.JSONDecodeError as e:
            answer = Service._error(None, PARSE_ERROR, str(e))
        if answer is not None:
            sink.write(json.dumps(answer, ensure_ascii=False) + "\n")
            sink.flush()
