"""The engine: indexing a source tree and answering ranked, budgeted context queries.

Queries are pure; what the session log should keep is returned or written by explicit
calls (``save_observation``, ``capture``, ``note_warnings``).  ``now`` is a parameter
wherever time matters.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex import schema
from loomdex.functions import intent as I
from loomdex.functions import scalars as S
from loomdex.functions import text as X
from loomdex.operators import detect, diff, graph, memory, pack, rank, resolve
from loomdex.sources import extract, files, store

STALE_INDEX_S = 3600


def _now() -> int:
    return int(time.time())


class Engine:
    """An index in a folder and the operations on it.

    ``encoder`` (texts -> vectors) adds the semantic signal; without one it weighs nothing.
    """

    def __init__(self, spark: SparkSession, root: str, encoder: Callable[[list[str]], list[list[float]]] | None = None, model_name: str = "encoder", budget: int | None = None) -> None:
        self.spark, self.store, self.encoder, self.model_name, self.budget = spark, store.Store(spark, root), encoder, model_name, budget

    # ---- indexing

    def index(self, sources: DataFrame, session_id: str | None = None, now: int | None = None, track: bool = True, paths: DataFrame | None = None) -> dict[str, int]:
        """Bring the index to a state of (path, content); only new and changed files are parsed.

        What is missing from ``sources`` counts as deleted: all indexed files, or those among
        ``paths`` (path) if given.  Deleted files' symbols are logged as removed and make
        observations stale like any other change, in the one commit.  Edges are resolved
        over all symbols each time, so the result equals that of a fresh index.
        """
        now = _now() if now is None else now
        t = self.store.tables()
        current = sources.select("path", F.sha2("content", 256).alias("content_hash"))
        known = t["files"].select("path", "content_hash")
        status = store.stored(diff.manifest(known if paths is None else known.join(paths, "path", "left_semi"), current))
        counts = diff.status_counts(status).first().asDict()
        parse = status.filter(F.col("status").isin("added", "changed"))
        gone = status.filter(F.col("status").isin("changed", "deleted"))
        if not any(counts[k] for k in ("added", "changed", "deleted")):
            return {k: int(v or 0) for k, v in counts.items()} | {"symbols": t["symbols"].count(), "changes": 0}
        parsed = store.stored(extract.parse_files(sources.join(parse, "path", "left_semi")))
        left = store.delete_files(t, gone)
        file_base, sym_base = (t[n].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for n in ("files", "symbols"))
        # numbers needn't be dense: they are fixed by writing the rows, with no global order
        number = lambda base: (F.monotonically_increasing_id() + F.lit(base + 1)).cast("long").alias("id")
        new_files = store.stored(parsed.select(number(file_base), "path", "language", "content_hash", "line_count", "byte_size", F.lit(now).cast("long").alias("indexed_at")))
        own = store.latest(extract.symbols_of(parsed), ["fqn", "start_line"], F.col("end_line").desc(), F.col("body_hash")).join(new_files.select("path", F.col("id").alias("file_id")), "path")
        new_symbols = store.stored(own.select(number(sym_base), *[f.name for f in schema.SYMBOLS if f.name != "id"]))
        tokens = X.tokenize_symbol(F.col("name"), F.col("docstring"), F.col("fqn"))
        tf = rank.term_frequencies(new_symbols.withColumnRenamed("id", "symbol_id"), "symbol_id", tokens).select("term", "symbol_id", "tf")
        # sorted by term, so that a query's terms are found by the files' statistics
        words = rank.postings(new_symbols, "id", rank.SYMBOL_FIELDS, stem=True).sortWithinPartitions("term")
        lengths = rank.text_lengths(new_symbols, "id", rank.SYMBOL_FIELDS, F.size(F.array_distinct(tokens)).cast("long").alias("terms"))
        out = {
            "postings": left["postings"].unionByName(words),
            "text_lengths": left["text_lengths"].unionByName(lengths),
            "files": left["files"].unionByName(new_files),
            "symbols": left["symbols"].unionByName(new_symbols),
            "raw_edges": left["raw_edges"].unionByName(extract.edges_of(parsed)),
            "term_frequencies": left["term_frequencies"].unionByName(tf),
        }
        out["edges"] = store.stored(resolve.resolve_edges(out["raw_edges"], out["symbols"], out["files"]))
        out["centrality"] = graph.pagerank(out["symbols"], out["edges"])
        out["symbol_embeddings"] = left["symbol_embeddings"]
        if self.encoder:
            out["symbol_embeddings"] = out["symbol_embeddings"].unionByName(self._embed(new_symbols, now))
        n_changes = 0
        if track:
            touched = status.filter("status <> 'unchanged'").select("path")
            # of overloads the first stands for all, before and after
            state = lambda s, f: store.latest(s.join(f.select(F.col("id").alias("file_id"), "path"), "file_id").join(touched, "path", "left_semi"), ["fqn"], F.col("start_line"), F.col("body_hash"))
            found = store.stored(diff.resolve_renames(diff.symbol_changes(state(t["symbols"], t["files"]), state(out["symbols"], out["files"]))))
            n_changes = found.count()
            if n_changes:
                base = t["symbol_changes"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
                rows = found.withColumns({"session_id": F.lit(session_id).cast("string"), "detected_at": F.lit(now).cast("long"), "id": number(base)})
                out["symbol_changes"] = t["symbol_changes"].unionByName(diff.correlate(rows, t["observations"], now).select(t["symbol_changes"].columns))
                real = found.filter("change_kind <> 'added'")
                out["observations"] = diff.mark_stale(t["observations"], t["observation_links"], real)
        self.store.commit(**out)
        return {k: int(v or 0) for k, v in counts.items()} | {"symbols": self.store.read("symbols").count(), "changes": n_changes}

    def index_tree(self, root: str, **options) -> dict[str, int]:
        return self.index(files.read_tree(self.spark, root), **options)

    def index_paths(self, root: str, paths: list[str], **options) -> dict[str, int]:
        """Index given paths of a tree; those that are gone are deleted."""
        here = files.read_tree(self.spark, root, paths)
        return self.index(here, paths=self.spark.createDataFrame([(p,) for p in paths], "path string"), **options)

    def reindex(self, sources: DataFrame, now: int | None = None) -> dict[str, int]:
        """A fresh index; session memory stays and no changes are logged."""
        self.store.reset_code()
        return self.index(sources, now=now, track=False)

    def _embed(self, symbols: DataFrame, now: int) -> DataFrame:
        encode, name = self.encoder, self.model_name

        def run(frames):
            import pandas as pd

            for f in frames:
                vectors = [v for i in range(0, len(f), 32) for v in encode(f["text"].iloc[i : i + 32].tolist())]
                yield pd.DataFrame({"symbol_id": f["id"], "embedding": vectors, "model_name": name, "created_at": now})

        text = X.embedding_text(F.col("name"), F.col("signature"), F.col("docstring"))
        return symbols.select("id", F.substring(text, 1, X.EMBEDDING_CHARS).alias("text")).mapInPandas(run, schema.SYMBOL_EMBEDDINGS)

    def embed_missing(self, now: int | None = None) -> int:
        """Vectors for symbols that have none of the present model; how many were made."""
        if not self.encoder:
            return 0
        t = self.store.tables("symbols", "symbol_embeddings")
        have = t["symbol_embeddings"].filter(F.col("model_name") == self.model_name)
        made = store.stored(self._embed(t["symbols"].join(have.select(F.col("symbol_id").alias("id")), "id", "left_anti"), _now() if now is None else now))
        n = made.count()
        if n:
            self.store.commit(symbol_embeddings=have.unionByName(made))
        return n

    def embedding_coverage(self) -> dict[str, float]:
        """Symbols, those with a vector, and their share."""
        t = self.store.tables("symbols", "symbol_embeddings")
        n = t["symbols"].count()
        own = t["symbols"].join(t["symbol_embeddings"].select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi").count()
        return {"symbols": n, "embedded": own, "share": own / n if n else 0.0}

    # ---- queries

    def search(self, query: str, limit: int = 10, intent: str | None = None) -> tuple[DataFrame, bool]:
        """Ranked symbols and whether the search had to be relaxed."""
        t = self.store.tables()
        vector = self.encoder([query])[0] if self.encoder else None
        index = t["postings"], t["text_lengths"]

        def hybrid(n: int) -> DataFrame:
            return rank.search_symbols(t["symbols"], t["files"], t["edges"], t["centrality"], t["term_frequencies"], query, n, I.parse(intent), vector, t["symbol_embeddings"], self.encoder is not None, index)

        def lexical(n: int) -> DataFrame:
            return rank.search_lexical(t["symbols"], t["files"], query, n, index=index)

        return rank.search_relaxed(hybrid, lexical, limit)

    def capsule(self, query: str, sources: DataFrame, max_tokens: int | None = None, intent: str | None = None, session_id: str | None = None, now: int | None = None, hints: bool = False) -> dict:
        """A context capsule within a token budget: pivots, skeletons, memories, recent changes, warnings."""
        now = _now() if now is None else now
        name = I.parse(intent) or I.detect_one(query)
        traits = I.INTENTS[name]
        total = pack.resolve_budget(max_tokens, self.budget)
        share = pack.Budget.split(int(total * pack.CONTENT_SHARE), traits.pivot_share)
        found, relaxed = self.search(query, intent=name)
        found = store.stored(found)
        t = self.store.tables()
        pivots = store.stored(pack.pivot_files(found, sources, share.pivots))
        used = pivots.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        near = graph.expand(t["edges"], found.select("id"), traits.depth)
        bones = pack.skeleton_files(near, t["symbols"], t["files"], pivots, share.rest + share.pivots - used, traits.docs)
        best = [r["fqn"] for r in found.select("fqn").collect()]  # at most a search's limit
        notes = memory.search(t["observations"], t["observation_links"], query, now, pivots=best)
        notes = pack.prefix_pack(notes.withColumn("tokens", X.estimate_tokens(F.col("content"))), share.memory, "tokens", [F.col("memory_score").desc(), F.col("id")])
        warnings = detect.run_all(t["symbol_changes"], t["observations"], now)
        warnings = warnings.filter(F.col("session_id") == session_id) if session_id else warnings.limit(0)
        since = t["sessions"].filter(F.col("id") == session_id).agg(F.min("started_at")).first()[0] if session_id else None
        changes = diff.recent_changes(t["symbol_changes"], found.select("fqn"), since) if since is not None else t["symbol_changes"].limit(0)
        rows = lambda df: [r.asDict(True) for r in df.collect()]  # noqa: E731  every part is within the budget
        n = found.count()
        out = {
            "query": query, "intent": name, "relaxation_applied": relaxed, "candidates": n,
            "pivots": rows(pivots.orderBy("pos").select("path", "content", "symbols")), "skeletons": rows(bones.orderBy("pos").select("path", "skeleton", "depth")),
            "memories": rows(notes.orderBy(F.col("memory_score").desc(), "id").select("id", "kind", "content", "headline", "is_stale", "memory_score", S.relative_time(F.lit(now), F.col("created_at")).alias("age"))),
            "recent_changes": rows(changes.select("symbol_fqn", "change_kind", "old_value", "new_value", "detected_at")), "warnings": rows(warnings.select("rule", "summary", "involved", "severity")),
        }
        out["no_results_reason"] = pack.empty_reason(t["files"].count(), n, relaxed, len(out["pivots"]))
        if hints:
            out["impact_hints"] = rows(self.impact_hints(found))
        out["tokens_budget"] = total
        return pack.trim(out, total)

    def run_pipeline(self, task: str, sources: DataFrame, **options) -> dict:
        return self.capsule(task, sources, hints=True, **options)

    def impact_hints(self, found: DataFrame) -> DataFrame:
        """Callers, callees and blast radius (over unbounded callers) of every result."""
        edges = self.store.read("edges")
        degree = graph.degrees(edges).select("id", F.col("in_degree").alias("direct_callers"), F.col("out_degree").alias("direct_callees"))
        reach = graph.transitive_callers(edges, found)
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return found.select("id", "fqn").join(degree, "id", "left").join(reach, "id", "left").select("fqn", zero("direct_callers"), zero("direct_callees"), zero("callers"), F.coalesce("radius", F.lit("low")).alias("radius"))

    def skeleton(self, paths: list[str], include_docs: bool = True) -> DataFrame:
        t = self.store.tables("files", "symbols")
        wanted = t["files"].filter(F.col("path").isin(paths))
        return pack.skeletons(t["symbols"].join(wanted.select(F.col("id").alias("file_id")), "file_id", "left_semi"), wanted, include_docs)

    def impact_graph(self, fqn: str, depth: int = 3, callers: bool = True, callees: bool = True) -> dict:
        t = self.store.tables("symbols", "files", "edges")
        hit = t["symbols"].filter(F.col("fqn") == fqn).orderBy("id").limit(1).select("id").collect()
        if not hit:
            raise graph.SymbolError("not_found", f"no symbol is named {fqn}")
        near = store.stored(graph.impact(t["edges"], hit[0]["id"], depth, callers, callees))
        n = near.filter("direction = 'caller'").count() if callers else 0
        nodes = near.join(t["symbols"], "id").join(t["files"].select(F.col("id").alias("file_id"), "path"), "file_id").select("fqn", "kind", "path", "depth", "direction")
        radius = "low" if n <= 4 else "medium" if n <= 20 else "high"
        return {"fqn": fqn, "blast_radius": radius, "nodes": [r.asDict() for r in nodes.orderBy("direction", "depth", "fqn").collect()]}

    def logic_flow(self, source: str, target: str, max_paths: int = graph.PATHS) -> dict:
        """The shortest paths between two symbols; bridges where there is none."""
        t = self.store.tables("symbols", "files", "edges", "centrality")
        a, b = graph.resolve_symbol(t["symbols"], source), graph.resolve_symbol(t["symbols"], target)
        if a == b:
            raise graph.SymbolError("same", "source and target are the same symbol")
        k = max(1, min(max_paths, graph.MOST_PATHS))
        ranked = graph.ranked_paths(graph.k_paths(t["edges"], a, b, k), t["centrality"]).collect()
        names = {r["id"]: r["fqn"] for r in t["symbols"].filter(F.col("id").isin([i for r in ranked for i in r["path"]])).select("id", "fqn").collect()}
        paths = [{"path": [names[i] for i in r["path"]], "hops": r["hops"], "centrality": r["total"]} for r in ranked]
        if paths:
            return {"paths": paths, "bridges": []}
        link = graph.bridges(t["edges"], a, b)
        if link.isEmpty():
            link = graph.shared_file_bridges(t["symbols"], a, b, t["edges"])
        return {"paths": [], "bridges": [r.asDict() for r in link.join(t["symbols"], "id").select("fqn", "how").orderBy("fqn").collect()]}

    def search_memory(self, query: str, limit: int = 5, kind: str | None = None, include_stale: bool = False, now: int | None = None, persist: bool = False) -> DataFrame:
        """The best observations; with ``persist`` their scores are kept with them."""
        t = self.store.tables("observations", "observation_links")
        found = memory.search(t["observations"], t["observation_links"], query, _now() if now is None else now, max(1, min(limit, 50)), kind, include_stale)
        if persist:
            found = store.stored(found)
            self.store.commit(observations=memory.persist_scores(t["observations"], found))
            found = found.orderBy(F.col("memory_score").desc(), "id")
        return found

    def session_context(self, count: int = 3, include_compressed: bool = True) -> DataFrame:
        t = self.store.tables("sessions", "observations")
        last = memory.recent_sessions(t["sessions"], max(1, min(count, 20)), include_compressed)
        notes = t["observations"].groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("observation_id"), "kind", "headline", "content"))).alias("observations"))
        return last.join(notes, "id", "left")

    def status(self, now: int | None = None) -> dict:
        now = _now() if now is None else now
        t = self.store.tables()
        counts = {n: t[n].count() for n in ("files", "symbols", "edges", "sessions", "observations", "symbol_changes", "symbol_embeddings")}
        f = t["files"].agg(F.max("indexed_at").alias("newest"), F.sum("byte_size").alias("bytes"), F.array_sort(F.collect_set("language")).alias("languages")).first()
        model = t["symbol_embeddings"].agg(F.min("model_name")).first()[0]
        return {**counts, "newest": f["newest"], "source_bytes": f["bytes"] or 0, "languages": f["languages"], "model": model, "is_stale": f["newest"] is None or now - f["newest"] > STALE_INDEX_S}

    # ---- session memory

    def start_session(self, now: int | None = None) -> str:
        now, ident = _now() if now is None else now, str(uuid.uuid4())
        new = self.spark.createDataFrame([(ident, now, now, False, None, None, None)], schema.SESSIONS)
        self.store.append(sessions=new)
        return ident

    def save_observation(self, session_id: str, content: str, kind: str = "manual", headline: str | None = None, links: list[str] = (), now: int | None = None) -> int:
        memory.check_observation(content, kind)
        now = _now() if now is None else now
        t = self.store.tables("observations", "observation_links", "sessions")
        ident = t["observations"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        row = self.spark.createDataFrame([(ident, session_id, kind, content, headline, 2, False, now, None)], schema.OBSERVATIONS)
        linked = self.spark.createDataFrame([(ident, f) for f in dict.fromkeys(links)], schema.OBSERVATION_LINKS)
        self.store.append(observations=row, **({"observation_links": linked} if links else {}))
        self.store.commit(sessions=memory.touch(t["sessions"], session_id, now))
        return ident

    def capture(self, session_id: str, tool: str, result: str, intent: str | None = None, query: str | None = None, pivots: list[str] = (), now: int | None = None) -> int | None:
        """Note a tool call as an automatic observation; some tools' calls are not noted."""
        if tool in S.UNCAPTURED:
            return None
        row = self.spark.createDataFrame([(tool, intent, query, result, list(pivots))], "t string, i string, q string, r string, p array<string>")
        made = row.select(S.capture_headline(F.col("t"), F.col("i"), F.col("q"), F.col("r")).alias("h"), S.capture_content(F.col("t"), F.col("i"), F.col("q"), F.col("r"), F.col("p")).alias("c")).first()
        return self.save_observation(session_id, made["c"], "auto", made["h"], pivots, now)

    def note_warnings(self, now: int | None = None) -> int:
        """Run the detectors and note warnings that their session hasn't had yet; how many."""
        now = _now() if now is None else now
        t = self.store.tables("symbol_changes", "observations")
        found = detect.run_all(t["symbol_changes"], t["observations"], now).filter("session_id is not null")
        rows = store.stored(detect.as_observations(detect.unseen(found, t["observations"]), now))
        n = rows.count()
        if n:
            base = t["observations"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            rows = rows.withColumns({"id": (F.monotonically_increasing_id() + F.lit(base + 1)).cast("long"), "score": F.lit(None).cast("double")})
            self.store.append(observations=rows.select(t["observations"].columns))
        return n

    def compress_sessions(self, now: int | None = None, idle: int = memory.IDLE_S) -> int:
        t = self.store.tables("sessions", "observations", "observation_links")
        before = t["sessions"].filter("is_compressed").count()
        sessions, observations = memory.compress(t["sessions"], t["observations"], t["observation_links"], _now() if now is None else now, idle)
        self.store.commit(sessions=sessions, observations=observations)
        return self.store.read("sessions").filter("is_compressed").count() - before

    def activity(self, limit: int = 20) -> DataFrame:
        return memory.recent_activity(self.store.read("observations"), limit)
