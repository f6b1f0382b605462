"""Streaming: the watcher's debounce, incremental indexing, streaming detectors, tailing a log."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.scalars import query_of
from loomdex.operators.detect import CIRCULAR, SIMILAR, THRASHING, WINDOW_S
from loomdex.operators.rank import text_tf

log = logging.getLogger(__name__)

#: A row per file event; a file source only tells of new files, so changes and deletions are rows of a log.
EVENTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("op", T.StringType()), T.StructField("ts", T.TimestampType())])
DEBOUNCE = "500 milliseconds"
IGNORED = tuple(f"{d}/" for d in "bin build dist node_modules target .git".split())


def debounce(events: DataFrame, ts: str = "ts", gap: str = DEBOUNCE, *keys: str) -> DataFrame:
    """Bursts of events: a window closes once nothing came for ``gap``.  Works on tables and, with a watermark, on streams."""
    return events.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(F.count("*").alias("n"))


def pattern_to_regex(pattern: str) -> str:
    """An ignore pattern as a regular expression on paths relative to the root (negations aside)."""
    directory, p = pattern.endswith("/"), pattern.rstrip("/")
    anchored = "/" in p
    p, out, i = p.lstrip("/"), "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (p[i] if p[i].isalnum() or p[i] in "_/" else "\\" + p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if directory else "(?:/|$)")


def wanted_paths(path: Column, extensions: list[str], patterns: list[str] = IGNORED) -> Column:
    """Paths of supported languages that no pattern excludes; later patterns win, ``!`` takes paths back in."""
    ignored = F.lit(False)
    for p in patterns:
        ignored = F.when(path.rlike(pattern_to_regex(p.removeprefix("!"))), F.lit(not p.startswith("!"))).otherwise(ignored)
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1)).isin(list(extensions)) & ~ignored


def latest_ops(batch: DataFrame) -> DataFrame:
    """(path, op): what became of each path in a batch, by its last event."""
    return batch.groupBy("path").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))


def watch(events: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None):
    """Start a query that hands each micro-batch's changed paths to ``on_batch``.

    The checkpoint makes it at least once: a batch whose action fails comes again, so
    actions must bear repetition (writing a snapshot does).
    """

    def act(batch: DataFrame, number: int) -> None:
        changed = latest_ops(batch)
        if not changed.isEmpty():
            on_batch(changed, number)

    writer = events.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def index_changes(engine, root: str, ignore: str = ".gitignore", now: Callable[[], int] | None = None, session_id: str | None = None) -> Callable[[DataFrame, int], None]:
    """What the watcher does with a batch of changed paths: index them, note warnings, embed what is new.

    Indexing brings files, symbols, edges and centrality up to date in one commit; a path
    that is gone is deleted.  The tree's ignore file is read again for every batch.  A step
    that fails after the indexing is logged, and the next batch makes up for it.
    """
    from pathlib import Path

    from loomdex.sources.extract import BY_EXTENSION

    def act(changed: DataFrame, number: int) -> None:
        file = Path(root, ignore)
        lines = [x.strip() for x in file.read_text().splitlines()] if file.exists() else []
        patterns = [*IGNORED, *(x for x in lines if x and not x.startswith("#"))]
        paths = [r["path"] for r in changed.filter(wanted_paths(F.col("path"), list(BY_EXTENSION), patterns)).select("path").collect()]  # one batch's
        if not paths:
            return
        when = now() if now else None
        engine.index_paths(root, paths, session_id=session_id, now=when)
        for step in (engine.note_warnings, engine.embed_missing):
            try:
                step(now=when)
            except Exception:
                log.exception("after batch %s: %s failed", number, step.__name__)

    return act


def dead_end_stream(changes: DataFrame, window: int = WINDOW_S, delay: str = "10 minutes") -> DataFrame:
    """The dead-end rule on a stream of changes (ts a timestamp): an interval join bounded by watermarks."""
    gap = F.expr(f"interval {window} seconds")
    a = changes.filter("change_kind = 'added'").select("session_id", F.col("symbol_fqn").alias("fqn"), F.col("ts").alias("t0")).withWatermark("t0", delay)
    b = changes.filter("change_kind = 'removed'").select("symbol_fqn", F.col("ts").alias("t1")).withWatermark("t1", delay)
    return a.join(b, (F.col("fqn") == F.col("symbol_fqn")) & (F.col("t1") > F.col("t0")) & (F.col("t1") < F.col("t0") + gap)).select("session_id", "symbol_fqn", "t0", "t1")


def thrashing_stream(changes: DataFrame, window: str = "300 seconds", slide: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Files with many changes in a sliding window; windows approximate the batch rule's trailing one to a slide."""
    n = changes.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "session_id", "file_path").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= THRASHING)


def circular_stream(searches: DataFrame, window: int = WINDOW_S, idle: str = "10 minutes") -> DataFrame:
    """The circular-search rule on a stream of (session_id, kind, content, ts).

    Each session's state holds the current run of similar queries only: its length, its
    first query, and the latest query's term counts and time.  A manual note, a gap of
    more than the window, or a query that is too different begins a new run; a run is
    told once, when it reaches the rule's length.
    """
    out = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("n", T.IntegerType())])
    state_type = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("at", T.DoubleType())])

    def step(key, frames, state):
        n, first, last, at = state.get if state.exists else (0, "", "", 0.0)
        told = []
        rows = pd.concat(list(frames)).sort_values("ts")
        for kind, query, ts in rows[["kind", "query", "ts"]].itertuples(index=False):
            now = ts.timestamp()
            if kind == "manual":
                n = 0
            elif query:
                near = n and now - at <= window and _cosine(text_tf(last), text_tf(query)) >= SIMILAR
                n, first = (n + 1, first) if near else (1, query)
                last, at = query, now
                if n == CIRCULAR:
                    told.append((key[0], first, n))
        state.update((n, first, last, at))
        yield pd.DataFrame(told, columns=["session_id", "query", "n"])

    rows = searches.select("session_id", "kind", F.coalesce(query_of(F.col("content")), F.lit("")).alias("query"), "ts").withWatermark("ts", idle)
    return rows.groupBy("session_id").applyInPandasWithState(step, out, state_type, "append", "NoTimeout")


def _cosine(a: dict[str, float], b: dict[str, float]) -> float:
    dot = sum(v * b.get(t, 0.0) for t, v in a.items())
    norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return dot / norm if norm else 0.0


def keyset_page(rows: DataFrame, at: str, ident: str, after: int, after_id: int, limit: int) -> DataFrame:
    """The next rows after a position (time, id), in that order."""
    later = (F.col(at) > after) | ((F.col(at) == after) & (F.col(ident) > after_id))
    return rows.filter(later).orderBy(at, ident).limit(limit)


def tail(rows: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second"):
    """Follow an append-only log: every new row once, in order within its batch."""
    return rows.writeStream.foreachBatch(lambda b, n: on_batch(b.orderBy("created_at", "id"), n)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
