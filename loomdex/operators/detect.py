"""Detectors of unproductive activity, in batch; each returns (session_id, rule, summary, involved, severity)."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.functions.scalars import query_of
from loomdex.sources.store import stored

log = logging.getLogger(__name__)

WINDOW_S = 300
THRASHING = 4
CIRCULAR, SIMILAR, LOOK_BACK = 3, 0.7, 20
DEAD_ENDS = 100


def dead_end_pairs(changes: DataFrame, window: int = WINDOW_S, first: str = "added", then: str = "removed", key: str = "symbol_fqn", at: str = "detected_at", kind: str = "change_kind") -> DataFrame:
    """Pairs of a ``first`` and a later ``then`` of the same key, less than ``window`` apart.

    Only the two kinds are kept before the join, which is an equi-join on the key and the
    time in steps of ``window``: a row meets its own step's and the next one's rows of its
    key, however many the key has.
    """
    step = F.floor(F.col(at) / window)
    a = changes.filter(F.col(kind) == first).select(key, F.col(at).alias("t0"), F.explode(F.array(step, step + 1)).alias("_step"), *[c for c in ("session_id",) if c in changes.columns])
    b = changes.filter(F.col(kind) == then).select(key, F.col(at).alias("t1"), step.alias("_step"))
    return a.join(b, [key, "_step"]).drop("_step").filter((F.col("t1") > F.col("t0")) & (F.col("t1") - F.col("t0") < window))


def dead_ends(changes: DataFrame, observations: DataFrame, now: int, window: int = WINDOW_S) -> DataFrame:
    found = dead_end_pairs(changes, window).filter(F.col("t0") > now - window).select("session_id", "symbol_fqn").distinct()
    found = found.withColumn("_n", F.row_number().over(W.partitionBy("session_id").orderBy("symbol_fqn"))).filter(F.col("_n") <= DEAD_ENDS)
    names = F.array_sort(F.collect_list("symbol_fqn"))
    out = found.groupBy("session_id").agg(names.alias("involved"))
    said = F.concat(F.size("involved").cast("string"), F.lit(" symbol(s) added then removed within the detection window: "), F.array_join(F.slice("involved", 1, 5), ", "))
    return _rows(out.withColumn("summary", said), "dead_end", "warning")


def thrashing(changes: DataFrame, observations: DataFrame, now: int, window: int = WINDOW_S) -> DataFrame:
    n = changes.filter(F.col("detected_at") > now - window).groupBy("session_id", "file_path").agg(F.count("*").alias("n")).filter(F.col("n") >= THRASHING)
    said = F.format_string("File '%s' has %d structural changes within the detection window", "file_path", "n")
    return _rows(n.select("session_id", F.array("file_path").alias("involved"), said.alias("summary")), "file_thrashing", "warning")


def tf_cosine(a: Column, b: Column) -> Column:
    """Cosine of the term counts of two token arrays; 0 if one is empty."""
    # both arrays of counts run over the same words in a fixed order
    words = F.array_sort(F.array_distinct(F.concat(a, b)))
    of = lambda t: F.transform(words, lambda w: F.size(F.filter(t, lambda x: x == w)).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(of(a), of(a)) * dot(of(b), of(b)))
    return F.when(norm > 0, dot(of(a), of(b)) / norm).otherwise(0.0)


def similar_runs(items: DataFrame, session: str, order: list[str], tokens: str, similar: float = SIMILAR) -> DataFrame:
    """Runs of consecutive similar rows (gaps and islands): ``items`` with run, a number within its session."""
    w = W.partitionBy(session).orderBy(*order)
    apart = F.when(F.col("_before").isNull() | (tf_cosine(F.col("_before"), F.col(tokens)) < similar), 1).otherwise(0)
    out = items.withColumn("_before", F.lag(tokens).over(w)).withColumn("_apart", apart)
    return out.withColumn("run", F.sum("_apart").over(w)).drop("_before", "_apart")


def circular_searches(changes: DataFrame, observations: DataFrame, now: int, window: int = WINDOW_S) -> DataFrame:
    newest = W.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    last = observations.filter(F.col("created_at") > now - window).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= LOOK_BACK)
    # whatever is older than the newest manual note is out
    cut = last.withColumn("_cut", F.max((F.col("kind") == "manual").cast("int")).over(newest)).filter("_cut = 0")
    asked = cut.withColumn("query", query_of(F.col("content"))).filter("query is not null").withColumn("tokens", X.tokenize_text(F.col("query")))
    runs = similar_runs(asked, "session_id", ["created_at", "id"], "tokens")
    runs = runs.groupBy("session_id", "run").agg(F.count("*").alias("n"), F.min_by("query", F.struct("created_at", "id")).alias("query"))
    best = runs.groupBy("session_id").agg(F.max_by(F.struct("n", "query"), F.struct("n", -F.col("run"))).alias("b")).select("session_id", "b.*").filter(F.col("n") >= CIRCULAR)
    said = F.format_string("%d similar consecutive searches detected (e.g., '%s')", "n", "query")
    return _rows(best.select("session_id", F.array().cast("array<string>").alias("involved"), said.alias("summary")), "circular_search", "info")


def _rows(df: DataFrame, rule: str, severity: str) -> DataFrame:
    return df.select("session_id", F.lit(rule).alias("rule"), "summary", "involved", F.lit(severity).alias("severity"))


@dataclass(frozen=True)
class Rule:
    """A detector: (changes, observations, now) -> rows."""

    name: str
    description: str
    detect: Callable[[DataFrame, DataFrame, int], DataFrame]


RULES = (
    Rule("dead_end", "symbols added and soon removed", dead_ends),
    Rule("file_thrashing", "files changed again and again", thrashing),
    Rule("circular_search", "the same search over and over", circular_searches),
)


def run_all(changes: DataFrame, observations: DataFrame, now: int, rules=RULES) -> DataFrame:
    """What all rules find; a rule that fails is logged and left out.  Each rule's few rows are stored as it runs."""
    out = changes.sparkSession.createDataFrame([], "session_id string, rule string, summary string, involved array<string>, severity string")
    for r in rules:
        try:
            out = out.unionByName(stored(r.detect(changes, observations, now)))
        except Exception:
            log.exception("the detector %s failed", r.name)
    return out


def unseen(warnings: DataFrame, observations: DataFrame) -> DataFrame:
    """Warnings of rules that the session hasn't a warning of yet (noted as ``[rule] summary``)."""
    noted = observations.filter("kind = 'warning'").select("session_id", F.regexp_extract("content", "^\\[([^\\]]+)\\]", 1).alias("rule")).distinct()
    return warnings.join(noted, ["session_id", "rule"], "left_anti")


def as_observations(warnings: DataFrame, now: int) -> DataFrame:
    """One warning of each rule and session as an observation without id."""
    one = warnings.groupBy("session_id", "rule").agg(F.min("summary").alias("summary"))
    return one.select("session_id", F.lit("warning").alias("kind"), F.concat(F.lit("["), "rule", F.lit("] "), "summary").alias("content"), F.col("summary").alias("headline"), F.lit(2).alias("detail_level"), F.lit(False).alias("is_stale"), F.lit(now).cast("long").alias("created_at"))
