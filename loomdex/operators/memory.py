"""Session memory: search, compression, sessions and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions import scalars as S
from loomdex.functions import text as X
from loomdex.operators import rank as R

WEIGHTS = {"bm25": 0.35, "tfidf": 0.25, "recency": 0.20, "proximity": 0.15}
STALE = 0.30
HALF_LIFE_DAYS = 7.0
KINDS = tuple("auto decision error insight manual".split())
IDLE_S = 86_400
KEY_TERMS = 20
CONTENT_BYTES = 64 * 1024


def recency(now: Column, then: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), F.greatest(now - then, F.lit(0)) / 86400.0 / max(half_life, 1e-9))


def memory_score(bm25: Column, tfidf: Column, recency_: Column, proximity: Column, stale: Column) -> Column:
    total = F.lit(WEIGHTS["bm25"]) * bm25 + F.lit(WEIGHTS["tfidf"]) * tfidf + F.lit(WEIGHTS["recency"]) * recency_ + F.lit(WEIGHTS["proximity"]) * proximity
    return F.greatest(total - F.when(stale, STALE).otherwise(0.0), F.lit(0.0))


def search(observations: DataFrame, links: DataFrame, query: str, now: int, limit: int = 5, kind: str | None = None, include_stale: bool = False, exclude_auto: bool | None = None, pivots: list[str] = (), half_life: float = HALF_LIFE_DAYS, stem: bool = True) -> DataFrame:
    """The best observations for a query; automatic ones are left out before the candidate limit unless a kind is asked for."""
    skip_auto = exclude_auto if exclude_auto is not None else kind is None
    pool = observations.filter("kind <> 'auto'") if skip_auto else observations
    found = R.top_k(R.bm25(pool, "id", R.MEMORY_FIELDS, query, stem=stem), R.MEMORY_CANDIDATES, "bm25", "id")
    found = found.withColumn("bm25", R.min_max(F.col("bm25")))  # stale ones still count here
    own = found.join(pool, "id")
    if not include_stale:
        own = own.filter(~F.col("is_stale"))
    tf = R.term_frequencies(own, "id", X.tokenize_text(F.col("content")))
    own = own.join(R.plain_cosine(tf, "id", R.text_tf(query)), "id", "left")
    linked = links.withColumnRenamed("observation_id", "id").join(found.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("symbol_fqn")).alias("linked_fqns"), F.avg(F.col("symbol_fqn").isin(list(pivots)).cast("double")).alias("proximity"))
    own = own.join(linked, "id", "left")
    score = memory_score(F.col("bm25"), F.coalesce("tfidf", F.lit(0.0)), recency(F.lit(now), F.col("created_at"), half_life), F.coalesce("proximity", F.lit(0.0)), F.col("is_stale"))
    own = own.withColumn("memory_score", score)
    if kind:
        own = own.filter(F.col("kind") == kind)
    empty = F.array().cast("array<string>")
    return own.orderBy(F.col("memory_score").desc(), "id").limit(limit).select(*observations.columns, "memory_score", F.coalesce("linked_fqns", empty).alias("linked_fqns"))


def persist_scores(observations: DataFrame, results: DataFrame) -> DataFrame:
    """``observations`` with the scores of a search's results."""
    new = results.select("id", F.col("memory_score").alias("_s"))
    return observations.join(F.broadcast(new), "id", "left").withColumn("score", F.coalesce("_s", "score")).select(observations.columns)  # as many rows as the search returned


def key_terms(rows: DataFrame, session: str, tokens: Column, k: int = KEY_TERMS) -> DataFrame:
    """(session, key_terms): the most frequent terms, most frequent first, ties in order of terms."""
    n = rows.select(session, F.explode(tokens).alias("term")).groupBy(session, "term").agg(F.count("*").alias("n"))
    top = n.withColumn("_r", F.row_number().over(W.partitionBy(session).orderBy(F.col("n").desc(), "term"))).filter(F.col("_r") <= k)
    return top.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]), ",").alias("key_terms"))


def compress(sessions: DataFrame, observations: DataFrame, links: DataFrame, now: int, idle: int = IDLE_S) -> tuple[DataFrame, DataFrame]:
    """Sessions idle for longer get key terms, key files and a summary and lose their automatic observations."""
    due = sessions.filter((~F.col("is_compressed")) & (F.col("last_active") < now - idle)).select(F.col("id").alias("session_id"))
    own = observations.join(due, "session_id", "left_semi")
    terms = key_terms(own, "session_id", X.tokenize_text(F.col("content")))
    files = own.select(F.col("id").alias("observation_id"), "session_id").join(links, "observation_id").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set(S.file_of(F.col("symbol_fqn")))), ",").alias("key_files"))
    heads = own.filter("headline is not null").groupBy("session_id", "headline").agg(F.min("id").alias("first"))
    heads = heads.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "headline"))), lambda x: x["headline"]), "; ").alias("summary"))
    made = due.join(terms, "session_id", "left").join(files, "session_id", "left").join(heads, "session_id", "left")
    made = made.select(F.col("session_id").alias("id"), *[F.coalesce(c, F.lit("")).alias("_" + c) for c in ("summary", "key_terms", "key_files")], F.lit(True).alias("_due"))
    out = sessions.join(made, "id", "left")
    out = out.withColumns({"is_compressed": F.col("is_compressed") | F.coalesce("_due", F.lit(False)), **{c: F.coalesce("_" + c, c) for c in ("summary", "key_terms", "key_files")}})
    left = observations.join(due.withColumn("_due", F.lit(True)), "session_id", "left").filter(~(F.coalesce("_due", F.lit(False)) & (F.col("kind") == "auto")))
    return out.select(sessions.columns), left.select(observations.columns)


def recent_sessions(sessions: DataFrame, count: int = 3, include_compressed: bool = True) -> DataFrame:
    pool = sessions if include_compressed else sessions.filter("not is_compressed")
    return pool.orderBy(F.col("last_active").desc(), F.col("id")).limit(count)


def session_observations(observations: DataFrame, session_id: str) -> DataFrame:
    return observations.filter(F.col("session_id") == session_id).orderBy(F.col("created_at").desc(), F.col("id").desc())


def recent_activity(observations: DataFrame, limit: int = 20) -> DataFrame:
    """The newest observations, in the order in which they were made."""
    newest = observations.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return newest.orderBy("created_at", "id")


def touch(sessions: DataFrame, session_id: str, now: int) -> DataFrame:
    return sessions.withColumn("last_active", F.when(F.col("id") == session_id, F.lit(now).cast("long")).otherwise(F.col("last_active")))


def check_observation(content: str, kind: str) -> None:
    if not content.strip():
        raise ValueError("an observation needs content")
    if len(content.encode()) > CONTENT_BYTES:
        raise ValueError(f"an observation holds at most {CONTENT_BYTES} bytes")
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}: one of {', '.join(KINDS)}")
