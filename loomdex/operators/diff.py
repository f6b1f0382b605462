"""Differences between snapshots: files, symbols, renames, and what they make stale."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions import scalars as S

#: Unpaired symbols of one kind in a file above which no renames are looked for.
MOST_PER_SIDE = 200


def manifest(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status): added, changed, deleted or unchanged, from (path, content_hash) of both sides."""
    a, b = indexed.select("path", F.col("content_hash").alias("old")), current.select("path", F.col("content_hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def status_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("added", "changed", "deleted", "unchanged")])


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(symbol_fqn, file_path, change_kind, old_value, new_value): one change per symbol.

    A changed signature goes before changed visibility, that before a changed body.
    Rows need fqn, path, signature, is_exported and body_hash, unique by fqn.
    """
    cols = ("path", "signature", "is_exported", "body_hash")
    a = before.select("fqn", *[F.col(c).alias("a_" + c) for c in cols], F.lit(True).alias("had"))
    b = after.select("fqn", *[F.col(c).alias("b_" + c) for c in cols], F.lit(True).alias("has"))
    j = a.join(b, "fqn", "full_outer")
    moved = lambda c: ~F.col("a_" + c).eqNullSafe(F.col("b_" + c))
    kind = (
        F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed")
        .when(moved("signature"), "signature_changed").when(moved("is_exported"), "visibility_changed").when(moved("body_hash"), "body_changed")
    )
    value = lambda p: F.when(F.col("change_kind") == "signature_changed", F.col(p + "signature")).when(F.col("change_kind") == "visibility_changed", S.visibility(F.col(p + "is_exported"))).when(F.col("change_kind") == "body_changed", F.col(p + "body_hash"))
    out = j.withColumn("change_kind", kind).filter("change_kind is not null")
    old = F.coalesce(value("a_"), F.when(F.col("change_kind") == "removed", F.col("a_signature")))
    new = F.coalesce(value("b_"), F.when(F.col("change_kind") == "added", F.col("b_signature")))
    return out.select(F.col("fqn").alias("symbol_fqn"), F.coalesce("b_path", "a_path").alias("file_path"), "change_kind", old.alias("old_value"), new.alias("new_value"))


def rename_candidates(changes: DataFrame, most: int = 3) -> DataFrame:
    """(file_path, old_fqn, new_fqn) of removed and added symbols of a file with similar names."""
    gone = changes.filter("change_kind = 'removed'").select("file_path", F.col("symbol_fqn").alias("old_fqn"))
    come = changes.filter("change_kind = 'added'").select("file_path", F.col("symbol_fqn").alias("new_fqn"))
    return gone.join(come, "file_path").filter(S.is_rename(S.short_name(F.col("old_fqn")), S.short_name(F.col("new_fqn")), most))


def resolve_renames(changes: DataFrame, most_per_side: int = MOST_PER_SIDE) -> DataFrame:
    """``changes`` with similar removed and added symbols of a file paired, each at most once, in order of names."""
    sides = changes.filter(F.col("change_kind").isin("removed", "added")).groupBy("file_path").agg(*[F.sum((F.col("change_kind") == k).cast("long")).alias(k) for k in ("removed", "added")])
    small = sides.filter((F.col("removed") <= most_per_side) & (F.col("added") <= most_per_side)).select("file_path")
    pairs = rename_candidates(changes.join(small, "file_path", "left_semi"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs in order, each with names that its file's earlier ones left; files follow one another, so that none takes a call."""
        at, gone, come = None, set(), set()
        for b in batches:
            keep = []
            for path, old, new in zip(*(b.column(c).to_pylist() for c in ("file_path", "old_fqn", "new_fqn")), strict=True):
                if path != at:
                    at, gone, come = path, set(), set()
                keep.append(old not in gone and new not in come)
                if keep[-1]:
                    gone.add(old)
                    come.add(new)
            yield b.filter(pa.array(keep, pa.bool_()))

    chosen = pairs.repartition("file_path").sortWithinPartitions("file_path", "old_fqn", "new_fqn").mapInArrow(greedy, pairs.schema)
    renamed = chosen.select(F.col("new_fqn").alias("symbol_fqn"), "file_path", F.lit("renamed").alias("change_kind"), F.col("old_fqn").alias("old_value"), F.col("new_fqn").alias("new_value"))
    gone = chosen.select("file_path", F.col("old_fqn").alias("symbol_fqn"), F.lit("removed").alias("change_kind"))
    come = chosen.select("file_path", F.col("new_fqn").alias("symbol_fqn"), F.lit("added").alias("change_kind"))
    rest = changes.join(gone.unionByName(come), ["file_path", "symbol_fqn", "change_kind"], "left_anti")
    return rest.select(renamed.columns).unionByName(renamed)


def mark_stale(observations: DataFrame, links: DataFrame, changes: DataFrame) -> DataFrame:
    """``observations``, stale where a symbol that they are linked to changed."""
    fqns = changes.select("symbol_fqn").unionByName(changes.filter("change_kind = 'renamed'").select(F.col("old_value").alias("symbol_fqn"))).distinct()
    hit = links.join(fqns, "symbol_fqn", "left_semi").select(F.col("observation_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    return observations.join(hit, "id", "left").withColumn("is_stale", F.col("is_stale") | F.coalesce("_hit", F.lit(False))).select(observations.columns)


def newly_stale(before: DataFrame, after: DataFrame) -> int:
    return after.filter("is_stale").join(before.filter("is_stale"), "id", "left_anti").count()


def recent_changes(changes: DataFrame, fqns: DataFrame, since: int, limit: int = 20) -> DataFrame:
    return changes.join(fqns.select(F.col("fqn").alias("symbol_fqn")).distinct(), "symbol_fqn", "left_semi").filter(F.col("detected_at") >= since).orderBy(F.col("detected_at").desc(), F.col("id").desc()).limit(limit)


def correlate(changes: DataFrame, observations: DataFrame, now: int, window: int = 120) -> DataFrame:
    """``changes`` with the session's latest automatic observation of the last two minutes."""
    recent = observations.filter((F.col("kind") == "auto") & (F.col("created_at") >= now - window)).groupBy("session_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("correlated_observation_id"))
    return changes.drop("correlated_observation_id").join(recent, "session_id", "left")
