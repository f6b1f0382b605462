"""Packing into a token budget: prefixes, first fit, skeletons, trimming."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.functions import text as X

CONTAINERS = tuple("class enum interface module namespace struct trait".split())
DEFAULT_BUDGET, MOST_BUDGET = 10_000, 50_000
CONTENT_SHARE = 0.8


def resolve_budget(asked: int | None, configured: int | None = None) -> int:
    """A call's budget, at most ``MOST_BUDGET``; else the configured one (0: without limit); else the default."""
    if asked is not None:
        return min(asked, MOST_BUDGET)
    if configured is not None:
        return configured if configured > 0 else 2**62
    return DEFAULT_BUDGET


@dataclass(frozen=True)
class Budget:
    memory: int
    pivots: int
    rest: int

    @staticmethod
    def split(total: int, pivot_share: float) -> Budget:
        memory = min(total // 10, 500)
        left = total - memory
        pivots = int(left * pivot_share)
        return Budget(memory, pivots, left - pivots)


def budget_shares(asked: Column, pivot_share: float, default: int = DEFAULT_BUDGET) -> Column:
    """``resolve_budget`` and ``Budget.split`` for a column of calls: a struct of memory, pivots and rest."""
    total = F.floor(F.when(asked.isNull(), F.lit(default)).otherwise(F.least(asked, F.lit(MOST_BUDGET))) * CONTENT_SHARE)
    memory = F.least(F.floor(total / 10), F.lit(500))
    pivots = F.floor((total - memory) * pivot_share)
    return F.struct(memory.alias("memory"), pivots.alias("pivots"), (total - memory - pivots).alias("rest"))


def prefix_pack(rows: DataFrame, budget: int, tokens: str, order: list, group: list[str] = ()) -> DataFrame:
    """Rows in order as long as all so far fit: it stops at the first that doesn't."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(w)).filter(F.col("used") <= budget)


def first_fit(items: Column, budget: int) -> Column:
    """Of an ordered array of structs with ``tokens``, those that fit when one that doesn't is passed over."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter(items, lambda x: F.lit(False)).alias("kept"))
    step = lambda acc, x: F.when(acc["used"] + x["tokens"] <= budget, F.struct((acc["used"] + x["tokens"]).alias("used"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    return F.aggregate(items, start, step)["kept"]


def pack_first_fit(rows: DataFrame, budget: int, tokens: str, order: list[Column], *columns: str, group: list[str] = ()) -> DataFrame:
    """``rows`` that first fit takes, with pos: groups are folded whole, so they must be candidate sets of bounded size."""
    n = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    numbered = rows.withColumn("pos", n)
    entry = F.struct(F.col("pos"), F.col(tokens).cast("long").alias("tokens"), *[F.col(c) for c in columns])
    kept = numbered.groupBy(*group).agg(first_fit(F.array_sort(F.collect_list(entry)), budget).alias("kept"))
    return kept.select(*group, F.explode("kept").alias("k")).select(*group, "k.*")


def stream_first_fit(rows: DataFrame, budget: int, tokens: str, order: list[str], group: list[str]) -> DataFrame:
    """``rows`` that first fit takes from groups of any size (without ``group`` of all): each is read once in order, and only the used sum is held."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = None, 0
        for b in batches:
            keep = []
            keys = zip(*(b.column(g).to_pylist() for g in group), strict=True) if group else [()] * b.num_rows
            for key, n in zip(keys, b.column(tokens).to_pylist(), strict=True):
                if key != at:
                    at, used = key, 0
                keep.append(used + n <= budget)
                used += n if keep[-1] else 0
            yield b.filter(pa.array(keep, pa.bool_()))

    fits = rows.filter(F.col(tokens) <= budget)  # what is larger is passed over and changes nothing
    return (fits.repartition(*group) if group else fits.repartition(1)).sortWithinPartitions(*group, *order).mapInArrow(take, rows.schema)


def pivot_paths(results: DataFrame, sizes: DataFrame, budget: int, chars_per_token: float = X.CHARS_PER_TOKEN) -> DataFrame:
    """(path, best, tokens, pos) of the files that first fit takes, best first, from (path, byte_size): no content is read."""
    best = results.groupBy("path").agg(F.max("score").alias("best"))
    files = best.join(sizes.select("path", X.tokens_of_bytes(F.col("byte_size"), chars_per_token).alias("tokens")), "path")
    return stream_first_fit(files.withColumn("pos", F.row_number().over(W.orderBy(F.col("best").desc(), "path"))), budget, "tokens", ["pos"], [])


def pivot_files(results: DataFrame, sources: DataFrame, budget: int, chars_per_token: float = X.CHARS_PER_TOKEN) -> DataFrame:
    """(path, content, tokens, symbols, best): whole files of the results, best first, first fit.

    The files are chosen by their sizes; contents and symbols are fetched for those only.
    """
    chosen = pivot_paths(results, sources.select("path", F.octet_length(F.coalesce("content", F.lit(""))).alias("byte_size")), budget, chars_per_token)
    by = results.join(chosen.select("path"), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "fqn", "kind", "score", "why"))).alias("symbols"))
    by = by.withColumn("symbols", F.transform("symbols", lambda s: F.struct(s["fqn"].alias("fqn"), s["kind"].alias("kind"), s["score"].alias("score"), s["why"].alias("why"))))
    # by the hint, contents never pass through the driver, however small they are taken to be
    return sources.select("path", "content").join(chosen.join(by, "path").hint("merge"), "path").select("pos", "tokens", "path", "content", "symbols", "best")


def contained(symbols: DataFrame) -> DataFrame:
    """Ids of symbols that lie within a container of their file."""
    outer = symbols.filter(F.col("kind").isin(*CONTAINERS)).select("file_id", F.col("id").alias("o_id"), F.col("start_line").alias("o_start"), F.col("end_line").alias("o_end"))
    inside = (F.col("o_start") <= F.col("start_line")) & (F.col("end_line") <= F.col("o_end")) & (F.col("o_id") != F.col("id"))
    return symbols.join(outer, "file_id").filter(inside).select("id").distinct()


def skeletons(symbols: DataFrame, files: DataFrame, include_docs: bool = True, chars_per_token: float = X.CHARS_PER_TOKEN) -> DataFrame:
    """(path, skeleton, tokens, symbol_count, line_count): a file's signatures in order, members indented."""
    member = contained(symbols).withColumn("inner", F.lit(True))
    own = symbols.join(member, "id", "left").join(files.select(F.col("id").alias("file_id"), "path", "line_count"), "file_id")
    indent = F.when(F.coalesce("inner", F.lit(False)), "  ").otherwise("")
    line = F.concat(indent, F.coalesce(F.when(F.col("signature") != "", F.col("signature")), F.concat_ws(" ", "kind", "name")))
    docs = F.transform(F.split(F.col("docstring"), "\n"), lambda d: F.concat(indent, F.lit("/// "), d))
    text = F.when(F.lit(include_docs) & F.col("docstring").isNotNull() & (F.col("docstring") != ""), F.concat(F.array_join(docs, "\n"), F.lit("\n"), line)).otherwise(line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", text.alias("text")))), lambda x: x["text"])
    out = own.groupBy("path", "line_count").agg(F.array_join(lines, "\n").alias("skeleton"), F.count("*").alias("symbol_count"))
    return out.withColumn("tokens", X.estimate_tokens(F.col("skeleton"), chars_per_token))


def skeleton_files(near: DataFrame, symbols: DataFrame, files: DataFrame, pivots: DataFrame, budget: int, include_docs: bool = False) -> DataFrame:
    """Skeletons of the files around the pivots, nearest first, first fit; ``near`` is (id, depth)."""
    where = near.join(symbols.select("id", "file_id"), "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("path").agg(F.min("depth").alias("depth"))
    where = where.join(pivots.select("path"), "path", "left_anti")
    wanted = files.join(where.select("path"), "path", "left_semi")
    made = skeletons(symbols.join(wanted.select(F.col("id").alias("file_id")), "file_id", "left_semi"), wanted, include_docs).join(where, "path")
    return pack_first_fit(made, budget, "tokens", [F.col("depth"), F.col("path")], "path", "skeleton", "depth", "symbol_count")


def empty_reason(files: int, candidates: int, relaxed: bool, pivots: int) -> str | None:
    """Why a capsule has no pivots; None if it has."""
    if pivots:
        return None
    if not files:
        return "The index holds no files: index the workspace first."
    if not candidates:
        return "Nothing matched the query: try broader terms, or check that the files in question are indexed."
    return "Too little matched even after relaxation: try other terms." if relaxed else "No symbol matched the query."


def trim(capsule: dict, budget: int, chars_per_token: float = X.CHARS_PER_TOKEN) -> dict:
    """A capsule (one nested row on the driver) cut down until its JSON fits.

    First go skeletons, the farthest first; then memories, the least relevant first; then
    warnings and recent changes; at last the content of pivots, the lowest ranked first.
    """
    import json

    def size() -> int:
        return -(-int(len(json.dumps(capsule, separators=(",", ":"), ensure_ascii=False).encode()) * 10) // int(chars_per_token * 10))

    capsule = {**capsule, **{k: list(capsule.get(k) or []) for k in ("pivots", "skeletons", "memories", "warnings", "recent_changes")}}
    capsule["skeletons"].sort(key=lambda s: (s.get("depth", 0), s.get("path", "")))
    for part in ("skeletons", "memories"):
        while capsule[part] and size() > budget:
            capsule[part].pop()
    if size() > budget:
        capsule["warnings"], capsule["recent_changes"] = [], []
    for p in reversed(range(len(capsule["pivots"]))):
        if size() <= budget:
            break
        capsule["pivots"][p] = {**capsule["pivots"][p], "content": "[left out: over budget]"}
    capsule["tokens_used"] = size()
    return capsule

