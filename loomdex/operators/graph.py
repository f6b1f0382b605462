"""Graph operators over an edge table (src, dst, kind).

Frontiers and labels stay DataFrames; every level is written to the shared folder, so
plans don't grow with depth and a lost executor costs one level.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.scalars import blast_radius
from loomdex.sources.store import stored

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-9
PATHS, MOST_PATHS = 3, 5
#: Edges and nodes up to which PageRank runs in one task (some 30 MB); above, every round is a join.
SMALL = 200_000


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree); parallel edges count."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _pagerank_task(ids: DataFrame, edges: DataFrame, damping: float, rounds: int, tolerance: float | None, scale: bool) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        name = np.sort(group.loc[group["dst"].isna(), "src"].to_numpy(np.int64))
        e = group[group["dst"].notna()]
        a, b = np.searchsorted(name, e["src"].to_numpy(np.int64)), np.searchsorted(name, e["dst"].to_numpy(np.int64))
        n, out = len(name), np.bincount(a, minlength=len(name))
        r = np.full(n, 1.0 / n)
        for _round in range(rounds):
            gained = np.bincount(b, weights=r[a] / out[a], minlength=n)
            new = (1 - damping) / n + damping * (gained + r[out == 0].sum() / n)
            moved, r = np.abs(new - r).max(), new
            if tolerance is not None and moved <= tolerance:
                break
        return pd.DataFrame({"id": name, "centrality": r / (r.max() if scale else 1.0)})

    rows = ids.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(edges.select("src", "dst"))
    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "id long, centrality double")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, scale: bool = True, small: int = SMALL) -> DataFrame:
    """(id, centrality): PageRank with dangling mass spread evenly, divided by its maximum.

    A round is one join and one aggregate on pre-weighted edges plus one scalar (the
    dangling mass); it ends early once no rank moves by more than ``tolerance``.
    Graphs of a checked small size go through the same rounds within one task.
    """
    ids = stored(nodes.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("centrality", F.lit(0.0))
    if n <= small and edges.limit(small + 1).count() <= small:
        return _pagerank_task(ids, edges, damping, rounds, tolerance, scale)
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = stored(edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("w")))
    flags = stored(ids.join(out.select(F.col("src").alias("id"), F.lit(False).alias("sink")), "id", "left").select("id", F.coalesce("sink", F.lit(True)).alias("sink")))
    ranks = flags.withColumn("r", F.lit(1.0 / n))
    for _ in range(rounds):
        lost = ranks.agg(F.sum(F.when(F.col("sink"), F.col("r")).otherwise(0.0))).first()[0]
        gained = weighted.join(ranks.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("g"))
        new = ranks.join(gained, "id", "left").select("id", "sink", F.col("r").alias("old"), ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.lit(lost) / n)).alias("r"))
        new = stored(new)
        ranks = new.select("id", "sink", "r")
        if tolerance is not None and new.agg(F.max(F.abs(F.col("r") - F.col("old")))).first()[0] <= tolerance:
            break
    top = ranks.agg(F.max("r")).first()[0] if scale else 1.0
    return ranks.select("id", (F.col("r") / F.lit(top or 1.0)).alias("centrality"))


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (a, b) in the direction of travel: out (callees), in (callers) or both."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


#: Starts that a search of a small graph takes in one task; each may reach all of its nodes.
STARTS = 64


def _bfs_task(steps: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        after = defaultdict(list)
        real = group[group["b"].notna()]
        for a, b in zip(real["a"].tolist(), real["b"].tolist(), strict=True):
            after[int(a)].append(int(b))
        out = []
        for start in group.loc[group["b"].isna(), "a"].tolist():
            seen, level, far = {int(start)}, [int(start)], 0
            while level and (depth is None or far < depth):
                far += 1
                level = [b for b in dict.fromkeys(b for a in level for b in after[a]) if b not in seen]
                seen.update(level)
                out += [(int(start), b, far) for b in level]
        return pd.DataFrame(out, columns=["start", "id", "depth"], dtype="int64")

    rows = steps.unionByName(starts.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b")))
    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "start long, id long, depth int")


def bfs(edges: DataFrame, starts: DataFrame, direction: str = "both", depth: int | None = None, small: int = SMALL) -> DataFrame:
    """(start, id, depth) of what each start (column id) reaches, at its least depth; starts left out.

    All starts travel at once; ``depth`` None goes on until nothing new is found.  A few
    starts in a graph of a checked small size are followed within one task.  In a larger one
    only what a level reaches is made distinct, never the edges themselves, which may repeat.
    """
    edges = stored(edges.select("src", "dst").dropna())
    ways = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    frontier = starts.select(F.col("id").alias("start"), "id").distinct()
    seen = stored(frontier.withColumn("depth", F.lit(0)))
    room = small // len(ways)
    if edges.limit(room + 1).count() <= room and seen.limit(STARTS + 1).count() <= STARTS:
        steps = _directed(edges, direction)
        return _bfs_task(steps.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), seen.select(F.col("id").cast("long").alias("id")), depth)
    level, frontier = 0, seen
    while depth is None or level < depth:
        level += 1
        steps = [frontier.join(edges, frontier["id"] == edges[a]).select("start", F.col(b).alias("id")) for a, b in ways]
        reached = (steps[0].unionByName(steps[1]) if len(steps) > 1 else steps[0]).distinct()
        frontier = stored(reached.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def expand(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(id, depth): the neighbourhood of several starts together, starts left out, least depth kept."""
    near = bfs(edges, starts, "both", depth).groupBy("id").agg(F.min("depth").alias("depth"))
    return near.join(starts.select("id"), "id", "left_anti")


def transitive_callers(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, callers, radius): how many nodes reach each start, however far away."""
    found = bfs(edges, starts, "in", None).filter("start <> id").groupBy(F.col("start").alias("id")).agg(F.count("*").alias("callers"))
    out = starts.select("id").distinct().join(found, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return out.withColumn("radius", blast_radius(F.col("callers")))


def impact(edges: DataFrame, start: int, depth: int = 3, callers: bool = True, callees: bool = True) -> DataFrame:
    """(id, depth, direction) around one node, within a depth of at most 10."""
    depth = max(1, min(depth, 10))
    one = edges.sparkSession.createDataFrame([(start,)], "id long")
    parts = [bfs(edges, one, way, depth).select("id", "depth", F.lit(name).alias("direction")) for way, name, wanted in (("in", "caller", callers), ("out", "callee", callees)) if wanted]
    out = parts[0] if parts else edges.sparkSession.createDataFrame([], "id long, depth int, direction string")
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def _yen(after: dict[int, list[int]], source: int, target: int, k: int) -> list[list[int]]:
    """The k shortest loopless paths, equal lengths in order of their ids; ``after`` has ascending neighbours."""
    before = defaultdict(list)
    for a, bs in after.items():
        for b in bs:
            before[b].append(a)

    def shortest(start: int, shut: set[int], cut: set[int]) -> list[int] | None:
        """The least of the shortest paths from ``start``, without nodes of ``shut`` and first steps to ``cut``."""
        far, level = {target: 0}, [target]
        while level:  # distances to the target that don't lead through the start
            nxt = []
            for b in level:
                for a in before[b]:
                    if a not in far and a not in shut and a != start:
                        far[a] = far[b] + 1
                        nxt.append(a)
            level = nxt
        steps = [b for b in after.get(start, ()) if b in far and b not in cut]
        if not steps:
            return None
        path = [start, min(steps, key=lambda b: (far[b], b))]
        while path[-1] != target:
            path.append(min(b for b in after[path[-1]] if far.get(b, -1) == far[path[-1]] - 1))
        return path

    if source == target:
        return []
    first = shortest(source, set(), set())
    found, waiting = ([first] if first else []), []
    while found and len(found) < k:
        last = found[-1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            cut = {p[i + 1] for p in found if p[: i + 1] == root and len(p) > i + 1}
            spur = shortest(last[i], set(root[:-1]), cut)
            if spur and (path := root[:-1] + spur) not in waiting and path not in found:
                waiting.append(path)
        if not waiting:
            break
        waiting.sort(key=lambda p: (len(p), p))
        found.append(waiting.pop(0))
    return found


def k_paths(edges: DataFrame, source: int, target: int, k: int = PATHS, small: int = SMALL) -> DataFrame:
    """(path, hops) of the k shortest loopless paths of any length, equal lengths in order of their ids.

    If the edges, or those between nodes that the source reaches and that reach the target,
    are few (counted first), one task deviates from each path found in turn (Yen 1971).
    Else partial paths are extended level by level under a bound on the length, which grows
    until k paths have arrived or nothing was held back by it.
    """
    spark = edges.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "id long")
    steps = stored(_directed(edges, "out").filter("a <> b"))
    shape = "path array<long>, hops int"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        after = defaultdict(list)
        for a, b in group.sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
            after[int(a)].append(int(b))
        paths = _yen(after, source, target, k)
        return pd.DataFrame({"path": pd.Series(paths, dtype=object), "hops": pd.Series([len(p) - 1 for p in paths], dtype="int32")})

    in_one = lambda df: df.select("a", "b", F.lit(1).alias("all")).groupBy("all").applyInPandas(run, shape).orderBy("hops", "path")
    if steps.limit(small + 1).count() <= small:
        return in_one(steps)
    dist = bfs(edges, one(target), "in", None, small).select(F.col("id").alias("b"), "depth").unionByName(spark.createDataFrame([(target, 0)], "b long, depth int"))
    dist = stored(dist.groupBy("b").agg(F.min("depth").alias("depth")))
    ahead = bfs(edges, one(source), "out", None, small).select(F.col("id").alias("a")).unionByName(spark.createDataFrame([(source,)], "a long")).distinct()
    useful = stored(steps.join(dist, "b").join(ahead, "a", "left_semi"))
    if useful.limit(small + 1).count() <= small:
        return in_one(useful)
    start = dist.filter(F.col("b") == source).agg(F.min("depth")).first()[0]
    out = spark.createDataFrame([], shape)
    bound = start
    while bound is not None:
        paths, arrived, held_back = spark.createDataFrame([([source],)], "path array<long>"), [], None
        for level in range(1, bound + 1):
            last = F.element_at("path", -1)
            longer = paths.join(useful, last == F.col("a")).filter(~F.array_contains("path", F.col("b")))
            longer = stored(longer.select(F.concat("path", F.array("b")).alias("path"), (F.lit(level) + F.col("depth")).alias("least")))
            beyond = longer.filter(F.col("least") > bound).agg(F.min("least")).first()[0]
            held_back = min(x for x in (held_back, beyond) if x is not None) if beyond is not None or held_back is not None else None
            paths = longer.filter((F.col("least") <= bound) & (F.element_at("path", -1) != target)).select("path")
            arrived.append(longer.filter((F.col("least") <= bound) & (F.element_at("path", -1) == target)).select("path"))
            if paths.isEmpty():
                break
        out = arrived[0]
        for more in arrived[1:]:
            out = out.unionByName(more)
        out = stored(out.withColumn("hops", F.size("path") - 1).orderBy("hops", "path").limit(k))
        bound = held_back if out.count() < k else None
    return out.orderBy("hops", "path")


def ranked_paths(paths: DataFrame, centrality: DataFrame) -> DataFrame:
    """Paths with the sum of their nodes' centrality, by hops and then centrality."""
    each = paths.select("path", "hops", F.explode("path").alias("id")).join(centrality, "id", "left")
    total = each.groupBy("path", "hops").agg(F.sum(F.coalesce("centrality", F.lit(0.0))).alias("total"))
    return total.orderBy("hops", F.col("total").desc(), "path")


def bridges(edges: DataFrame, one: int, two: int, most: int = 5) -> DataFrame:
    """(id, how) of nodes that both call, or that call both; a node that does both counts as called."""
    def common(a: str, b: str, how: str) -> DataFrame:
        side = lambda x: edges.filter(F.col(a) == x).select(F.col(b).alias("id"))
        return side(one).intersect(side(two)).withColumn("how", F.lit(how))

    both = common("src", "dst", "called by both").unionByName(common("dst", "src", "calls both"))
    both = both.filter(~F.col("id").isin(one, two))
    return both.groupBy("id").agg(F.min("how").alias("how")).orderBy("id").limit(most)


def shared_file_bridges(symbols: DataFrame, one: int, two: int, edges: DataFrame, most: int = 5) -> DataFrame:
    """Other symbols of files that hold neighbours of both, where nothing else bridges them."""
    def files(x: int) -> DataFrame:
        near = edges.filter((F.col("src") == x) | (F.col("dst") == x)).select(F.when(F.col("src") == x, F.col("dst")).otherwise(F.col("src")).alias("id")).unionByName(edges.sparkSession.createDataFrame([(x,)], "id long"))
        return symbols.join(near, "id", "left_semi").select("file_id")

    shared = files(one).intersect(files(two))
    return symbols.join(shared, "file_id", "left_semi").filter(~F.col("id").isin(one, two)).select("id", F.lit("shared file").alias("how")).orderBy("id").limit(most)


def resolve_names(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, found, id, outcome) of short names: ``ok`` with the one symbol's id, ``not_found`` or ``ambiguous``."""
    have = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    found = F.coalesce("n", F.lit(0))
    outcome = F.when(found == 0, "not_found").when(found > 1, "ambiguous").otherwise("ok")
    return wanted.join(have, "name", "left").select("name", found.alias("found"), F.when(found == 1, F.col("id")).alias("id"), outcome.alias("outcome"))


class SymbolError(ValueError):
    """A name that can't be resolved: ``same``, ``not_found`` or ``ambiguous``."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def resolve_symbol(symbols: DataFrame, name: str) -> int:
    """The id of a symbol by its full name, or by its short name where that is unique."""
    exact = symbols.filter(F.col("fqn") == name).orderBy("id").limit(1).select("id").collect()
    if exact:
        return exact[0]["id"]
    short = symbols.filter(F.col("name") == name).orderBy("id").limit(2).select("id").collect()
    if not short:
        raise SymbolError("not_found", f"no symbol is named {name}")
    if len(short) > 1:
        raise SymbolError("ambiguous", f"several symbols are named {name}")
    return short[0]["id"]
