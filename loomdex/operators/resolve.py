"""Resolving call names to symbols: same file, then exported, then any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_edges(raw: DataFrame, symbols: DataFrame, files: DataFrame, parity: bool = False, include_imports: bool = False) -> DataFrame:
    """(src, dst, kind) from (path, from_fqn, to_name, kind).

    All symbols are known beforehand, so the result doesn't depend on the order of files;
    ``parity`` admits only targets in files that come no later, as a first incremental
    pass would.  Among overloads the last declared stands for its full name.  Names
    without a symbol are dropped, and so are edges from files themselves (imports, calls
    at top level) unless ``include_imports`` links them to their file's negative id.
    """
    own = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    origin = own.groupBy("fqn").agg(F.max_by("id", F.struct("start_line", "id")).alias("src")).withColumnRenamed("fqn", "from_fqn")
    if include_imports:
        origin = origin.unionByName(files.select(F.col("path").alias("from_fqn"), (-F.col("id")).alias("src")))
    edges = raw.join(origin, "from_fqn").select("src", "to_name", "kind", "path").distinct()
    target = own.select(F.col("name").alias("to_name"), F.col("id").alias("dst"), F.col("path").alias("dst_path"), "is_exported")
    if parity:
        return _no_later(edges, target)
    # a name's best target of each sort first, one row each, so that no join multiplies rows of a common name
    near = target.groupBy("to_name", F.col("dst_path").alias("path")).agg(F.min("dst").alias("near"))
    far = target.groupBy("to_name").agg(F.min(F.when(F.col("is_exported"), F.col("dst"))).alias("open"), F.min("dst").alias("any"))
    best = edges.join(far, "to_name").join(near, ["to_name", "path"], "left")
    return best.select("src", F.coalesce("near", "open", "any").alias("dst"), "kind").distinct()


def _no_later(edges: DataFrame, target: DataFrame) -> DataFrame:
    """The same among targets in files that come no later: running minima along the paths of a name's targets and edges."""
    open_ = F.when(F.col("is_exported"), F.col("dst"))
    rows = target.groupBy("to_name", F.col("dst_path").alias("path")).agg(F.min("dst").alias("near"), F.min(open_).alias("open"))
    rows = rows.unionByName(edges.select("to_name", "path").distinct(), allowMissingColumns=True).groupBy("to_name", "path").agg(F.min("near").alias("near"), F.min("open").alias("open"))
    along = W.partitionBy("to_name").orderBy("path").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("to_name", "path", "near", F.min("open").over(along).alias("open"), F.min("near").over(along).alias("any"))
    best = edges.join(rows, ["to_name", "path"]).select("src", F.coalesce("near", "open", "any").alias("dst"), "kind")
    return best.filter("dst is not null").distinct()


def prioritised(left: DataFrame, right: DataFrame, key: str, priority, ident: str, *group: str) -> DataFrame:
    """Of several partners the one of least priority, then least ``ident``, per group."""
    w = W.partitionBy(*group).orderBy(priority, ident)
    return left.join(right, key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
