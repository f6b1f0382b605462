"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and bucket of a hash of the document's id; from the
histogram follows the bucket in which a source's budget ends; only that bucket is
refined, twice, and what lies below the threshold is taken.  Nothing is sorted but
the few rows of one refined bucket per source, and a larger budget takes a superset.

A source's target is weight-proportional ("water filling"): no source gets more than
``most`` times its size, and what it cannot take is shared by weight among the rest.
With target / size = c + f, every document is taken c times whole and the part of
documents with hash up to the threshold once more.

Cases: a null text has size 0 and is taken 0 times; null sources form one source,
ranked last; a null id hashes like the word null; repeated rows are taken alike; a
source of size 0 has target 0; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex.llm import common as C

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash that each of the two histogram levels tells apart.
BITS = 12
#: Rows of the table of sources up to which it is sent to every task (some 100 bytes each).
SMALL = 50_000


def sizes(docs: DataFrame, text: str, ident: str, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, h): words in the text, and a 48-bit hash of the id; columns to ``keep`` as a struct _kept."""
    kept = [F.struct(*[docs[f"`{c}`"] for c in keep]).alias("_kept")] if keep else []
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(ident).cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("long")
    return docs.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"), *kept)


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row per source, by water filling."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("w", w)
    every = W.partitionBy()
    cap = F.col("source_size") * F.lit(float(most))
    # in rising order of cap / weight: if the first k are full, the level for the others is this
    before = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    out = ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    out = out.withColumn("full", F.coalesce(F.sum(cap).over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    out = out.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    fits = F.col("level") * F.col("w") <= cap
    out = out.withColumn("settled", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("w"), F.col("level")))).over(every)["level"])
    target = F.when(F.col("settled").isNull(), cap).otherwise(F.least(cap, F.col("settled") * F.col("w")))
    return out.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row, and _kept with columns to ``keep``; taken = copies * size."""
    slim = C.stored(sizes(docs, text, ident, source, keep))
    top = F.shiftright("h", 48 - BITS)
    bucket = C.stored(slim.groupBy("source", top.alias("b")).agg(F.sum("size").alias("s")))
    goal = C.stored(targets(bucket.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, most))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    small = goal.limit(SMALL + 1).count() <= SMALL
    send = F.broadcast if small else (lambda df: df)

    def edge(hist: DataFrame, have: list[str], by: str) -> DataFrame:
        """Per source the bucket in which its budget ends, and what lies below it."""
        upto = F.sum("s").over(W.partitionBy("source").orderBy(by))
        run = hist.withColumn("upto", upto + F.col("base"))
        first = F.min(F.struct(by, (F.col("upto") - F.col("s")).alias("base")))
        return run.filter(F.col("upto") > F.col("left")).groupBy("source", *have).agg(first.alias("e")).select("source", *have, F.col(f"e.{by}").alias(by), F.col("e.base").alias("base"))

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    budget = goal.select("source", "left")
    joined = lambda a, b: a.join(send(b), same(a, b)).drop(b["source"])
    one = C.stored(edge(joined(bucket.withColumn("base", F.lit(0)), budget), [], "b"))
    inside = joined(slim.select("source", "size", "h"), one).filter(top == F.col("b"))
    two_hist = inside.groupBy("source", "b", F.shiftright("h", 48 - 2 * BITS).alias("c"), "base").agg(F.sum("size").alias("s"))
    two = C.stored(edge(joined(two_hist, budget), ["b"], "c"))
    last = joined(slim.select("source", "size", "h"), two).filter(F.shiftright("h", 48 - 2 * BITS) == F.col("c"))
    last = last.groupBy("source", "h", "base").agg(F.sum("size").alias("s"))
    # documents with a hash below `stop` are taken once more
    stop = edge(joined(last, budget), [], "h").select("source", F.col("h").alias("stop"))
    plan = C.stored(goal.join(stop, goal["source"].eqNullSafe(stop["source"]), "left").select(goal["source"], "source_size", "target", "whole", "left", "stop"))
    full = slim.join(send(plan), slim["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    extra = (F.col("left") > 0) & (F.col("stop").isNull() | (F.col("h") < F.col("stop")))
    copies = F.col("whole") + extra.cast("long")
    return full.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["_kept"] if keep else []))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


_RANKED = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE"
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {_RANKED} AS w FROM s),
c AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER p, 0.0) AS full_,
         sum(w) OVER () - coalesce(sum(w) OVER p, 0.0) AS rest
  FROM w WINDOW p AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - full_) / rest AS level FROM c),
t AS (
  SELECT source, source_size,
         least(source_size * 2.0::DOUBLE, w * coalesce((SELECT level FROM l WHERE level * w <= source_size * 2.0::DOUBLE ORDER BY source_size / w, level LIMIT 1), 1e300)) AS target
  FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
u AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS left_,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN left_ > 0 AND upto <= left_ THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM u
"""
