"""Index storage: shared scratch tables, snapshots with an atomic pointer, keyed writes."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdex import schema


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; in a local session without it, in a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_loomdex_scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark._loomdex_scratch = "file://" + tempfile.mkdtemp(prefix="loomdex-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread by keys over a number of tasks that isn't lowered when they are few in bytes, for what takes far more time than reading."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order (what an upsert leaves)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with those rows of ``new`` whose key it lacks (insert or ignore)."""
    fresh = new.dropDuplicates(keys).join(old, keys, "left_anti")
    return old.unionByName(fresh.select(old.columns))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with the same key (insert or replace)."""
    return old.join(new, keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The code tables without what belongs to the given paths: files, symbols, and all that hangs on these."""
    gone_files = tables["files"].join(paths.select("path"), "path", "left_semi").select("id")
    gone = tables["symbols"].join(gone_files.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select("id")
    by = lambda c: gone.withColumnRenamed("id", c)
    return {
        **tables,
        "files": tables["files"].join(paths.select("path"), "path", "left_anti"),
        "symbols": tables["symbols"].join(gone, "id", "left_anti"),
        "edges": tables["edges"].join(by("src"), "src", "left_anti").join(by("dst"), "dst", "left_anti").select(tables["edges"].columns),
        "raw_edges": tables["raw_edges"].join(paths.select("path"), "path", "left_anti"),
        "term_frequencies": tables["term_frequencies"].join(by("symbol_id"), "symbol_id", "left_anti").select(tables["term_frequencies"].columns),
        "symbol_embeddings": tables["symbol_embeddings"].join(by("symbol_id"), "symbol_id", "left_anti"),
        **{n: tables[n].join(gone, "id", "left_anti").select(tables[n].columns) for n in ("centrality", "postings", "text_lengths") if n in tables},
    }


class Store:
    """Tables of an index in a folder.

    A table is a list of snapshots, all of which make it up.  Writing makes a new one, which
    replaces the others (``commit``) or joins them (``append``), and then moves the pointer.
    A writer changes the entries of its own tables only, in the pointer as it then stands,
    so writers of different tables don't undo each other; there should be one for each table.
    """

    #: Snapshots of a table above which an append rewrites it.
    PARTS = 32

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.path = pafs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        self.fs.create_dir(self.path, recursive=True)

    def _pointer(self) -> dict:
        try:
            with self.fs.open_input_stream(f"{self.path}/_current.json") as f:
                now = json.loads(f.read())
        except FileNotFoundError:
            return {"schema_version": schema.SCHEMA_VERSION, "tables": {}}
        now["tables"] = {n: [x] if isinstance(x, str) else x for n, x in now["tables"].items()}  # of earlier versions
        return now

    def read(self, name: str) -> DataFrame:
        parts = self._pointer()["tables"].get(name)
        if not parts:
            return self.spark.createDataFrame([], schema.TABLES[name])
        return self.spark.read.schema(schema.TABLES[name]).parquet(*[f"{self.root}/{p}" for p in parts])

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.read(n) for n in names or schema.TABLES}

    def _written(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        if self._pointer()["schema_version"] > schema.SCHEMA_VERSION:
            raise ValueError("the index was written by a later version")
        tag, made = uuid.uuid4().hex, {}
        for name, df in tables.items():
            shape = schema.TABLES[name]
            made[name] = f"{name}-{tag}"
            df.select([F.col(f.name).cast(f.dataType) for f in shape]).write.parquet(f"{self.root}/{made[name]}")
        return made

    def _point(self, change: Callable[[dict[str, list[str]]], None]) -> None:
        now = self._pointer()
        change(now["tables"])
        now["schema_version"] = schema.SCHEMA_VERSION
        draft = f"{self.path}/_current.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(now).encode())
        self.fs.move(draft, f"{self.path}/_current.json")

    def commit(self, **tables: DataFrame) -> None:
        """Write tables in place of the present ones, then point to them all at once."""
        made = self._written(tables)
        self._point(lambda t: t.update({n: [p] for n, p in made.items()}))

    def append(self, **rows: DataFrame) -> None:
        """Write rows beside those that the tables have, all at once."""
        made = self._written(rows)
        self._point(lambda t: t.update({n: [*t.get(n, []), p] for n, p in made.items()}))
        full = {n: self.read(n) for n, parts in self._pointer()["tables"].items() if n in rows and len(parts) > self.PARTS}
        if full:
            self.commit(**full)

    def vacuum(self, older_than: float = 86_400.0) -> list[str]:
        """Delete snapshots that no table is made of and that were written so many seconds ago; which they were."""
        used = {p for parts in self._pointer()["tables"].values() for p in parts}
        gone = []
        for f in self.fs.get_file_info(pafs.FileSelector(self.path)):
            known = f.base_name.rpartition("-")[0] in schema.TABLES and f.type == pafs.FileType.Directory
            if known and f.base_name not in used and time.time() - (f.mtime_ns or 0) / 1e9 >= older_than:
                self.fs.delete_dir(f.path)
                gone.append(f.base_name)
        return gone

    def reset_code(self) -> None:
        """Empty the code tables; sessions, observations and changes stay."""
        self.commit(**{n: self.spark.createDataFrame([], schema.TABLES[n]) for n in schema.CODE_TABLES})
