"""Source trees as tables of (path, content)."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.sources.extract import BY_EXTENSION
from loomdex.streaming.watch import pattern_to_regex

MOST_BYTES = 1 << 20
OWN_FOLDER = ".loomdex"


def workspace_root(start: str) -> Path:
    """The nearest folder upwards with a repository; else the nearest with an index."""
    here = Path(start).resolve()
    for marker in (".git", OWN_FOLDER):
        for folder in (here, *here.parents):
            if (folder / marker).is_dir():
                return folder
    raise FileNotFoundError(f"no workspace around {start}")


def _rules(folder: Path) -> list[tuple[str, bool]]:
    out = []
    for name in (".gitignore", ".loomdexignore"):
        file = folder / name
        if file.is_file():
            for line in file.read_text(errors="replace").splitlines():
                line = line.strip()
                if line and not line.startswith("#"):
                    out.append((pattern_to_regex(line.removeprefix("!")), not line.startswith("!")))
    return out


def walk(root: str, most: int = MOST_BYTES) -> list[str]:
    """Paths of supported files below a folder, sorted: none hidden, ignored, linked or larger than ``most``."""
    base, found = Path(root).resolve(), []
    rules: dict[Path, list[tuple[str, bool]]] = {}
    for folder, dirs, names in os.walk(base, followlinks=False):
        here = Path(folder)
        rules[here] = _rules(here)
        chain = [(p, rules[p]) for p in (*reversed(here.relative_to(base).parents), here.relative_to(base)) for p in [base / p] if rules.get(p)]

        def ignored(path: Path, is_dir: bool) -> bool:
            out = False
            for top, own in chain:
                rel = path.relative_to(top).as_posix() + ("/" if is_dir else "")
                for pattern, hides in own:
                    if re.search(pattern, rel):
                        out = hides
            return out

        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not (here / d).is_symlink() and not ignored(here / d, True))
        for name in names:
            file = here / name
            if name.startswith(".") or file.is_symlink() or name.rsplit(".", 1)[-1].lower() not in BY_EXTENSION or "." not in name:
                continue
            if file.stat().st_size <= most and not ignored(file, False):
                found.append(file.relative_to(base).as_posix())
    return sorted(found)


def read_tree(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """(path, content) of a tree on storage that all executors see; files that are no UTF-8 are left out.

    Listed here rather than by Spark's file source, which hides names that start with an
    underscore (such as ``__init__.py``).
    """
    base = str(Path(root).resolve())
    listed = spark.createDataFrame([(p,) for p in (walk(root) if paths is None else paths)], "path string")

    def load(frames):
        for f in frames:
            rows = []
            for p in f["path"]:
                try:
                    full = os.path.realpath(os.path.join(base, p))
                    if full.startswith(base + os.sep):
                        with open(full, encoding="utf-8", newline="") as file:
                            rows.append((p, file.read()))
                except (OSError, UnicodeDecodeError):
                    pass
            yield pd.DataFrame(rows, columns=["path", "content"])

    n = max(1, min(200, listed.count() // 200 + 1))
    return listed.repartition(n).mapInPandas(load, "path string, content string")


def from_table(df: DataFrame, path: str = "path", content: str = "content", most: int = MOST_BYTES) -> DataFrame:
    """Sources held in a table: supported extensions within the size limit."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return df.select(F.translate(F.col(path), "\\", "/").alias("path"), F.col(content).alias("content")).filter(ext.isin(sorted(BY_EXTENSION)) & (F.octet_length("content") <= most))
