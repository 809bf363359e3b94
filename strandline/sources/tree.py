"""A project tree as a relation of files. Executors list what lies below its first levels and read the contents of scripts; the tree is mounted where they run."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import INPUT_SUFFIXES, OUTPUT_SUFFIXES, Config, Exclusions
from strandline.operators.exclusions import excluded

FILES_SCHEMA = "path string, category string, is_dir boolean, mtime timestamp, size bigint"
#: How many folders, or paths, the driver finds before it leaves the folders below them to tasks.
FOLDERS_AHEAD, PATHS_AHEAD = 64, 10_000


def _folder_excluded(rel: str, rules: Exclusions) -> bool:
    """Whether a folder is left out as a whole: it is not entered. (Files are judged by the column expression.)"""
    name = rel.rsplit("/", 1)[-1]
    if any(rel == p.rstrip("/") or rel.startswith(p.rstrip("/") + "/") for p in rules.prefixes) or rel in [p.rstrip("/") for p in rules.exact_paths] or name in rules.exact_names or set(rel.split("/")) & set(rules.folder_names):
        return True
    parts = rel.split("/")
    for g in rules.globs:
        want = g.split("/")
        if len(want) <= len(parts) and all(fnmatch.fnmatchcase(a, b) for a, b in zip(parts[-len(want) :], want)):
            return True
    return False


def _listed(root: str, folder: str, rules: Exclusions) -> tuple[list[tuple], list[str]]:
    """The rows of one folder, in order of names, and the folders in it that are to be entered. Links that lead nowhere are left out, links to folders not entered."""
    rows, inside = [], []
    try:
        entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError:
        return [], []
    for e in entries:
        path = f"{folder}/{e.name}" if folder else e.name
        try:
            if e.is_dir():
                if _folder_excluded(path, rules):
                    rows.append((path + "/", "excluded", True, None, None))
                    continue
                rows.append((path, None, True, None, None))
                if not e.is_symlink():
                    inside.append(path)
            else:
                s = e.stat()
                rows.append((path, None, False, datetime.fromtimestamp(s.st_mtime, UTC), s.st_size))
        except OSError:
            continue
    return rows, inside


def project_files(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """(path, category, is_dir, mtime, size) below root.

    category: a language, ``input``, ``output``, ``other`` or ``excluded``; folders have NULL. A suffix that is both input and output is
    input. Excluded folders are listed with a slash at the end and not entered. Links that lead nowhere are left out.
    """
    rules = config.exclusions.resolved()
    rows, ahead = [], [""]
    while ahead and len(ahead) < FOLDERS_AHEAD and len(rows) < PATHS_AHEAD:
        level, ahead = ahead, []
        for folder in level:
            found, inside = _listed(root, folder, rules)
            rows += found
            ahead += inside
    df = spark.createDataFrame(rows, FILES_SCHEMA)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            todo = list(b["folder"])
            while todo:
                found, inside = _listed(root, todo.pop(), rules)
                todo += inside
                if found:
                    out = pd.DataFrame(found, columns=["path", "category", "is_dir", "mtime", "size"])
                    yield out.assign(mtime=pd.to_datetime(out["mtime"], utc=True), size=out["size"].astype("Int64"))

    if ahead:
        df = df.unionByName(spark.createDataFrame([(f,) for f in ahead], "folder string").repartition(len(ahead), "folder").mapInPandas(walk, FILES_SCHEMA))
    suffix = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    category = F.lit("other")
    for names, label in ((OUTPUT_SUFFIXES, "output"), (INPUT_SUFFIXES, "input")):
        category = F.when(suffix.isin(names), label).otherwise(category)
    for ext, lang in config.languages.by_suffix().items():
        category = F.when(suffix == ext, lang).otherwise(category)
    kind = F.when(F.col("category").isNotNull() | F.col("is_dir"), F.col("category")).when(excluded(F.col("path"), rules), "excluded").otherwise(category)
    return df.withColumn("category", kind)


def script_contents(files: DataFrame, root: str) -> DataFrame:
    """(script, language, content) of the scripts of project_files, read where the task runs. Unreadable files have NULL content."""
    scripts = files.where("category IN ('stata', 'python', 'r')").select(F.col("path").alias("script"), F.col("category").alias("language"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[_read(os.path.join(root, p)) for p in b["script"]])

    return scripts.mapInPandas(run, "script string, language string, content binary")


def _read(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None
