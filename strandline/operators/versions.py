"""Version families: files whose names differ by a version token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import VersionFamilies
from strandline.functions import paths
from strandline.operators.spread import listed


def members(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, family, member): artifact nodes with a path that has a version token, each path once."""
    a = nodes.where("node_type LIKE 'artifact%' AND path IS NOT NULL").select(*by, paths.family_key(F.col("path")).alias("family"), F.col("path").alias("member"))
    return a.where("family IS NOT NULL").distinct()


def families(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, family, members, n_members) of families with more than one member; the first of very many members (``members`` has all)."""
    return listed(members(nodes, by), [*by, "family"], "member").drop("n_rows").withColumnRenamed("n", "n_members")


def newest_ties(mem: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """(by, family, mtime, n) of families of which several members were modified last, at the same time. files: (by, path, mtime)."""
    have = mem.join(files.select(*by, F.col("path").alias("member"), "mtime"), [*by, "member"])
    # counting per time keeps a large family from being one sorted group
    per = have.groupBy(*by, "family", "mtime").agg(F.count("*").alias("n"))
    return per.groupBy(*by, "family").agg(F.max(F.struct("mtime", "n")).alias("m")).select(*by, "family", "m.mtime", "m.n").where("n > 1")


def canonical(mem: DataFrame, by: list[str], v: VersionFamilies, files: DataFrame | None = None) -> DataFrame:
    """(by, family, canonical) of the families of mem with more than one member; canonical NULL if the mode can't decide.

    The mode may begin with prefer_. latest_modified takes the existing member modified last; highest_numeric the highest _vN; priority_suffix the first suffix of the list.
    Ties go to the tie breaker: the member modified last, else the last by name.
    """
    name = paths.basename(F.col("member"))
    mtime = F.lit(None).cast("timestamp")
    if files is not None:
        mem = mem.join(files.select(*by, F.col("path").alias("member"), F.col("mtime").alias("_mtime")), [*by, "member"], "left")
        mtime = F.col("_mtime")
    number = F.nullif(F.regexp_extract(name, r"(?i)_v(\d+)\.[^.]+$", 1), F.lit("")).try_cast("decimal(38,0)")
    token = F.lower(F.regexp_extract(name, r"(?i)_([a-z][a-z0-9]*)\.[^.]+$", 1))
    rank = F.lit(None).cast("int")
    for i, s in enumerate(v.priority_suffixes):
        rank = F.coalesce(rank, F.when(token == s.lower(), -i))
    # the tie breaker takes existing members only
    tie = mtime if v.tiebreaker == "latest_modified" and files is not None else F.lit(None).cast("timestamp")
    score = {"latest_modified": mtime, "highest_numeric": number, "priority_suffix": rank}[v.mode.removeprefix("prefer_")]
    best = F.max(F.when(score.isNotNull(), F.struct(score.alias("s"), tie.alias("t"), F.col("member").alias("m"))))
    return mem.groupBy(*by, "family").agg(F.count("*").alias("_n"), best.alias("_b")).where("_n > 1").select(*by, "family", F.col("_b.m").alias("canonical"))


def collapse(nodes: DataFrame, edges: DataFrame, mem: DataFrame, chosen: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes without the other members, edges on the canonical ones and each once (the first by edge_ord), and (by, family) that couldn't be decided."""
    decided = mem.join(chosen.where("canonical IS NOT NULL"), [*by, "family"]).where("member <> canonical").select(*by, "member", "canonical")
    left = nodes.join(decided.select(*by, F.col("member").alias("node_id")), [*by, "node_id"], "left_anti")
    out = edges
    for end in ("source", "target"):
        out = out.join(decided.select(*by, F.col("member").alias(end), F.col("canonical").alias("_c")), [*by, end], "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    return left, dedupe_edges(out, by), chosen.where("canonical IS NULL").select(*by, "family")


EDGE_KEY = ["source", "target", "operation", "kind", "visible_label"]


def dedupe_edges(edges: DataFrame, by: list[str], order: str = "edge_ord") -> DataFrame:
    """The first edge of each (source, target, operation, kind, label); NULL labels are equal."""
    return edges.groupBy(*by, *EDGE_KEY).agg(F.min(order).alias(order))
