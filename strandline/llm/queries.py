"""Queries p2 over events and nodes, p6 to p8 over the documents: each over all rows and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import confusable, fingerprint, pack, tokenize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 2: copies hidden by formatting


def _event_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], list[str]]:
    paths = F.transform("normalized_paths", fingerprint.words)
    rows = _table(spark, sf_dir, "parsed_events").where("raw_path IS NOT NULL")
    rows = rows.select("event_id", "script", "line", "command", "is_write", fingerprint.words(F.col("raw_path")).alias("raw"), paths.alias("paths"))
    scalars = ["script", "line", "command", "is_write", "raw"]
    return rows.withColumn("fp", fingerprint.fingerprint({c: F.col(c) for c in scalars}, {"paths": F.col("paths")})), scalars, ["paths"]


def _node_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], list[str]]:
    rows = _table(spark, sf_dir, "nodes").where("path IS NOT NULL")
    rows = rows.select("node_row_id", "project_id", "node_type", fingerprint.words(F.col("path")).alias("path"))
    scalars = ["project_id", "node_type", "path"]
    return rows.withColumn("fp", fingerprint.fingerprint({c: F.col(c) for c in scalars}, {})), scalars, []


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fingerprint.copies(*_with_id(_event_records(spark, sf_dir), "event_id"))
    nodes = fingerprint.copies(*_with_id(_node_records(spark, sf_dir), "node_row_id"))
    return events.select(F.lit("parsed_events").alias("relation"), "*").unionByName(nodes.select(F.lit("nodes").alias("relation"), "*"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, with the number of its copies."""
    events = fingerprint.collapsed(*_with_id(_event_records(spark, sf_dir), "event_id"))
    nodes = fingerprint.collapsed(*_with_id(_node_records(spark, sf_dir), "node_row_id"))
    return events.select(F.lit("parsed_events").alias("relation"), "*").unionByName(nodes.select(F.lit("nodes").alias("relation"), "*"))


def _with_id(records: tuple[DataFrame, list[str], list[str]], id_col: str) -> tuple[DataFrame, str, list[str], list[str]]:
    return records[0], id_col, records[1], records[2]


# 6: tokens


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.token_ids(_table(spark, sf_dir, "documents"))


# 7: containers


def _packed(spark: SparkSession, sf_dir: str, joint: bool) -> DataFrame:
    limits = [(r.limit_id, r.capacity_tokens) for r in _table(spark, sf_dir, "pack_limits").select("limit_id", "capacity_tokens").collect()]
    sizes = tokenize.token_counts(_table(spark, sf_dir, "documents"))
    return pack.pack(sizes, [(0, [c for _, c in limits])] if joint else [(i, [c]) for i, c in limits])


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes, for each row of pack_limits."""
    return _packed(spark, sf_dir, joint=False)


def p7_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packing in which every capacity of pack_limits is permitted."""
    return _packed(spark, sf_dir, joint=True)


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row of pack_limits: containers, their space, and what of it is used."""
    boxes = _packed(spark, sf_dir, joint=False).groupBy("limit_id", "container", "capacity").agg(F.sum("n_tokens").alias("used"))
    return boxes.groupBy("limit_id").agg(F.count("*").alias("n_containers"), F.sum("capacity").alias("space"), F.sum("used").alias("used"))


def p7_joint_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity of that one packing: containers, their space, and what of it is used."""
    boxes = _packed(spark, sf_dir, joint=True).groupBy("container", "capacity").agg(F.sum("n_tokens").alias("used"))
    return boxes.groupBy("capacity").agg(F.count("*").alias("n_containers"), F.sum("capacity").alias("space"), F.sum("used").alias("used"))


# 8: look-alikes


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusable.same_looking(_table(spark, sf_dir, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    return confusable.forms(_table(spark, sf_dir, "documents"))


def p8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every text that mix scripts, and those of one script that are spelled in another in the consistent form."""
    return confusable.tokens(_table(spark, sf_dir, "documents"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that look like one with another text, each once, with its class and number of links."""
    return confusable.classes(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p6_ids, p7_packed, p7_joint, p7_unused, p7_joint_unused, p8_found, p8_forms, p8_tokens, p8_classes)}

_WORDS = r"trim(regexp_replace(replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

_RECORDS = f"""
WITH e AS (
  SELECT event_id AS id, script, line, command, is_write, {_WORDS.format("raw_path")} AS raw,
    list_sort(list_transform(coalesce(normalized_paths, []), lambda x: {_WORDS.format("x")})) AS paths
  FROM parsed_events WHERE raw_path IS NOT NULL),
n AS (SELECT node_row_id AS id, project_id, node_type, {_WORDS.format("path")} AS path FROM nodes WHERE path IS NOT NULL),
r AS (
  SELECT 'parsed_events' AS relation, id, min(id) OVER w AS first_id FROM e WINDOW w AS (PARTITION BY script, line, command, is_write, raw, paths)
  UNION ALL
  SELECT 'nodes', id, min(id) OVER w FROM n WINDOW w AS (PARTITION BY project_id, node_type, path))
"""

SQL: dict[str, str] = {
    "p2_found": _RECORDS + "SELECT relation, first_id, id AS copy_id FROM r WHERE first_id < id",
    "p2_records": _RECORDS + "SELECT relation, first_id, count(*) AS n_copies FROM r GROUP BY ALL",
}
