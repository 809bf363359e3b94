"""Edge lists in CSV: source, target, command, kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import paths
from strandline.operators.validate import ends_in_script

EDGE_CSV_SCHEMA = "source string, target string, command string, kind string"


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(edge_ord, source, target, operation, kind, visible_label) of an edge list. Fields are trimmed; joins of data keep no label."""
    raw = spark.read.csv(path, header=True, schema=EDGE_CSV_SCHEMA, multiLine=True, escape='"')
    t = raw.select(*(F.trim(c).alias(c) for c in raw.columns))
    label = F.when(~F.col("command").isin("merge", "append", "cross"), F.col("command"))
    return t.select(F.monotonically_increasing_id().alias("edge_ord"), "source", "target", F.col("command").alias("operation"), "kind", label.alias("visible_label"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """Nodes of an edge list: every end once. Scripts are known by their suffix; an artifact's role is the kind of its first edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"), "kind", "edge_ord")
    script = ends_in_script(F.col("node_id"))
    n = ends.groupBy("node_id").agg(F.min_by("kind", "edge_ord").alias("kind"))
    return n.select("node_id", paths.basename(F.col("node_id")).alias("label"), F.when(script, "script").otherwise("artifact").alias("node_type"), F.col("node_id").alias("path"), F.when(script, "script").otherwise(F.col("kind")).alias("role"), F.lit(None).cast("string").alias("cluster_id"), F.create_map().cast("map<string,string>").alias("metadata"))
