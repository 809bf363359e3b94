"""Relations of a graph as folders of files, written by the executors: for graphs of any size. ``text`` makes single texts for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, folder: str) -> None:
    """B01 as a folder: source, target, command, kind; the files in their order, and the lines in each, have the order of edges."""
    rows = edges.repartitionByRange("edge_ord").sortWithinPartitions("edge_ord")
    rows.select("source", "target", F.col("operation").alias("command"), "kind").write.mode("overwrite").option("escape", '"').csv(folder, header=True)


def write_snapshot(graph, folder: str) -> None:
    """B02 as a folder for each relation, a JSON object a line; files has the excluded paths as well."""
    relations = {
        "nodes": graph.nodes, "edges": graph.edges, "clusters": graph.clusters, "diagnostics": graph.diagnostics.select("level", "code", "message", "payload"),
        "excluded_paths": graph.files.where("category = 'excluded'").select("path").distinct(), "metadata": graph.spark.createDataFrame(sorted(graph.metadata.items()) or [("", "")], "key string, value string").where("key <> ''"),
    }
    for name, df in relations.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_report(graph, folder: str) -> None:
    """B03 as folders: the diagnostics, and their counts by level and code."""
    found = graph.diagnostics.select("level", "code", "message", "payload")
    found.write.mode("overwrite").json(f"{folder}/diagnostics")
    found.groupBy("level", "code").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{folder}/summary")
    graph.files.where("category = 'excluded'").select("path").distinct().write.mode("overwrite").json(f"{folder}/excluded_paths")
