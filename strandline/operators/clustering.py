"""Automatic clusters: scripts of folders that depend on each other in a chain, and the artifacts that only they use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths
from strandline.operators import graph
from strandline.operators.spread import numbered


def script_dependencies(edges: DataFrame, scripts: DataFrame, by: list[str]) -> DataFrame:
    """(by, source, target), each once: direct edges between scripts, and writer to reader over a shared artifact. scripts: (by, node_id).

    The join is on the artifact; an artifact with many writers and many readers makes that many pairs, which are its dependencies.
    """
    direct, writes, reads = _accesses(edges, scripts, by)
    through = writes.join(reads, [*by, "artifact"]).select(*by, "source", "target")
    return direct.unionByName(through).where("source <> target").distinct()


def _accesses(edges: DataFrame, scripts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between scripts (source, target), writes (source, artifact) and reads (artifact, target)."""
    s = scripts.select(*by, "node_id").distinct()
    e = edges.select(*by, "source", "target").distinct()
    e = e.join(s.withColumnRenamed("node_id", "source").withColumn("_s", F.lit(True)), [*by, "source"], "left")
    e = e.join(s.withColumnRenamed("node_id", "target").withColumn("_t", F.lit(True)), [*by, "target"], "left")
    direct = e.where("_s AND _t").select(*by, "source", "target")
    writes = e.where("_s AND _t IS NULL").select(*by, "source", F.col("target").alias("artifact"))
    reads = e.where("_s IS NULL AND _t").select(*by, F.col("source").alias("artifact"), "target")
    return direct, writes, reads


def shared_artifacts(edges: DataFrame, scripts: DataFrame, by: list[str]) -> DataFrame:
    """I02 in linear size: (by, artifact, n_writers, n_readers, n_pairs) of artifacts over which scripts depend on each other; n_pairs counts the dependencies through it, n_writers times n_readers less scripts that do both."""
    _, writes, reads = _accesses(edges, scripts, by)
    side = lambda df, script, w, r: df.select(*by, "artifact", F.col(script).alias("script"), F.lit(w).alias("_w"), F.lit(r).alias("_r"))
    each = side(writes, "source", 1, 0).unionByName(side(reads, "target", 0, 1)).groupBy(*by, "artifact", "script").agg(F.max("_w").alias("_w"), F.max("_r").alias("_r"))
    n = each.groupBy(*by, "artifact").agg(F.sum("_w").alias("n_writers"), F.sum("_r").alias("n_readers"), F.sum(F.col("_w") * F.col("_r")).alias("_own"))
    return n.where("n_writers > 0 AND n_readers > 0").select(*by, "artifact", "n_writers", "n_readers", (F.col("n_writers").cast("decimal(38,0)") * F.col("n_readers") - F.col("_own")).cast("bigint").alias("n_pairs"))


def folder_links(edges: DataFrame, scripts: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b): links between the folders of scripts that depend on each other.

    The same as the folders of script_dependencies, but scripts are replaced by their folders before the join, so an artifact with very many
    writers and readers is joined as few folders.
    """
    direct, writes, reads = _accesses(edges, scripts, by)
    a, b = paths.parent_dir(F.col("source")).alias("a"), paths.parent_dir(F.col("target")).alias("b")
    through = writes.select(*by, a, "artifact").distinct().join(reads.select(*by, "artifact", b).distinct(), [*by, "artifact"]).select(*by, "a", "b")
    return direct.select(*by, a, b).unionByName(through).where("a <> b").distinct()


def mergeable(links: DataFrame, by: list[str]) -> DataFrame:
    """The links whose source leads to one folder only, whose target is led to by one only, and that are two steps apart at most."""
    out = links.groupBy(*by, "a").agg(F.count("*").alias("_o")).where("_o = 1").select(*by, "a")
    into = links.groupBy(*by, "b").agg(F.count("*").alias("_i")).where("_i = 1").select(*by, "b")
    return links.join(out, [*by, "a"], "left_semi").join(into, [*by, "b"], "left_semi").where(paths.dir_distance(F.col("a"), F.col("b")) <= 2).select(*by, "a", "b")


def clusters(edges: DataFrame, scripts: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_id, cluster_id, label, cluster_order) of every script. Clusters are numbered within a project by their least folder."""
    folders = scripts.select(*by, "node_id", paths.parent_dir(F.col("node_id")).alias("folder")).distinct()
    links = mergeable(folder_links(edges, scripts, by), by)
    key = lambda c: F.to_json(F.struct(*by, F.col(c).alias("folder")))
    own = folders.select(*by, "folder").distinct().withColumn("node", key("folder"))
    comp = graph.components(own, links.select(key("a").alias("a"), key("b").alias("b")))
    in_comp = own.join(comp, "node")
    # what all folders share is what the first and the last of them share
    ends = paths.parts(F.col("folder"))
    per = in_comp.groupBy(*by, "component").agg(F.min("folder").alias("first"), F.min(ends).alias("_lo"), F.max(ends).alias("_hi"))
    named = F.when(F.col("_lo") == F.col("_hi"), F.array("first")).otherwise(F.array(F.array_join("_lo", "/"), F.array_join("_hi", "/")))
    per = numbered(per, by, [F.col("first")], "i").select("component", F.format_string("cluster_%03d", "i").alias("cluster_id"), paths.cluster_label(named).alias("label"), (F.col("i") + 1000).cast("int").alias("cluster_order"))
    return folders.join(in_comp.select(*by, "folder", "component"), [*by, "folder"]).join(per, "component").select(*by, "node_id", "cluster_id", "label", "cluster_order")


def artifact_clusters(edges: DataFrame, nodes: DataFrame, by: list[str], protected: DataFrame | None = None) -> DataFrame:
    """(by, node_id, cluster_id) of the artifacts whose neighbouring scripts with a cluster all have the same one. protected: (by, node_id) left alone."""
    s = nodes.where("node_type = 'script' AND cluster_id IS NOT NULL").select(*by, F.col("node_id").alias("script"), "cluster_id").distinct()
    a = nodes.where("node_type LIKE 'artifact%'").select(*by, "node_id").distinct()
    both = edges.select(*by, F.col("source").alias("node_id"), F.col("target").alias("script")).unionByName(edges.select(*by, F.col("target").alias("node_id"), F.col("source").alias("script")))
    near = both.join(s, [*by, "script"]).groupBy(*by, "node_id").agg(F.min("cluster_id").alias("cluster_id"), F.max("cluster_id").alias("_m"))
    out = near.where("cluster_id = _m").select(*by, "node_id", "cluster_id").join(a, [*by, "node_id"], "left_semi")
    return out.join(protected, [*by, "node_id"], "left_anti") if protected is not None else out
