"""Projection of a graph to what a view shows: visible nodes, collapsed clusters, bridges over hidden nodes, edge labels; and the text of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import Display

#: Roles that the view of deliverables shows besides scripts.
DELIVERABLE_VIEW_ROLES = ["deliverable", "placeholder_artifact", "reference_input", "placeholder_script"]
# Attributes of the drawing by theme, fills by language and role.
THEMES = {
    "modern-light": {"graph": 'bgcolor="#FFFFFF", fontname="Helvetica"', "node": 'fontname="Helvetica", style="rounded,filled", color="#94A3B8"', "edge": 'color="#64748B", fontname="Helvetica"'},
    "warm-neutral": {"graph": 'fontname="Helvetica"', "node": 'fontname="Helvetica", style="rounded,filled", color="#7A6555"', "edge": 'color="#7A6555", fontname="Helvetica"'},
    "modern-dark": {"graph": 'bgcolor="#0F172A", fontname="Helvetica"', "node": 'fontname="Helvetica", style="rounded,filled", color="#475569", fontcolor="#E2E8F0"', "edge": 'color="#94A3B8", fontname="Helvetica", fontcolor="#E2E8F0"'},
}
FILLS = {"script": "#DBEAFE", "deliverable": "#DCFCE7", "reference_input": "#FEF3C7", "intermediate": "#F1F5F9", "temporary": "#FEE2E2"}


def is_script_type(node_type: Column) -> Column:
    return node_type.isin("script", "script_placeholder")


def terminal_artifacts(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_id) of artifacts without an edge that leads on."""
    a = nodes.where("node_type IN ('artifact', 'artifact_placeholder')").select(*by, "node_id").distinct()
    return a.join(edges.select(*by, F.col("source").alias("node_id")).distinct(), [*by, "node_id"], "left_anti")


def visible(nodes: DataFrame, edges: DataFrame, by: list[str], d: Display) -> DataFrame:
    """The nodes that the view shows."""
    script = is_script_type(F.col("node_type"))
    if d.view == "deliverables":
        return nodes.where(script | F.coalesce(F.col("role").isin(DELIVERABLE_VIEW_ROLES), F.lit(False)))
    if d.view == "scripts_only":
        return nodes.where(script)
    if d.view == "stage_overview":
        return nodes.where(script & (F.coalesce("cluster_id", F.lit("")) == ""))
    if not d.show_terminal_outputs:
        return nodes.join(terminal_artifacts(nodes, edges, by), [*by, "node_id"], "left_anti")
    return nodes


def aliases(nodes: DataFrame, shown: DataFrame, collapsed: DataFrame | None, by: list[str]) -> DataFrame:
    """(by, node_id, alias): shown nodes stand for themselves; those of a collapsed cluster (by, cluster_id) for ``cluster::`` and its id."""
    own = shown.select(*by, "node_id", "cluster_id").distinct()
    if collapsed is None:
        return own.select(*by, "node_id", F.col("node_id").alias("alias"))
    c = collapsed.select(*by, "cluster_id").distinct().withColumn("_c", F.lit(True))
    out = own.join(c, [*by, "cluster_id"], "left")
    return out.select(*by, "node_id", F.when(F.col("_c"), F.concat(F.lit("cluster::"), "cluster_id")).otherwise(F.col("node_id")).alias("alias")).distinct()


def bridges(edges: DataFrame, alias: DataFrame, nodes: DataFrame, by: list[str], view: str = "overview") -> DataFrame:
    """(by, source, target): what leads over one hidden node, or over one artifact where the view or a collapsed cluster calls for it.

    Ends are made distinct for each hidden node before they are joined.
    """
    ends = edges.select(*by, "source", "target").distinct()
    into = ends.join(alias.select(*by, F.col("node_id").alias("source"), F.col("alias").alias("a")), [*by, "source"]).select(*by, F.col("target").alias("mid"), "a").distinct()
    out = ends.join(alias.select(*by, F.col("node_id").alias("target"), F.col("alias").alias("b")), [*by, "target"]).select(*by, F.col("source").alias("mid"), "b").distinct()
    kinds = nodes.groupBy(*by, F.col("node_id").alias("mid")).agg(F.min("node_type").alias("_t"))
    drawn = alias.select(*by, F.col("node_id").alias("mid"), F.lit(True).alias("_d")).distinct()
    mids = kinds.join(drawn, [*by, "mid"], "left")
    if view not in ("scripts_only", "stage_overview"):
        # an artifact that is drawn itself is bridged only next to a collapsed cluster
        near = into.where("startswith(a, 'cluster::')").select(*by, "mid").unionByName(out.where("startswith(b, 'cluster::')").select(*by, "mid")).distinct().withColumn("_n", F.lit(True))
        mids = mids.join(near, [*by, "mid"], "left").where(F.col("_d").isNull() | (F.col("_n") & ~is_script_type(F.col("_t"))))
    else:
        mids = mids.where(F.col("_d").isNull() | ~is_script_type(F.col("_t")))
    return into.join(mids.select(*by, "mid"), [*by, "mid"], "left_semi").join(out, [*by, "mid"]).where("a <> b").select(*by, F.col("a").alias("source"), F.col("b").alias("target")).distinct()


def edge_label(d: Display) -> Column:
    """The label that an edge shows, '' for none."""
    technical = d.view == "technical"
    on = d.show_edge_labels or technical
    if d.edge_label_mode in ("show", "operation"):
        on = True
    elif d.edge_label_mode == "hidden" and not technical:
        on = False
    if not on:
        return F.lit("")
    return F.coalesce(F.col("operation" if d.edge_label_mode == "operation" and not technical else "visible_label"), F.lit(""))


def drawn_edges(edges: DataFrame, alias: DataFrame, by: list[str], d: Display, order: str = "edge_ord") -> DataFrame:
    """(by, source, target, label, order): edges between aliases, each (source, target, label) once, where it first came; loops stay."""
    a = alias.select(*by, F.col("node_id").alias("source"), F.col("alias").alias("_a"))
    b = alias.select(*by, F.col("node_id").alias("target"), F.col("alias").alias("_b"))
    e = edges.withColumn("label", edge_label(d)).join(a, [*by, "source"]).join(b, [*by, "target"])
    return e.groupBy(*by, F.col("_a").alias("source"), F.col("_b").alias("target"), "label").agg(F.min(order).alias(order))
