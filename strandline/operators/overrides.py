"""Clusters and edges that are given by hand: definitions, members, checks, and what becomes of missing nodes."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import ManualEdge

#: The order of clusters that have none, or none that is a number.
LAST_ORDER = 1_000_000


def cluster_order(metadata: Column) -> Column:
    return F.coalesce(F.try_element_at(metadata, F.lit("order")).try_cast("int"), F.lit(LAST_ORDER))


def latest_definitions(clusters: DataFrame, by: list[str], order: Column) -> DataFrame:
    """(by, cluster_id, label, cluster_order, collapse, kind, n_definitions): each cluster once. The latest value that isn't NULL counts for each field; the label is the id without any."""
    c = clusters.withColumn("_o", order).withColumn("cluster_id", F.trim("cluster_id")).where("cluster_id <> ''")
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    last = lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("_o")))
    return c.groupBy(*by, "cluster_id").agg(
        F.coalesce(last(F.col("label")), F.first("cluster_id")).alias("label"),
        F.coalesce(last(meta("order").try_cast("int")), F.lit(LAST_ORDER)).alias("cluster_order"),
        F.coalesce(last(meta("collapse")), F.lit("false")).alias("collapse"),
        F.coalesce(last(meta("kind")), F.lit("auto")).alias("kind"),
        F.count("*").alias("n_definitions"),
    )


def assignments(clusters: DataFrame, by: list[str], order: Column) -> DataFrame:
    """(by, node_id, cluster_id): the cluster of the last definition that lists a node."""
    m = clusters.select(*by, "cluster_id", order.alias("_o"), F.posexplode("node_ids").alias("_p", "node_id")).where("node_id IS NOT NULL")
    return m.groupBy(*by, "node_id").agg(F.max_by("cluster_id", F.struct("_o", "_p")).alias("cluster_id"))


def missing_members(assigned: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_id, cluster_id) of members that are no node."""
    return assigned.join(nodes.select(*by, "node_id").distinct(), [*by, "node_id"], "left_anti")


def with_hints(missing: DataFrame, names: list[str], cutoff: float = 0.6) -> DataFrame:
    """missing with ``hint``: the most similar of names by difflib's ratio, NULL below the cutoff. names are what a configuration is compared with; similarity to each is computed for each missing member."""
    schema = missing.withColumn("hint", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(hint=[next(iter(difflib.get_close_matches(m, names, n=1, cutoff=cutoff)), None) for m in b["node_id"]])

    return missing.mapInPandas(run, schema)


def closest(missing: list[str], names: DataFrame, name: str = "node_id", cutoff: float = 0.6) -> DataFrame:
    """(node_id, hint): for each of missing the most similar of all names, as difflib.get_close_matches chooses it (of equally similar ones the greatest); none below the cutoff. missing is a configuration's and goes to every task; names stay where they are."""
    wanted = sorted(set(missing))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple[float, str]] = {}
        match = difflib.SequenceMatcher()
        for b in batches:
            for m in wanted:
                match.set_seq2(m)
                for n in b[name]:
                    match.set_seq1(n)
                    least = best[m][0] if m in best else cutoff
                    if match.real_quick_ratio() >= least and match.quick_ratio() >= least and (r := match.ratio()) >= least:
                        best[m] = max(best.get(m, (r, n)), (r, n))
        yield pd.DataFrame([(m, r, n) for m, (r, n) in best.items()], columns=["node_id", "ratio", "hint"])

    each = names.where(F.col(name).isNotNull()).select(name).distinct().mapInPandas(run, "node_id string, ratio double, hint string")
    return each.groupBy("node_id").agg(F.max_by("hint", F.struct("ratio", "hint")).alias("hint"))


def empty_clusters(clusters: DataFrame, by: list[str]) -> DataFrame:
    """(by, cluster_id) of clusters none of whose definitions has a node or a member cluster."""
    n = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0))
    return clusters.groupBy(*by, F.trim("cluster_id").alias("cluster_id")).agg(F.max(n("node_ids") + n("member_cluster_ids")).alias("_n")).where("_n = 0").select(*by, "cluster_id")


def cluster_problems(clusters: DataFrame, by: list[str]) -> DataFrame:
    """(by, code, cluster_id, subject) of definitions that don't hold together: both kinds of members, none, itself or an unknown cluster as member, an id defined twice, a node in several clusters."""
    c = clusters.select(*by, F.trim("cluster_id").alias("cluster_id"), F.filter("node_ids", lambda x: x.isNotNull()).alias("n"), F.filter(F.transform("member_cluster_ids", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")).alias("m"))
    nodes, subs = F.coalesce(F.size("n"), F.lit(0)) > 0, F.coalesce(F.size("m"), F.lit(0)) > 0
    none = F.lit(None).cast("string")
    row = lambda df, code, subject=none: df.select(*by, F.lit(code).alias("code"), "cluster_id", subject.alias("subject"))
    member = c.select(*by, "cluster_id", F.explode("m").alias("x"))
    known = c.select(*by, F.col("cluster_id").alias("x")).distinct()
    twice = c.groupBy(*by, "cluster_id").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = c.select(*by, "cluster_id", F.explode("n").alias("x")).distinct().groupBy(*by, "x").agg(F.min("cluster_id").alias("cluster_id"), F.count("*").alias("_n")).where("_n > 1")
    out = row(c.where(nodes & subs), "invalid_meta_cluster").unionByName(row(c.where(~nodes & ~subs), "empty_manual_cluster"))
    out = out.unionByName(row(member.where("x = cluster_id"), "meta_cluster_self_reference", F.col("x"))).unionByName(row(member.join(known, [*by, "x"], "left_anti"), "meta_cluster_unknown_ref", F.col("x")))
    out = out.unionByName(row(twice, "duplicate_manual_cluster_id")).unionByName(row(shared, "duplicate_manual_cluster_member", F.col("x")))
    return out.distinct()


def edge_kind(source_is_script: Column, target_is_script: Column) -> Column:
    """K05."""
    word = lambda c: F.when(c, "script").otherwise("artifact")
    return F.concat(word(source_is_script), F.lit("_to_"), word(target_is_script))


def apply_manual_edges(entries: list[ManualEdge], nodes: DataFrame, edges: DataFrame) -> tuple[list[dict], list[dict], list[dict]]:
    """(edges to add, nodes to add, diagnostics) of the configured edges, in their order.

    Entries are a configuration; of the graph only the nodes and edges they name come to the driver, at most two nodes and one edge an entry.
    Order counts: a node that one entry puts in is there for later ones.
    """
    spark = nodes.sparkSession
    clean = [(i, e, _clean(e.source), _clean(e.target)) for i, e in enumerate(entries, 1)]
    named = sorted({x for _, _, a, b in clean for x in (a, b) if x})
    if not named:
        there, pairs = {}, set()
    else:
        wanted = spark.createDataFrame([(x,) for x in named], "node_id string")
        there = {r.node_id: r.node_type for r in nodes.select("node_id", "node_type").join(F.broadcast(wanted), "node_id", "left_semi").groupBy("node_id").agg(F.min("node_type").alias("node_type")).collect()}
        want = spark.createDataFrame([(a, b) for _, _, a, b in clean], "source string, target string").distinct()
        pairs = {(r.source, r.target) for r in edges.select("source", "target").distinct().join(F.broadcast(want), ["source", "target"], "left_semi").collect()}
    new_edges, new_nodes, said = [], [], []

    def say(level: str, code: str, message: str, **payload: str) -> None:
        said.append({"level": level, "code": code, "message": message, "payload": payload})

    skipped = 0
    for i, e, a, b in clean:
        if not e.source or not e.target:
            say("warning", "invalid_manual_edge", f"Manual edge {i} has a blank source or target and is skipped.", entry_index=str(i), source=e.source, target=e.target)
            skipped += 1
            continue
        if (a, b) in pairs:
            say("info", "manual_edge_duplicate", f"Manual edge {a} -> {b} is in the graph already and is skipped.", source=a, target=b)
            skipped += 1
            continue
        missing = [x for x in dict.fromkeys((a, b)) if x not in there]
        if missing and e.on_missing != "placeholder":
            for x in missing:
                say("warning", "manual_edge_node_not_found", f"Manual edge {i} is skipped: {x} is no node of the graph.", node_id=x, source=a, target=b, entry_index=str(i))
            skipped += 1
            continue
        for x in missing:
            script = x.endswith((".do", ".py", ".r", ".R"))
            there[x] = "script_placeholder" if script else "artifact_placeholder"
            new_nodes.append({"node_id": x, "label": x.rsplit("/", 1)[-1], "node_type": there[x], "path": None, "role": "placeholder_script" if script else "placeholder_artifact"})
            say("info", "manual_edge_placeholder_injected", f"Placeholder put in for {x} (manual edge {i}).", node_id=x, source=a, target=b)
        word = lambda x: "script" if there[x].startswith("script") else "artifact"
        new_edges.append({"source": a, "target": b, "operation": "manual", "kind": f"{word(a)}_to_{word(b)}", "visible_label": e.label})
        pairs.add((a, b))
    if entries:
        say("info", "manual_edges_applied", f"Applied {len(new_edges)} manual edges.", applied=str(len(new_edges)), skipped=str(skipped), total=str(len(entries)))
    return new_edges, new_nodes, said


def _clean(path: str) -> str:
    path = path.strip().replace("\\", "/")
    return path[2:] if path.startswith("./") else path
