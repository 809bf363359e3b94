"""Texts of a graph: edge CSV, JSON snapshot, validation report, drawing, cluster YAML, section index, summary.

A text of a whole graph is put together in one place, so these collect what they write: use them for graphs that someone is to look at. The
relations themselves are written with DataFrame writers.
"""

from __future__ import annotations

import csv
import io
import json
from collections import Counter
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import Config
from strandline.functions import paths
from strandline.operators import render
from strandline.operators.overrides import cluster_order


def edge_csv(edges: DataFrame) -> str:
    """Source, target, command, kind in edge order."""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(["source", "target", "command", "kind"])
    for r in edges.orderBy("edge_ord").select("source", "target", "operation", "kind").toLocalIterator():
        w.writerow(["" if v is None else v for v in r])
    return out.getvalue()


def snapshot(graph, config: Config) -> str:
    """Nodes by id, edges in order, clusters in order, diagnostics, metadata, settings."""
    nodes = [r.asDict() for r in graph.nodes.orderBy("node_id").collect()]
    edges = [r.asDict() for r in graph.edges.orderBy("edge_ord").select("source", "target", "operation", "kind", "visible_label").collect()]
    clusters = [{"cluster_id": r.cluster_id, "label": r.label, "node_ids": sorted(r.node_ids or []), "metadata": r.metadata} for r in _clusters(graph)]
    body = {
        "project_root": graph.root, "nodes": nodes, "edges": edges, "clusters": clusters, "diagnostics": [r.asDict() for r in graph.diagnostics.select("level", "code", "message", "payload").collect()],
        "excluded_paths": _excluded(graph), "metadata": dict(sorted(graph.metadata.items())), "config": asdict(config),
    }
    return json.dumps(body, indent=2, ensure_ascii=False)


def _excluded(graph) -> list[str]:
    return [r.path for r in graph.files.where("category = 'excluded'").select("path").distinct().orderBy("path").collect()]


def _clusters(graph) -> list:
    return graph.clusters.orderBy(cluster_order(F.col("metadata")), "cluster_id").collect()


def report(graph) -> str:
    """Counts by level and code, excluded paths and all diagnostics, keys sorted."""
    found = [r.asDict() for r in graph.diagnostics.select("level", "code", "message", "payload").collect()]
    excluded = _excluded(graph)
    body = {
        "project_root": graph.root,
        "summary": {"nodes": graph.nodes.count(), "edges": graph.edges.count(), "diagnostics": len(found), "excluded_paths": len(excluded), "by_level": dict(Counter(d["level"] for d in found)), "by_code": dict(Counter(d["code"] for d in found))},
        "excluded_paths": excluded,
        "diagnostics": found,
    }
    return json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False)


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot(graph, config: Config) -> str:
    """The drawing in the DOT language."""
    d, by = config.display, []
    theme = render.THEMES[d.theme if d.theme in render.THEMES else "modern-light"]
    nodes, edges = graph.nodes, graph.edges
    shown = render.visible(nodes, edges, by, d)
    if d.view == "stage_overview":
        shown = nodes.where(render.is_script_type(F.col("node_type")))
    clusters = _clusters(graph)
    collapsed = [c.cluster_id for c in clusters if (c.metadata or {}).get("collapse") == "true" or d.view == "stage_overview"]
    names = graph.spark.createDataFrame([(c,) for c in collapsed], "cluster_id string") if collapsed else None
    alias = render.aliases(nodes, shown, names, by)
    drawn = shown.join(alias, "node_id").select("node_id", "alias", "node_type", "role", "cluster_id", paths.label(F.col("node_id"), d.node_label_style, d.label_path_depth, d.show_extensions).alias("label")).orderBy("node_id").collect()
    out = ["digraph pipeline {", f"  rankdir={graph.metadata.get('rankdir', config.layout.rankdir)};", f"  graph [{theme['graph']}, newrank=true];", f"  node [{theme['node']}];", f"  edge [{theme['edge']}];"]
    inside: dict[str, list] = {}
    for r in drawn:
        if r.cluster_id and r.alias == r.node_id:
            inside.setdefault(r.cluster_id, []).append(r)
    by_id = {c.cluster_id: c for c in clusters}
    children = {m for c in clusters for m in (c.member_cluster_ids or [])}

    def attributes(r) -> str:
        shape = "box" if r.node_type.startswith("script") else "note"
        dashed = f', style="{d.placeholder_style}"' if r.node_type.endswith("placeholder") else ""
        return f"label={_quoted(r.label)}, shape={shape}, fillcolor=\"{render.FILLS.get(r.role, '#FFFFFF')}\"{dashed}"

    def block(c, depth: int, seen: frozenset) -> list[str]:
        pad = "  " * depth
        lines = [f"{pad}  {_quoted(r.node_id)} [{attributes(r)}];" for r in inside.get(c.cluster_id, [])]
        for m in c.member_cluster_ids or []:
            if m in by_id and m not in seen:
                lines += block(by_id[m], depth + 1, seen | {m})
        return [f"{pad}subgraph {_quoted('cluster_' + c.cluster_id)} {{", f"{pad}  label={_quoted(c.label or c.cluster_id)};", *lines, f"{pad}}}"] if lines else []

    for c in clusters:
        if c.cluster_id in collapsed and any(r.alias != r.node_id and r.cluster_id == c.cluster_id for r in drawn):
            out.append(f"  {_quoted('cluster::' + c.cluster_id)} [label={_quoted(c.label or c.cluster_id)}, shape=folder];")
        elif c.cluster_id not in children:
            out += block(c, 1, frozenset({c.cluster_id}))
    placed = {r.node_id for rs in inside.values() for r in rs if r.cluster_id in by_id}
    lane = []
    for r in drawn:
        if r.alias == r.node_id and r.node_id not in placed:
            out.append(f"  {_quoted(r.node_id)} [{attributes(r)}];")
            if not r.node_type.startswith("script"):
                lane.append(r.node_id)
    rank = {"left": "min", "right": "max", "separate_lane": "same"}.get(graph.metadata.get("unclustered_artifacts_position", config.layout.unclustered_artifacts_position))
    if lane and rank:
        out += ['  subgraph "position::unclustered_artifacts" {', f'    rank="{rank}";', *(f"    {_quoted(n)};" for n in lane), "  }"]
    plain = set()
    for r in render.drawn_edges(edges, alias, by, d).orderBy("edge_ord").collect():
        more = ([f"label={_quoted(r.label)}"] if r.label else []) + (['comment="self-loop"'] if r.source == r.target else [])
        if not r.label:
            plain.add((r.source, r.target))
        out.append(f"  {_quoted(r.source)} -> {_quoted(r.target)}" + (f" [{', '.join(more)}]" if more else "") + ";")
    for r in render.bridges(edges, alias, nodes, by, d.view).orderBy("source", "target").collect():
        if (r.source, r.target) not in plain:
            out.append(f"  {_quoted(r.source)} -> {_quoted(r.target)};")
    return "\n".join([*out, "}"]) + "\n"


def cluster_yaml(graph) -> str:
    """Cluster definitions with their scripts, as settings."""
    scripts = {r.cluster_id: r.m for r in graph.nodes.where("node_type = 'script' AND cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.sort_array(F.collect_list("node_id")).alias("m")).collect()}
    clusters = _clusters(graph)
    if not clusters:
        return "clusters: []\n"
    out = ["clusters:"]
    for c in clusters:
        out += [f"  - id: {_quoted(c.cluster_id)}", f"    label: {_quoted(c.label or c.cluster_id)}"]
        key, members = ("member_cluster_ids", c.member_cluster_ids) if c.member_cluster_ids else ("members", scripts.get(c.cluster_id, []))
        out += [f"    {key}:", *(f"      - {_quoted(m)}" for m in members)] if members else [f"    {key}: []"]
        meta = c.metadata or {}
        if (meta.get("order") or "").lstrip("-").isdigit():
            out.append(f"    order: {meta['order']}")
        out.append(f"    collapse: {meta.get('collapse', 'false')}")
    return "\n".join(out) + "\n"


def section_index(sections: DataFrame, form: str = "json") -> str:
    """Sections by script as JSON, CSV or text."""
    rows = sections.select("script", "line", "level", "title").orderBy("script", "line").collect()
    if form == "csv":
        out = io.StringIO()
        w = csv.writer(out)
        w.writerow(["script", "line", "level", "title"])
        w.writerows(rows)
        return out.getvalue()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.script, []).append({"line": r.line, "level": r.level, "title": r.title})
    if form == "json":
        return json.dumps(by, indent=2, ensure_ascii=False)
    return "\n".join(x for s, items in by.items() for x in (s, *(f"  L{i['line']:<4} [{i['level']}]  {i['title']}" for i in items))) + ("\n" if by else "")


def summary(graph, config: Config) -> str:
    """Counts, what the settings did, and the diagnostics."""
    kinds = {r.node_type: r.n for r in graph.nodes.groupBy("node_type").agg(F.count("*").alias("n")).collect()}
    found = graph.diagnostics
    found = found.orderBy("diag_id").collect() if "diag_id" in found.columns else found.collect()
    total = lambda code, key: sum(int(r.payload.get(key) or 0) for r in found if r.code == code)
    lines = [
        f"Project root: {graph.root}", f"Nodes: {sum(kinds.values())} (scripts={kinds.get('script', 0)}, artifacts={kinds.get('artifact', 0)})",
        f"Edges: {graph.edges.count()}", f"Clusters: {graph.clusters.count()}", f"Diagnostics: {len(found)}",
        "Config effects:", f"- View: {config.display.view}", f"- Excluded paths: {len(_excluded(graph))}",
    ]
    if config.exclusions.presets:
        lines.append(f"- Exclusion presets: {','.join(config.exclusions.presets)}")
    lines += [f"- Exclusion note: {r.message}" for r in found if r.code == "exclusion_defaults_not_inherited"][:1]
    shown, hidden, erased = total("temporary_outputs_rendered", "count"), total("temporary_outputs_hidden", "count"), total("temporary_outputs_rendered", "erased_count")
    notices = [r.message for r in found if r.code == "display_option_irrelevant"]
    for n, line in (
        (sum(r.code == "version_family_resolved" for r in found), "- Version families collapsed: {}"),
        (hidden, "- Temporary outputs hidden: {}"),
        (shown, "- Temporary outputs shown: {}" + (f" ({erased} erased temp artifacts)" if erased else "")),
        (len(notices), "- View-specific setting notices: {}"),
    ):
        if n:
            lines.append(line.format(n))
    lines += [f"  * {m}" for m in notices[:3]]
    return "\n".join(lines + [f"- [{r.level}] {r.code}: {r.message}" for r in found]) + "\n"
