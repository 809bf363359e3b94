"""A project tree to a validated graph: the order in which the operators build on each other."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import Config
from strandline.materialize import cut
from strandline.operators import assemble, clustering, exclusions, graph, overrides, sections, spread, validate, versions
from strandline.resolve import run
from strandline.sinks import text
from strandline.sources import edge_csv, tree

DIAGNOSTICS = "level string, code string, message string, payload map<string,string>"
CLUSTERS = "cluster_id string, label string, node_ids array<string>, member_cluster_ids array<string>, metadata map<string,string>"


@dataclass(frozen=True)
class LineageGraph:
    """The relations of one project. Each step of a build returns a new one."""

    spark: SparkSession
    root: str
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    clusters: DataFrame
    files: DataFrame
    metadata: dict[str, str] = field(default_factory=dict)

    def say(self, rows: list[tuple[str, str, str, dict]] | DataFrame) -> LineageGraph:
        more = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, DIAGNOSTICS)
        return replace(self, diagnostics=self.diagnostics.unionByName(more.select("level", "code", "message", "payload")))


def build(spark: SparkSession, root: str, config: Config | None = None, with_clusters: bool = True) -> LineageGraph:
    """The graph of a project: parse, assemble, version families, clusters, manual edges, layout; without validation."""
    config = config or Config()
    root = os.path.abspath(root)
    files = cut(tree.project_files(spark, root, config), "files")
    cached = os.path.join(root, config.parser.edge_csv_path)
    if config.parser.prefer_existing_edge_csv and os.path.isfile(cached):
        g = _from_csv(spark, root, files, cached)
    else:
        g = _from_scripts(spark, root, files, config)
    if config.parser.write_edge_csv:
        os.makedirs(os.path.dirname(cached), exist_ok=True)
        with open(cached, "w", encoding="utf-8", newline="") as f:
            f.write(text.edge_csv(g.edges))
    g = _version_families(g, config)
    if config.clustering.enabled and config.clustering.strategy != "manual":
        g = _auto_clusters(g)
    if with_clusters:
        g = _manual_clusters(g, config)
    g = _manual_edges(g, config)
    return _scan_facts(_layout(g, config), config)


def _from_csv(spark: SparkSession, root: str, files: DataFrame, path: str) -> LineageGraph:
    edges = cut(edge_csv.read_edges(spark, path), "edges")
    return LineageGraph(spark, root, edge_csv.nodes_of(edges), edges, spark.createDataFrame([], DIAGNOSTICS), spark.createDataFrame([], CLUSTERS), files)


def _from_scripts(spark: SparkSession, root: str, files: DataFrame, config: Config) -> LineageGraph:
    contents = cut(tree.script_contents(files, root), "contents")
    real = files.where("NOT is_dir AND category <> 'excluded'")
    parsed, children = run.resolve(contents, real, root, config)
    parsed, children = cut(parsed, "parsed"), cut(children, "calls")
    rules = config.exclusions
    # references to excluded paths leave the events and are told
    events = parsed.where("kind = 'event'").withColumn("_gone", F.filter("normalized_paths", lambda p: exclusions.excluded(p, rules)))
    kept = events.withColumn("normalized_paths", F.filter("normalized_paths", lambda p: ~exclusions.excluded(p, rules))).where("size(normalized_paths) > 0")
    gone = events.select("script", "line", "command", F.explode("_gone").alias("p")).unionByName(children.where(exclusions.excluded(F.col("child"), rules)).select("script", "line", F.lit("call").alias("command"), F.col("child").alias("p")))
    children = children.where(~exclusions.excluded(F.col("child"), rules))
    ev = cut(kept.select("script", "line", "command", "raw_path", "normalized_paths", "was_absolute", "resolution_status", "dynamic_pattern", "is_write"), "events")
    d, c = config.display, config.classification
    acc = cut(assemble.classified(ev, [], c, config.parser.suppress_internal_only_writes, d.show_temporary_outputs), "accesses")
    calls = assemble.call_edges(children, [])
    edges = calls.unionByName(assemble.data_edges(acc, [], d.show_temporary_outputs))
    order = ["phase", F.when(F.col("phase") == 2, F.col("target")).otherwise(F.col("source")), F.when(F.col("phase") == 2, F.col("source")).otherwise(F.col("target")), "operation", "status", "pattern"]
    edges = edges.select("*", *(F.col(c).alias(f"_o{i}") if isinstance(c, str) else c.alias(f"_o{i}") for i, c in enumerate(order)))
    edges = spread.numbered(edges, [], [F.col(f"_o{i}") for i in range(len(order))], "edge_ord").withColumn("edge_ord", F.col("edge_ord").cast("bigint"))
    edges = cut(edges.drop("phase", "status", "pattern", *(f"_o{i}" for i in range(len(order)))), "edges")
    known = contents.select("script").union(children.select("child")).distinct()
    script_nodes = assemble.script_nodes(known, [])
    arts = assemble.artifact_nodes(acc, [], d.show_temporary_outputs).join(known.withColumnRenamed("script", "node_id"), "node_id", "left_anti")
    nodes = cut(script_nodes.unionByName(arts.select(*script_nodes.columns)).withColumn("cluster_id", F.lit(None).cast("string")), "nodes")
    diags = parsed.where("kind = 'diagnostic'").select("level", "code", "message", "payload")
    diags = diags.unionByName(assemble.event_diagnostics(ev, []).select("level", "code", "message", "payload"))
    message = F.concat(F.lit("Excluded path omitted from graph at "), "script", F.lit(":"), F.col("line").cast("string"), F.lit(" ("), "command", F.lit("): "), "p")
    diags = diags.unionByName(gone.select(*assemble.diagnostic("info", "excluded_reference", message, {"script": F.col("script"), "line": F.col("line"), "command": F.col("command"), "path": F.col("p")})))
    own = acc.where("unconsumed").select("path").distinct()
    diags = diags.unionByName(own.select(*assemble.diagnostic("info", "unconsumed_output", F.concat(F.lit("Produced artifact is not consumed downstream: "), "path"), {"path": F.col("path")})))
    shown = d.show_temporary_outputs
    temp = assemble.temporary_summary(acc, []).where("n_temporary > 0")
    word = "rendered" if shown else "hidden"
    diags = diags.unionByName(temp.select(*assemble.diagnostic("info", f"temporary_outputs_{word}", F.concat(F.col("n_temporary").cast("string"), F.lit(f" temporary outputs {word}")), {"count": F.col("n_temporary"), "erased_count": F.nullif(F.col("n_erased"), F.lit(0))})))
    return LineageGraph(spark, root, nodes, edges, cut(diags, "diagnostics"), spark.createDataFrame([], CLUSTERS), files)


def _version_families(g: LineageGraph, config: Config) -> LineageGraph:
    v = config.parser.version_families
    fam = versions.families(g.nodes, [])
    g = g.say(fam.select(*assemble.diagnostic("info", "version_family_detected", F.concat(F.lit("Likely versioned file family detected: "), "family"), {"family": F.col("family"), "members": F.col("members"), "mode": F.lit(v.mode)})))
    mem = cut(versions.members(g.nodes, []), "members")
    several = mem.join(fam.select("family"), "family", "left_semi")
    files = g.files.where("NOT is_dir").select("path", "mtime")
    ties = versions.newest_ties(several, files, [])
    g = g.say(ties.select(*assemble.diagnostic("warning", "version_family_ambiguous", F.concat(F.lit("Version family tie on modified time: "), "family"), {"family": F.col("family"), "count": F.col("n")})))
    if v.mode in ("off", "detect_only"):
        return g
    chosen = cut(versions.canonical(several, [], v, files), "chosen")
    nodes, first, open_ = versions.collapse(g.nodes, g.edges, several, chosen, [])
    mode = F.lit(v.mode)
    told = chosen.where("canonical IS NOT NULL").join(fam.select("family", "members"), "family")
    g = g.say(told.select(*assemble.diagnostic("info", "version_family_resolved", F.concat(F.lit("Resolved version family to canonical member: "), "family"), {"family": F.col("family"), "chosen": F.col("canonical"), "members": F.col("members"), "mode": mode})))
    g = g.say(open_.select(*assemble.diagnostic("warning", "version_family_ambiguous", F.concat(F.lit(f"Could not resolve version family under mode {v.mode}: "), "family"), {"family": F.col("family"), "mode": mode})))
    return replace(g, nodes=cut(nodes, "nodes"), edges=cut(first, "edges"))


def _auto_clusters(g: LineageGraph) -> LineageGraph:
    scripts = g.nodes.where("node_type = 'script'").select("node_id")
    found = cut(clustering.clusters(g.edges, scripts, []), "clusters")
    nodes = g.nodes.drop("cluster_id").join(found.select("node_id", "cluster_id"), "node_id", "left")
    nodes = _artifacts_follow(g.edges, nodes, None)
    members = nodes.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.sort_array(F.collect_list("node_id")).alias("node_ids"))
    facts = found.groupBy("cluster_id").agg(F.min("label").alias("label"), F.min("cluster_order").alias("o"), F.count("*").alias("n"))
    meta = F.create_map(F.lit("kind"), F.lit("auto"), F.lit("script_count"), F.col("n").cast("string"), F.lit("order"), F.col("o").cast("string"))
    clusters = facts.join(members, "cluster_id").select("cluster_id", "label", "node_ids", F.array().cast("array<string>").alias("member_cluster_ids"), meta.alias("metadata"))
    return replace(g, nodes=cut(nodes, "nodes"), clusters=cut(clusters, "clusters"))


def _artifacts_follow(edges: DataFrame, nodes: DataFrame, protected: DataFrame | None) -> DataFrame:
    follow = clustering.artifact_clusters(edges, nodes, [], protected).withColumnRenamed("cluster_id", "_c")
    return nodes.join(follow, "node_id", "left").withColumn("cluster_id", F.coalesce("_c", "cluster_id")).drop("_c")


def _manual_clusters(g: LineageGraph, config: Config) -> LineageGraph:
    """J01 to J08 over the configured definitions: members move to the last definition that lists them, emptied clusters go, artifacts follow, clusters of clusters come last."""
    wanted = [c for c in config.clusters if c.cluster_id.strip()]
    blank = [("warning", "invalid_manual_cluster", "Skipped a manual cluster definition with an empty id.", {})] * (len(config.clusters) - len(wanted))
    if blank:
        g = g.say(blank)
    if not wanted:
        return g
    spark = g.spark
    schema = f"row int, {CLUSTERS}"
    rows = [(i, c.cluster_id.strip(), c.label, c.members, c.member_cluster_ids, {"kind": "manual", "collapse": str(c.collapse).lower(), "order": str(c.order if c.order is not None else i + 1), **({"meta_cluster": "true"} if c.member_cluster_ids else {})}) for i, c in enumerate(wanted)]
    df = spark.createDataFrame(rows, schema)
    asg = cut(overrides.assignments(df, [], F.col("row")), "assigned")
    lost = overrides.missing_members(asg, g.nodes, [])
    missing = [r.asDict() for r in lost.collect()]  # at most the configured members
    hints = {r.node_id: r.hint for r in overrides.closest([m["node_id"] for m in missing], g.nodes).collect()} if missing else {}
    said = [("warning", "cluster_member_not_found", f"Manual cluster member is no node: {m['node_id']}" + (f" (did you mean {hints[m['node_id']]}?)" if hints.get(m["node_id"]) else ""), {"cluster_id": m["cluster_id"], "member": m["node_id"]}) for m in missing]
    said += [("warning", r.code, f"Cluster {r.cluster_id}: {r.code}", {"cluster_id": r.cluster_id, **({"member": r.subject} if r.subject else {})}) for r in overrides.cluster_problems(df.drop("row"), []).collect()]
    for cycle in graph.back_edge_cycles([(c.cluster_id, m) for c in wanted for m in c.member_cluster_ids]):
        said.append(("warning", "meta_cluster_cycle", "Clusters contain each other: " + " -> ".join([*cycle, cycle[0]]), {"cycle": " -> ".join([*cycle, cycle[0]])}))
    mine = asg.join(g.nodes.select("node_id"), "node_id", "left_semi")
    nodes = g.nodes.join(mine.withColumnRenamed("cluster_id", "_c"), "node_id", "left").withColumn("cluster_id", F.coalesce("_c", "cluster_id")).drop("_c")
    nodes = cut(_artifacts_follow(g.edges, nodes, mine.select("node_id")), "nodes")
    last = overrides.latest_definitions(df, [], F.col("row"))
    meta = F.create_map(F.lit("kind"), F.lit("manual"), F.lit("collapse"), F.col("collapse"), F.lit("order"), F.col("cluster_order").cast("string"))
    subs = df.groupBy("cluster_id").agg(F.max_by("member_cluster_ids", F.when(F.size("member_cluster_ids") > 0, F.col("row"))).alias("member_cluster_ids"))
    manual = last.join(subs, "cluster_id").select("cluster_id", "label", "member_cluster_ids", meta.alias("metadata"))
    auto = g.clusters.join(manual.select("cluster_id"), "cluster_id", "left_anti").select("cluster_id", "label", "member_cluster_ids", "metadata")
    members = nodes.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.sort_array(F.collect_list("node_id")).alias("node_ids"))
    none = F.array().cast("array<string>")
    clusters = auto.unionByName(manual).join(members, "cluster_id", "left").withColumn("node_ids", F.coalesce("node_ids", none)).withColumn("member_cluster_ids", F.coalesce("member_cluster_ids", none))
    clusters = clusters.where("size(node_ids) > 0 OR size(member_cluster_ids) > 0").select("cluster_id", "label", "node_ids", "member_cluster_ids", "metadata")
    said.append(("info", "manual_clusters_applied", f"Applied {len(wanted)} manual cluster definitions.", {"clusters": str(len(wanted)), "assigned_nodes": str(mine.count())}))
    return replace(g, nodes=nodes, clusters=cut(clusters, "clusters")).say(said)


def _manual_edges(g: LineageGraph, config: Config) -> LineageGraph:
    if not config.manual_edges:
        return g
    edges, nodes, said = overrides.apply_manual_edges(config.manual_edges, g.nodes, g.edges)
    top = g.edges.agg(F.max("edge_ord")).first()[0] or 0
    if nodes:
        new = g.spark.createDataFrame([(n["node_id"], n["label"], n["node_type"], None, n["role"]) for n in nodes], "node_id string, label string, node_type string, path string, role string")
        g = replace(g, nodes=g.nodes.unionByName(new, allowMissingColumns=True))
    if edges:
        new = g.spark.createDataFrame([(top + i, e["source"], e["target"], e["operation"], e["kind"], e["visible_label"]) for i, e in enumerate(edges, 1)], "edge_ord bigint, source string, target string, operation string, kind string, visible_label string")
        g = replace(g, edges=g.edges.unionByName(new, allowMissingColumns=True))
    return g.say([(s["level"], s["code"], s["message"], s["payload"]) for s in said])


def _layout(g: LineageGraph, config: Config) -> LineageGraph:
    """Direction and place of artifacts, defaults for values that aren't known."""
    said, meta = [], dict(g.metadata)
    for key, value, known, default, code in (
        ("rankdir", config.layout.rankdir, ("LR", "TB"), "LR", "invalid_layout_rankdir"),
        ("unclustered_artifacts_position", config.layout.unclustered_artifacts_position, ("auto", "left", "right", "separate_lane"), "auto", "invalid_unclustered_artifacts_position"),
    ):
        meta[key] = value if value in known else default
        if value not in known:
            said.append(("warning", code, f"{key} {value!r} is none of {', '.join(known)}; {default} is used", {"value": str(value)}))
    g = replace(g, metadata=meta)
    return g.say(said) if said else g


def _scan_facts(g: LineageGraph, config: Config) -> LineageGraph:
    """K08, L: what the scan found, and settings that have no effect in the view."""
    n = {r.category: r.n for r in g.files.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n")).collect()}
    said = [("info", "project_scan", "Project discovery completed.", {k: str(v) for k, v in sorted(n.items())})]
    if n.get("excluded"):
        said.append(("info", "excluded_files", f"Excluded {n['excluded']} files during discovery.", {"count": str(n["excluded"])}))
    d = config.display
    if d.view in ("scripts_only", "stage_overview") and not d.show_terminal_outputs:
        said.append(("info", "display_option_irrelevant", "show_terminal_outputs has no effect in this view", {"view": d.view}))
    if config.exclusions.presets == []:
        said.append(("info", "exclusion_defaults_not_inherited", "No exclusion presets are in use", {}))
    return g.say(said)


def validated(g: LineageGraph) -> LineageGraph:
    """All checks, absolute paths bundled by script, each diagnostic once."""
    on_disk = g.files.select("path")
    found = validate.diagnostics(g.nodes, g.edges, on_disk, [])
    rings = cut(validate.cycle_detected(g.edges, []), "rings").orderBy("start", "i").select("level", "code", "message", "payload")
    said = []
    n = g.files.where("category = 'excluded'").count()
    if n:
        said.append(("info", "excluded_path_inventory", f"{n} excluded paths recorded in this run.", {"count": str(n)}))
    if not g.edges.limit(1).count():
        said.append(("warning", "empty_graph", "Graph has no edges.", {}))
    every = cut(g.diagnostics.unionByName(found.select("level", "code", "message", "payload")).unionByName(rings).unionByName(g.spark.createDataFrame(said, DIAGNOSTICS)).withColumn("diag_id", F.monotonically_increasing_id()), "found")
    bundled = cut(validate.bundle_absolute(every, []), "bundled")
    several = bundled.where("n > 1")
    message = F.concat(F.lit("Absolute paths detected "), F.col("n").cast("string"), F.lit(" times in "), "script")
    bundle = several.select(*assemble.diagnostic("warning", "absolute_path_usage", message, {"script": F.col("script"), "count": F.col("n"), "unique_paths": F.col("unique_paths"), "sample_paths": F.nullif(F.col("sample_paths"), F.lit(""))}), F.col("first").alias("diag_id"))
    single = every.withColumn("_s", F.when(F.col("code") == "absolute_path_usage", F.col("payload")["script"])).join(several.select(F.col("script").alias("_s")), "_s", "left_anti").drop("_s")
    once = single.unionByName(bundle).withColumn("_e", F.array_sort(F.map_entries("payload"))).groupBy("level", "code", "_e").agg(F.min(F.struct("diag_id", "message")).alias("m"))
    return replace(g, diagnostics=cut(once.select("m.diag_id", "level", "code", "m.message", F.map_from_entries("_e").alias("payload")), "diagnostics"))


def script_sections(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(script, line, level, title) of all scripts of a project."""
    config = config or Config()
    files = cut(tree.project_files(spark, root, config), "files")
    docs = tree.script_contents(files, root).select("script", "language", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return sections.sections(docs.drop("language"), ["script"], assemble.language_of(F.col("script")))
