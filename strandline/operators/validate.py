"""Checks of a graph. Each gives rows of its own; diagnostics() brings them to one relation. ``by`` keeps projects apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import ARTIFACT_ROLES, TERMINAL_SUFFIXES
from strandline.functions import paths
from strandline.materialize import cut
from strandline.operators import graph
from strandline.operators.assemble import diagnostic
from strandline.operators.spread import listed, membership

SCRIPT = r"\.(do|py|r|R)$"


def ends_in_script(path: Column) -> Column:
    """A script by its suffix."""
    return path.rlike(SCRIPT)


def produced(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, n_writes): targets of edges from scripts that are no scripts."""
    e = edges.where(ends_in_script(F.col("source")) & ~ends_in_script(F.col("target")))
    return e.groupBy(*by, F.col("target").alias("path")).agg(F.count("*").alias("n_writes"))


def consumed(edges: DataFrame, by: list[str]) -> DataFrame:
    e = edges.where(ends_in_script(F.col("target")) & ~ends_in_script(F.col("source")))
    return e.groupBy(*by, F.col("source").alias("path")).agg(F.count("*").alias("n_reads"))


def multiple_writers(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, n_writes, scripts): targets with more than one writing edge; scripts are distinct, sorted, joined, the first of very many (writers has all)."""
    e = edges.where(ends_in_script(F.col("source")) & ~ends_in_script(F.col("target"))).select(*by, F.col("target").alias("path"), "source")
    return listed(e, [*by, "path"], "source", "n_rows > 1").select(*by, "path", F.col("n_rows").alias("n_writes"), F.col("members").alias("scripts"))


def writers(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, source, n_writes): every script that writes a target of more than one writing edge."""
    e = edges.where(ends_in_script(F.col("source")) & ~ends_in_script(F.col("target"))).select(*by, F.col("target").alias("path"), "source")
    return membership(e, [*by, "path"], "source", "n_rows > 1").withColumnRenamed("n_rows", "n_writes")


def unconsumed_output(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, path): produced, not consumed, and of no suffix that ends a pipeline."""
    ends = F.lit(False)
    for s in TERMINAL_SUFFIXES:
        ends = ends | F.endswith("path", F.lit(s))
    return produced(edges, by).where(~ends).join(consumed(edges, by), [*by, "path"], "left_anti").select(*by, "path")


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_id, n_in, n_out) of every end of an edge, in one pass."""
    end = F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    e = edges.select(*by, end.alias("_e"))
    return e.groupBy(*by, "_e.node_id").agg(F.sum("_e.i").alias("n_in"), F.sum("_e.o").alias("n_out"))


def orphan_artifacts(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Artifacts that no script edge produces or consumes."""
    used = produced(edges, by).select(*by, F.col("path").alias("node_id")).unionByName(consumed(edges, by).select(*by, F.col("path").alias("node_id")))
    return nodes.where("node_type LIKE 'artifact%'").select(*by, "node_id").distinct().join(used, [*by, "node_id"], "left_anti")


def orphan_nodes(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Nodes without any edge."""
    return nodes.select(*by, "node_id", "node_type").distinct().join(degrees(edges, by), [*by, "node_id"], "left_anti")


def unknown_roles(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Artifacts whose role is NULL or none of the known ones."""
    return nodes.where("node_type LIKE 'artifact%'").where(F.col("role").isNull() | ~F.col("role").isin(ARTIFACT_ROLES)).select(*by, "node_id", "role").distinct()


def ambiguous_names(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_type, name, n_paths, paths): names that several nodes of a type have; the first of very many paths (same_name has all)."""
    n = nodes.select(*by, "node_type", "node_id", paths.basename(F.col("node_id")).alias("name"))
    return listed(n, [*by, "node_type", "name"], "node_id").drop("n_rows").withColumnsRenamed({"n": "n_paths", "members": "paths"})


def same_name(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_type, name, node_id): every node whose name another node of its type has."""
    n = nodes.select(*by, "node_type", "node_id", paths.basename(F.col("node_id")).alias("name"))
    return membership(n, [*by, "node_type", "name"], "node_id").drop("n_rows")


def missing_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, node_type) of relative paths that files (by, path) doesn't have; artifacts that are only written are left out."""
    written = degrees(edges, by).where("n_in > 0 AND n_out = 0").select(*by, "node_id").withColumn("_w", F.lit(True))
    n = nodes.where(F.col("path").isNotNull() & ~F.startswith("path", F.lit("/"))).select(*by, "node_id", "node_type", "path").distinct()
    n = n.join(written, [*by, "node_id"], "left").where("_w IS NULL OR node_type NOT LIKE 'artifact%'")
    return n.select(*by, "path", "node_type").join(files.select(*by, "path").distinct(), [*by, "path"], "left_anti")


def bundle_absolute(diags: DataFrame, by: list[str], order: str = "diag_id") -> DataFrame:
    """(by, script, first, n, unique_paths, sample_paths) of absolute_path_usage by script; the sample has the first five different paths in the order they came."""
    d = diags.where("code = 'absolute_path_usage'").select(*by, order, F.col("payload")["script"].alias("script"), F.split(F.coalesce(F.col("payload")["path"], F.lit("")), r" \| ").alias("p")).where("script <> ''")
    per = d.groupBy(*by, "script").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    # a path counts once, where it first came; only then are five taken
    each = d.select(*by, "script", order, F.posexplode("p").alias("i", "_path")).withColumn("path", F.trim("_path")).where("path <> ''")
    once = each.groupBy(*by, "script", "path").agg(F.min(F.struct(order, "i")).alias("at"))
    unique = once.groupBy(*by, "script").agg(F.count("*").alias("unique_paths"))
    # the rank limit keeps five of a script before the shuffle as well
    five = once.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "script").orderBy("at"))).where("_r <= 5")
    told = F.transform(F.sort_array(F.collect_list(F.struct("_r", "path"))), lambda x: x["path"])
    sample = five.groupBy(*by, "script").agg(F.array_join(told, " | ").alias("sample_paths"))
    return per.join(unique, [*by, "script"], "left").join(sample, [*by, "script"], "left").select(*by, "script", "first", "n", F.coalesce("unique_paths", F.lit(0)).alias("unique_paths"), F.coalesce("sample_paths", F.lit("")).alias("sample_paths"))


def dedupe(diags: DataFrame, by: list[str], order: str = "diag_id") -> DataFrame:
    """(by, level, code, payload, order): each (level, code, payload) once, the first in order; the message doesn't count. Payloads are compared as sorted entries; NULL equals NULL."""
    entries = F.array_sort(F.map_entries("payload"))
    return diags.groupBy(*by, "level", "code", entries.alias("entries")).agg(F.min(order).alias(order), F.count("*").alias("n")).select(*by, "level", "code", F.map_from_entries("entries").alias("payload"), order, "n")


def counts(diags: DataFrame) -> DataFrame:
    """(level, code, n) by level and by code in one pass; the other column is NULL."""
    g = diags.groupingSets([[F.col("level")], [F.col("code")]], "level", "code").agg(F.grouping("level").alias("_l"), F.count("*").alias("n"))
    return g.select(F.when(F.col("_l") == 0, "level").otherwise("code").alias("kind"), F.coalesce("level", "code").alias("value"), "n")


def cycle_detected(edges: DataFrame, by: list[str], order: str = "edge_ord") -> DataFrame:
    """(by, level, code, message, payload, start, i) of each cycle; (start, i) is the order in which they are found."""
    path = F.array_join(F.concat("cycle", F.slice("cycle", 1, 1)), " -> ")
    found = graph.found_cycles(edges, by, order).withColumn("path", path)
    return found.select(*by, *diagnostic("warning", "cycle_detected", F.concat(F.lit("Cycle detected: "), "path"), {"cycle": F.col("path")}), "start", "i")


def usage(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node_id, n_in, n_out, n_writes, n_reads) of every end of an edge, in one pass: edges to and from it, and of those the ones by which a script writes or reads it, a script itself left out."""
    scripts = F.struct(ends_in_script(F.col("source")).alias("s"), ends_in_script(F.col("target")).alias("t"))
    row = lambda node, i, o, w, r: F.struct(F.col(node).alias("node_id"), F.lit(i).alias("i"), F.lit(o).alias("o"), w.alias("w"), r.alias("r"))
    no = F.lit(False)
    ends = F.array(row("source", 0, 1, no, F.col("_s.t") & ~F.col("_s.s")), row("target", 1, 0, F.col("_s.s") & ~F.col("_s.t"), no))
    e = edges.select(*by, "source", "target", scripts.alias("_s")).select(*by, F.explode(ends).alias("_e"))
    return e.groupBy(*by, "_e.node_id").agg(F.sum("_e.i").alias("n_in"), F.sum("_e.o").alias("n_out"), F.count_if("_e.w").alias("n_writes"), F.count_if("_e.r").alias("n_reads"))


def diagnostics(nodes: DataFrame, edges: DataFrame, files: DataFrame | None, by: list[str]) -> DataFrame:
    """(by, level, code, message, payload) of all checks but cycles, each once: the rows of the single checks.

    What edges say of their ends is counted once and joined to the nodes once; all checks of nodes read that table. NULL projects are a project.
    """
    at = [F.col(c) for c in by]
    p, node = F.col("path"), F.col("node_id")
    used = cut(usage(edges, by), "usage")
    seen = nodes.select(*by, "node_id", "node_type", "path", "role").join(used.select(*(F.col(c).alias(f"_u_{c}") for c in [*by, "node_id"]), "n_in", "n_out", "n_writes", "n_reads"), _same([*by, "node_id"]), "left")
    seen = cut(seen.drop(*(f"_u_{c}" for c in [*by, "node_id"])), "seen")
    ends = F.lit(False)
    for s in TERMINAL_SUFFIXES:
        ends = ends | F.endswith("node_id", F.lit(s))
    artifact = F.col("node_type").like("artifact%")
    unconsumed = used.where((F.col("n_writes") > 0) & (F.col("n_reads") == 0) & ~ends)
    orphans = seen.where(artifact & (F.coalesce("n_writes", F.lit(0)) == 0) & (F.coalesce("n_reads", F.lit(0)) == 0)).select(*by, "node_id").distinct()
    alone = seen.where("n_in IS NULL").select(*by, "node_id", "node_type").distinct()
    out = multiple_writers(edges, by).select(*at, *diagnostic("warning", "multiple_writers", F.concat(F.lit("Several scripts write "), p), {"path": p, "scripts": F.col("scripts"), "count": F.col("n_writes")}))
    add = [
        unconsumed.select(*at, *diagnostic("info", "unconsumed_output", F.concat(F.lit("Produced artifact is not consumed downstream: "), node), {"path": node})),
        orphans.select(*at, *diagnostic("info", "orphan_artifact", F.concat(F.lit("Orphan artifact: "), node), {"path": node})),
        alone.select(*at, *diagnostic("warning", "orphan_node", F.concat(F.lit("Node without edges: "), node), {"path": node, "node_type": F.col("node_type")})),
        unknown_roles(seen, by).select(*at, *diagnostic("warning", "unknown_file_role", F.concat(F.lit("Artifact of unknown role: "), node), {"path": node, "role": F.coalesce("role", F.lit("None"))})),
        ambiguous_names(seen, by).select(*at, *diagnostic("info", "ambiguous_name", F.concat(F.lit("Several nodes share a file name: "), "name"), {"name": F.col("name"), "node_type": F.col("node_type"), "paths": F.col("paths")})),
    ]
    if files is not None:
        # artifacts that are only written needn't be there
        named = seen.where(p.isNotNull() & ~F.startswith("path", F.lit("/")) & ~(artifact & F.coalesce(F.col("n_in") > 0, F.lit(False)) & F.coalesce(F.col("n_out") == 0, F.lit(False))))
        lost = named.select(*by, "path", "node_type").distinct().join(files.select(*by, "path").distinct(), [*by, "path"], "left_anti")
        add.append(lost.select(*at, *diagnostic("warning", "missing_referenced_file", F.concat(F.lit("Referenced path does not exist in project tree: "), p), {"path": p, "node_type": F.col("node_type")})))
    for d in add:
        out = out.unionByName(d)
    return out


def _same(columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in columns))
