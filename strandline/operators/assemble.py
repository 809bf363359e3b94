"""From events to a graph: routing, roles, suppression, edges, nodes and the diagnostics that events carry.

``by`` names the columns that keep projects apart (it may be empty). Events have by, script, line, command, raw_path, normalized_paths,
was_absolute, resolution_status, dynamic_pattern, is_write. NULL or empty normalized_paths give no edges. All joins are on (by, path) or
(by, script, path) after duplicates are gone, so a path that many events name is one row by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import PRESENTATION_SUFFIXES, Classification
from strandline.functions import paths
from strandline.operators.catalog import command_kinds

#: Which role of a written artifact outweighs another.
ROLE_PRIORITY = {"deliverable": 3, "intermediate": 2, "generated_artifact": 1}


def language_of(script: Column) -> Column:
    ext = F.lower(paths.suffix(script))
    return F.when(ext == ".do", "stata").when(ext == ".py", "python").when(ext == ".r", "r").otherwise("unknown")


def routed(events: DataFrame) -> DataFrame:
    """Events with language and kind (read, write, erase; NULL for commands that no catalog row knows). fstring_path goes by is_write."""
    kinds = events.sparkSession.createDataFrame(command_kinds(), "_l string, _c string, kind string")  # a fixed table of some 140 rows
    with_lang = events.withColumn("language", language_of(F.col("script")))
    out = with_lang.join(F.broadcast(kinds), (F.col("language") == F.col("_l")) & (F.col("command") == F.col("_c")), "left").drop("_l", "_c")
    by_flag = F.when(F.coalesce("is_write", F.lit(False)), "write").otherwise("read")
    return out.withColumn("kind", F.when(F.col("command") == "fstring_path", by_flag).otherwise(F.col("kind")))


def accesses(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, script, kind, path, command, status, pattern), each once: what scripts read, write and erase."""
    each = routed(events).where("kind IS NOT NULL").select(*by, "script", "kind", F.explode("normalized_paths").alias("path"), "command", F.col("resolution_status").alias("status"), F.col("dynamic_pattern").alias("pattern"))
    return each.where("path IS NOT NULL").distinct()


def is_temporary(path: Column, patterns: list[str]) -> Column:
    """The name patterns; whether a path was erased comes from a join."""
    low = F.lower(path)
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def role(is_write: Column, has_producer: Column, placeholder: Column, temporary: Column, path: Column, c: Classification) -> Column:
    """The role of an artifact in one access, first rule that holds."""
    ext = F.lower(paths.suffix(path))
    deliverable = ext.isin([e.lower() if e.startswith(".") else f".{e.lower()}" for e in c.deliverable_extensions])
    return (
        F.when(placeholder, "placeholder_artifact")
        .when(temporary, "temporary")
        .when(~is_write & ~has_producer, "reference_input")
        .when(is_write & deliverable, "deliverable")
        .when(has_producer & (ext == ".dta"), "intermediate")
        .when(has_producer, "generated_artifact")
        .otherwise("artifact")
    )


def usage(acc: DataFrame, by: list[str]) -> DataFrame:
    """(by, path, n_consumers, n_producers, consumer, erased) of every path. consumer is the only consumer if there is one; sets of scripts are never collected."""
    per_script = acc.groupBy(*by, "path", "script", "kind").agg(F.lit(1).alias("_one"))
    of = lambda k: F.count_if(F.col("kind") == k)
    return per_script.groupBy(*by, "path").agg(of("read").alias("n_consumers"), of("write").alias("n_producers"), F.min(F.when(F.col("kind") == "read", F.col("script"))).alias("consumer"), (of("erase") > 0).alias("erased"))


def classified(events: DataFrame, by: list[str], c: Classification | None = None, suppress: bool = True, show_temporary: bool = False) -> DataFrame:
    """(by, script, kind, path, command, status, pattern, role, suppressed, unconsumed) of all reads and writes: G05 to G07.

    A deliverable that another script than its writer reads is intermediate, unless its suffix is one for presentation. A fully resolved
    write that is no deliverable and that nobody but its writer reads is suppressed together with the writer's reads of it; hidden
    temporary files are suppressed as well.
    """
    c = c or Classification()
    acc = accesses(events, by)
    joined = acc.where("kind <> 'erase'").join(usage(acc, by), [*by, "path"])
    write = F.col("kind") == "write"
    temporary = is_temporary(F.col("path"), c.temporary_name_patterns) | F.col("erased")
    # a consumer other than the script: several, or one that is another
    elsewhere = (F.col("n_consumers") > 1) | ((F.col("n_consumers") == 1) & (F.col("consumer") != F.col("script")))
    first = role(write, F.col("n_producers") > 0, F.coalesce(F.col("status"), F.lit("")) != "full", temporary, F.col("path"), c)
    shown = F.lower(paths.suffix(F.col("path"))).isin(PRESENTATION_SUFFIXES)
    final = F.when((first == "deliverable") & elsewhere & ~shown, "intermediate").otherwise(first)
    out = joined.withColumn("role", final).withColumn("_temporary", temporary)
    own = write & (F.col("status") == "full")
    internal = own & F.when(F.col("_temporary"), F.lit(not show_temporary)).otherwise((F.col("role") != "deliverable") & ~elsewhere)
    hits = out.where(internal & F.lit(suppress)).select(*by, "script", "path", F.lit(True).alias("_hit")).distinct()
    out = out.join(hits, [*by, "script", "path"], "left").withColumn("suppressed", F.coalesce("_hit", F.lit(False)))
    unconsumed = own & ~F.col("_temporary") & F.col("suppressed") & (F.col("n_consumers") == 0)
    return out.select(*by, "script", "kind", "path", "command", "status", "pattern", "role", "suppressed", unconsumed.alias("unconsumed"), "erased")


def data_edges(acc: DataFrame, by: list[str], show_temporary: bool = False) -> DataFrame:
    """(by, source, target, operation, kind, visible_label, phase) of classified accesses; reads are phase 2, writes phase 3."""
    keep = acc.where(~F.col("suppressed") & ((F.col("kind") == "read") | (F.col("role") != "temporary") | F.lit(show_temporary)))
    read = F.col("kind") == "read"
    return keep.select(
        *by, F.when(read, F.col("path")).otherwise(F.col("script")).alias("source"), F.when(read, F.col("script")).otherwise(F.col("path")).alias("target"), F.col("command").alias("operation"),
        F.col("role").alias("kind"), F.col("command").alias("visible_label"), F.when(read, 2).otherwise(3).alias("phase"), "status", "pattern",
    )


def call_edges(calls: DataFrame, by: list[str]) -> DataFrame:
    """Edges of (by, script, child): Stata's do leads from caller to child, import and source from child to caller; duplicates stay."""
    lang = language_of(F.col("script"))
    down = ~lang.isin("python", "r")
    op = F.when(lang == "stata", "do").when(lang == "python", "import").when(lang == "r", "source").otherwise("call")
    none = F.lit(None).cast("string")
    return calls.select(*by, F.when(down, F.col("script")).otherwise(F.col("child")).alias("source"), F.when(down, F.col("child")).otherwise(F.col("script")).alias("target"), op.alias("operation"), F.lit("script_call").alias("kind"), none.alias("visible_label"), F.lit(1).alias("phase"), none.alias("status"), none.alias("pattern"))


def artifact_nodes(acc: DataFrame, by: list[str], show_temporary: bool = False) -> DataFrame:
    """(by, node_id, label, node_type, path, role, metadata) of the artifacts of classified accesses.

    The first access in order (reads before writes, then by script, path, command, status, pattern) makes the node; the role of a write
    that outweighs its role replaces it.
    """
    keep = acc.where(~F.col("suppressed") & ((F.col("kind") == "read") | (F.col("role") != "temporary") | F.lit(show_temporary)))
    write = F.col("kind") == "write"
    order = F.struct(F.when(write, 2).otherwise(1), "script", "path", "command", "status", "pattern")
    priority = F.coalesce(*(F.when(F.col("role") == r, p) for r, p in ROLE_PRIORITY.items()), F.lit(0))
    of = keep.groupBy(*by, "path").agg(
        F.min_by(F.struct("role", "status", "pattern", priority.alias("p")), order).alias("f"),
        F.max(F.when(write, F.struct(priority.alias("p"), "role"))).alias("w"),
        F.bool_or("erased").alias("erased"),
    )
    placeholder = F.col("f.status") != "full"
    metadata = F.map_filter(
        F.create_map(
            F.lit("dynamic_pattern"), F.col("f.pattern"), F.lit("resolution_status"), F.when(F.col("f.pattern").isNotNull(), F.col("f.status")),
            F.lit("erased"), F.when((F.col("f.role") == "temporary") & F.col("erased"), "true"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return of.select(
        *by, F.col("path").alias("node_id"), paths.basename(F.col("path")).alias("label"), F.when(placeholder, "artifact_placeholder").otherwise("artifact").alias("node_type"),
        F.when(~placeholder, F.col("path")).alias("path"), F.when(F.col("w.p") > F.col("f.p"), F.col("w.role")).otherwise(F.col("f.role")).alias("role"), metadata.alias("metadata"),
    )


def script_nodes(scripts: DataFrame, by: list[str]) -> DataFrame:
    """Nodes of (by, script), each once."""
    s = F.col("script")
    return scripts.select(*by, "script").distinct().select(*by, s.alias("node_id"), paths.basename(s).alias("label"), F.lit("script").alias("node_type"), s.alias("path"), F.lit("script").alias("role"), F.create_map(F.lit("language"), language_of(s)).alias("metadata"))


def diagnostic(level: str, code: str, message: Column, payload: dict[str, Column]) -> list[Column]:
    """The columns of a diagnostics row; payload entries that are NULL are left out."""
    pairs = [x for k, v in payload.items() for x in (F.lit(k), v.cast("string"))]
    entries = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return [F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"), entries.alias("payload")]


def event_diagnostics(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, level, code, message, payload, script, line) that single events give: absolute paths, dynamic paths, erased artifacts, unknown commands."""
    at = [*by, F.col("script"), F.col("line")]
    where = F.concat(F.col("script"), F.lit(":"), F.col("line").cast("string"))
    r = routed(events)
    absolute = r.where("was_absolute").select(*diagnostic("warning", "absolute_path_usage", F.concat(F.lit("Absolute path detected in "), where), {"script": F.col("script"), "path": F.array_join("normalized_paths", " | ")}), *at)
    pattern = F.coalesce("dynamic_pattern", "raw_path")
    partial = r.where("resolution_status = 'partial'").select(*diagnostic("info", "dynamic_path_partial_resolution", F.concat(F.lit("Dynamic path partially resolved in "), where), {"script": F.col("script"), "line": F.col("line"), "pattern": pattern}), *at)
    open_ = r.where("resolution_status NOT IN ('full', 'partial')").select(*diagnostic("warning", "dynamic_path_unresolved", F.concat(F.lit("Dynamic path unresolved in "), where), {"script": F.col("script"), "line": F.col("line"), "pattern": F.col("raw_path")}), *at)
    erased = r.where("kind = 'erase'").select("*", F.explode("normalized_paths").alias("_p")).select(*diagnostic("info", "erased_artifact", F.concat(F.lit("Artifact erased inside script: "), F.col("_p")), {"script": F.col("script"), "path": F.col("_p")}), *at)
    unknown = r.where("kind IS NULL").select(*diagnostic("warning", "unknown_command", F.concat(F.lit("Command is in no catalog: "), F.coalesce("command", F.lit("NULL"))), {"script": F.col("script"), "command": F.col("command")}), *at)
    return absolute.unionByName(partial).unionByName(open_).unionByName(erased).unionByName(unknown)


def temporary_summary(acc: DataFrame, by: list[str], show_temporary: bool = False) -> DataFrame:
    """(by, n_temporary, n_erased) of temporary outputs, hidden or shown."""
    t = acc.where("kind = 'write' AND role = 'temporary'")
    return t.groupBy(*by, "path").agg(F.bool_or("erased").alias("e")).groupBy(*by).agg(F.count("*").alias("n_temporary"), F.count_if("e").alias("n_erased"))
