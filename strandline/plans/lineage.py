"""Queries of the lineage operators over the lineage tables, and their SQL. Keys begin with the operator's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import config as cfg
from strandline.functions import paths
from strandline.operators import assemble, catalog, clustering, exclusions, graph, hierarchy, overrides, render, sections, validate, versions
from strandline.plans.problems import table

BY = ["project_id"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    """parsed_events in the shape of events: the project is a column of its own."""
    return table(spark, sf, "parsed_events")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes, each once: the first row of a (project, id) counts (G11's first-insert-wins)."""
    n = table(spark, sf, "nodes")
    first = F.min_by(F.struct("node_type", "path", "role", "cluster_id"), "node_row_id")
    return n.groupBy("project_id", "node_id").agg(first.alias("f")).select("project_id", "node_id", "f.node_type", "f.path", "f.role", "f.cluster_id")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "edges")


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """(project_id, node_id) of the ends of edges that are scripts by suffix."""
    e = edges(spark, sf)
    end = F.explode(F.array("source", "target"))
    return e.select("project_id", end.alias("node_id")).where(validate.ends_in_script(F.col("node_id"))).distinct()


def lang_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are scripts, with the language their text speaks."""
    d = table(spark, sf, "documents").where("source = 'script'")
    r = F.contains("text", F.lit("<-")) | F.contains("text", F.lit("library("))
    py = F.contains("text", F.lit("import ")) | F.contains("text", F.lit("pd.")) | F.contains("text", F.lit("df."))
    return d.select("doc_id", "text", F.when(r, "r").when(py, "python").otherwise("stata").alias("language"))


# SQL parts

_BASE = "regexp_extract({}, '[^/]*$')"
_EXT = r"lower(regexp_extract(regexp_extract({}, '[^/]*$'), '^.+(\.[^.]+)$', 1))"
_DIR = "regexp_replace({}, '/?[^/]*$', '')"
_NODES = "n AS (SELECT project_id, node_id, arg_min(f, node_row_id).t AS node_type, arg_min(f, node_row_id).p AS path, arg_min(f, node_row_id).r AS role, arg_min(f, node_row_id).c AS cluster_id FROM (SELECT *, {'t': node_type, 'p': path, 'r': role, 'c': cluster_id} AS f FROM nodes) GROUP BY project_id, node_id)"
_SCRIPT = r"regexp_matches({}, '\.(do|py|r|R)$')"
_LANG = "CASE WHEN {e} = '.do' THEN 'stata' WHEN {e} = '.py' THEN 'python' WHEN {e} = '.r' THEN 'r' ELSE 'unknown' END".format(e=_EXT.format("script"))
_KINDS = "kinds(l, c, kind) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in catalog.command_kinds()) + ")"
_ROUTED = f"{_KINDS}, lang AS (SELECT *, {_LANG} AS language FROM parsed_events), routed AS (SELECT lang.*, CASE WHEN command = 'fstring_path' THEN CASE WHEN coalesce(is_write, false) THEN 'write' ELSE 'read' END ELSE kinds.kind END AS kind FROM lang LEFT JOIN kinds ON l = language AND c = command)"
_ACC = f"{_ROUTED}, acc AS (SELECT DISTINCT project_id, script, kind, path, command, resolution_status AS status, dynamic_pattern AS pattern FROM (SELECT *, unnest(normalized_paths) AS path FROM routed WHERE kind IS NOT NULL) WHERE path IS NOT NULL)"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_TEMP = "(" + " OR ".join(f"contains(lower(a.path), '{p}')" for p in cfg.TEMPORARY_PATTERNS) + " OR u.erased)"
_CLASS = f"""{_ACC},
u AS (SELECT project_id, path, count(DISTINCT script) FILTER (WHERE kind = 'read') AS nc, count(DISTINCT script) FILTER (WHERE kind = 'write') AS np,
  coalesce(bool_or(kind = 'erase'), false) AS erased FROM acc GROUP BY project_id, path),
a1 AS (SELECT a.*, u.nc, u.np, u.erased, {_TEMP} AS tmp, {_EXT.format("a.path")} AS ext,
  EXISTS (SELECT 1 FROM acc o WHERE o.kind = 'read' AND o.project_id IS NOT DISTINCT FROM a.project_id AND o.path = a.path AND o.script <> a.script) AS elsewhere
  FROM acc a JOIN u ON u.project_id IS NOT DISTINCT FROM a.project_id AND u.path = a.path WHERE a.kind <> 'erase'),
a2 AS (SELECT *, CASE WHEN status IS DISTINCT FROM 'full' THEN 'placeholder_artifact' WHEN tmp THEN 'temporary' WHEN kind = 'read' AND np = 0 THEN 'reference_input'
  WHEN kind = 'write' AND ext IN ({_LIST(cfg.DELIVERABLE_SUFFIXES)}) THEN CASE WHEN elsewhere AND ext NOT IN ({_LIST(cfg.PRESENTATION_SUFFIXES)}) THEN 'intermediate' ELSE 'deliverable' END
  WHEN np > 0 AND ext = '.dta' THEN 'intermediate' WHEN np > 0 THEN 'generated_artifact' ELSE 'artifact' END AS role FROM a1),
hits AS (SELECT DISTINCT project_id, script, path FROM a2 WHERE kind = 'write' AND status = 'full' AND (tmp OR (role <> 'deliverable' AND NOT elsewhere))),
k AS (SELECT a2.*, h.path IS NOT NULL AS suppressed FROM a2 LEFT JOIN hits h ON h.project_id IS NOT DISTINCT FROM a2.project_id AND h.script = a2.script AND h.path = a2.path)"""

# C: paths

_WS = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    rf"""SELECT event_id, CASE WHEN v = '' THEN '' ELSE {_BASE.format('v')} END AS name, {_DIR.format('v')} AS folder, {_EXT.format('v')} AS ext,
  len(list_filter(string_split(v, '/'), lambda x: x NOT IN ('', '.')))::INTEGER AS depth,
  regexp_matches(raw_path, '^(/|\\\\|[A-Za-z]:[\\/])') AS was_absolute
FROM (SELECT event_id, raw_path, replace(raw_path, '\', '/') AS v FROM parsed_events WHERE raw_path IS NOT NULL)"""
)
def c12_path_parts(spark, sf):
    v = F.replace(F.col("raw_path"), F.lit("\\"), F.lit("/"))
    e = events(spark, sf).where("raw_path IS NOT NULL").withColumn("v", v)
    return e.select("event_id", paths.basename(F.col("v")).alias("name"), paths.parent_dir(F.col("v")).alias("folder"), F.lower(paths.suffix(F.col("v"))).alias("ext"), F.size(paths.parts(F.col("v"))).alias("depth"), paths.is_absolute(F.col("raw_path")).alias("was_absolute"))


@query()
def c01_normalized(spark, sf):
    return events(spark, sf).where("raw_path IS NOT NULL").select("event_id", paths.normalize_token(F.col("raw_path")).alias("path"), paths.is_bare_directory(F.col("raw_path")).alias("bare"))


@query()
def c09_project_relative(spark, sf):
    c = cfg.Normalization(path_prefix_aliases={"$gl_base": ".", "${GL_ROOT}": ".", "{BASE_DIR}": "."}, project_root_markers=["srv/proj"])
    r = paths.to_project_relative(F.col("raw_path"), "/work/project", c).alias("r")
    return events(spark, sf).where("raw_path IS NOT NULL").select("event_id", r).select("event_id", "r.value", "r.was_absolute")


@query(r"SELECT node_row_id, regexp_replace(path, '(?i)(?:_v\d+|_(?:qc|pp|final|draft))(\.[^./]+)$', '\1') AS family FROM nodes WHERE regexp_matches(path, '(?i)(?:_v\d+|_(?:qc|pp|final|draft))(\.[^./]+)$')")
def c18_family_key(spark, sf):
    return table(spark, sf, "nodes").select("node_row_id", paths.family_key(F.col("path")).alias("family")).where("family IS NOT NULL")


@query(
    f"""WITH e AS (SELECT DISTINCT {_DIR.format('source')} AS a, {_DIR.format('target')} AS b FROM edges),
p AS (SELECT a, b, list_filter(string_split(a, '/'), lambda x: x <> '') AS x, list_filter(string_split(b, '/'), lambda x: x <> '') AS y FROM e)
SELECT a, b, (len(x) + len(y) - 2 * len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])))::INTEGER AS distance FROM p"""
)
def c13_dir_distance(spark, sf):
    e = edges(spark, sf).select(paths.parent_dir(F.col("source")).alias("a"), paths.parent_dir(F.col("target")).alias("b")).distinct()
    return e.withColumn("distance", paths.dir_distance(F.col("a"), F.col("b")))


@query(f"WITH {_NODES} SELECT project_id, node_id, array_to_string(string_split(node_id, '/')[-2:], '/') AS label FROM n WHERE node_id IS NOT NULL")
def c22_labels(spark, sf):
    return nodes(spark, sf).where("node_id IS NOT NULL").select("project_id", "node_id", paths.label(F.col("node_id"), depth=1).alias("label"))


_XML = "replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"""SELECT message, array_to_string(list_transform(string_split({_XML}, ''), lambda x: CASE WHEN unicode(x) > 127 THEN '&#' || unicode(x) || ';' ELSE x END), '') AS escaped,
  '"' || replace(replace(message, '\\', '\\\\'), '"', '\\"') || '"' AS quoted FROM (SELECT DISTINCT message FROM diagnostics WHERE message IS NOT NULL)"""
)
def c23_escaped(spark, sf):
    d = table(spark, sf, "diagnostics").where("message IS NOT NULL").select("message").distinct()
    return d.select("message", paths.xml_escape(F.col("message")).alias("escaped"), paths.yaml_quote(F.col("message")).alias("quoted"))


@query(
    r"""WITH e AS (SELECT event_id, list_filter(string_split(regexp_replace(replace(raw_path, '\', '/'), '/+', '/', 'g'), '/'), lambda x: x NOT IN ('', '.')) AS p FROM parsed_events WHERE regexp_matches(raw_path, '^(/|\\\\|[A-Za-z]:[\\/])')),
s AS (SELECT event_id, i, array_to_string(p[i:], '/') AS path FROM (SELECT event_id, p, unnest(range(1, len(p) + 1)) AS i FROM e))
SELECT event_id, arg_min(path, i) AS existing FROM s WHERE path IN (SELECT id FROM snapshot_left) GROUP BY event_id"""
)
def c07_existing_suffix(spark, sf):
    """Of absolute paths: the longest suffix that is a file of the snapshot."""
    e = events(spark, sf).where(paths.is_absolute(F.col("raw_path")))
    clean = F.regexp_replace(F.replace("raw_path", F.lit("\\"), F.lit("/")), "/+", "/")
    s = e.select("event_id", F.posexplode(paths.suffixes(clean)).alias("i", "path"))
    files = table(spark, sf, "snapshot_left").select(F.col("id").alias("path")).distinct()
    return s.join(files, "path", "left_semi").groupBy("event_id").agg(F.min_by("path", "i").alias("existing"))


@query(r"""SELECT doc_id, line, CASE WHEN regexp_matches(text, '(?:"([^"]*)"|''([^'']*)'')') THEN regexp_extract(text, '(?:"([^"]*)"|''([^'']*)'')', 1) || regexp_extract(text, '(?:"([^"]*)"|''([^'']*)'')', 2) END AS literal, regexp_matches(text, '(https?|ftp|s3|gs)://') AS external
FROM (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1)::INTEGER AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM documents WHERE source = 'script' AND text IS NOT NULL)) WHERE regexp_matches(text, '(?:"([^"]*)"|''([^'']*)'')')""")
def c21_quoted_literals(spark, sf):
    """The first quoted literal of each script line that has one, and whether the line names a service."""
    lines = catalog.split_lines(table(spark, sf, "documents").where("source = 'script'"), ["doc_id"])
    return lines.select("doc_id", "line", paths.first_quoted(F.col("text")).alias("literal"), F.col("text").rlike("(https?|ftp|s3|gs)://").alias("external")).where("literal IS NOT NULL")


#: What Unicode counts as white space; RE2's \s knows ASCII only.
_UWS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"SELECT path, regexp_replace(replace(regexp_replace(path, '^{_UWS}+|{_UWS}+$', '', 'g'), '\', '/'), '^\./', '') AS cleaned FROM (SELECT DISTINCT path FROM nodes WHERE path IS NOT NULL)")
def c16_manual_paths(spark, sf):
    n = table(spark, sf, "nodes").where("path IS NOT NULL").select("path").distinct()
    return n.select("path", paths.manual_path(F.col("path")).alias("cleaned"))


# D: exclusions

_RULES = cfg.Exclusions(prefixes=["prj_hub/tmp/"], globs=["*.pkl", "shared/*/*.rds"], folder_names=["annex"], exact_names=["housing_v1.csv"], presets=["archival_folders"])


@query(
    r"""SELECT node_row_id, (p = 'prj_hub/tmp' OR starts_with(p, 'prj_hub/tmp/') OR regexp_extract(p, '[^/]*$') = 'housing_v1.csv'
  OR list_has_any(CASE WHEN ends_with(path, '/') THEN string_split(p, '/') ELSE string_split(p, '/')[:-2] END, ['annex', 'archive', '~old', 'old', 'backup'])
  OR regexp_matches(p, '(?:^|/)[^/]*\.pkl$|(?:^|/)shared/[^/]*/[^/]*\.rds$|(?:^|/)[^/]*\.bak$')) AS excluded
FROM (SELECT node_row_id, path, CASE WHEN starts_with(path, '/') THEN '/' ELSE '' END || array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') AS p FROM nodes WHERE path IS NOT NULL)"""
)
def d03_excluded(spark, sf):
    """Of every path: folders, repeated slashes and dots are folded before the test."""
    n = table(spark, sf, "nodes").where("path IS NOT NULL")
    return n.select("node_row_id", exclusions.excluded(F.col("path"), _RULES).alias("excluded"))


@query("SELECT DISTINCT path, (" + " OR ".join(f"contains(lower(path), '{p}')" for p in cfg.TEMPORARY_PATTERNS) + ") AS temporary FROM nodes WHERE path IS NOT NULL")
def d09_temporary(spark, sf):
    n = table(spark, sf, "nodes").where("path IS NOT NULL").select("path").distinct()
    return n.select("path", assemble.is_temporary(F.col("path"), cfg.TEMPORARY_PATTERNS).alias("temporary"))


@query(f"WITH {_NODES} SELECT project_id, node_id FROM n WHERE node_type IN ('artifact', 'artifact_placeholder') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.source = n.node_id)")
def d12_terminal_artifacts(spark, sf):
    return render.terminal_artifacts(nodes(spark, sf), edges(spark, sf), BY)


# E: command catalog


def _script_lines_sql() -> str:
    docs = "SELECT doc_id, text, CASE WHEN contains(text, '<-') OR contains(text, 'library(') THEN 'r' WHEN contains(text, 'import ') OR contains(text, 'pd.') OR contains(text, 'df.') THEN 'python' ELSE 'stata' END AS language FROM documents WHERE source = 'script' AND text IS NOT NULL"
    lines = "SELECT doc_id, language, unnest(x) AS text, generate_subscripts(x, 1)::INTEGER AS line FROM (SELECT doc_id, language, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM d)"
    return f"d AS ({docs}), l AS MATERIALIZED ({lines})"


def _line_events_sql() -> str:
    """The catalog as one chain of conditions for each language and kind."""
    out = []
    for kind in ("read", "write", "erase", "call"):
        for lang in ("stata", "python", "r"):
            rows = [c for c in catalog.CATALOG if (c.language, c.kind) == (lang, kind)]
            if not rows:
                continue
            q = lambda x: x.replace("'", "''")
            which = " ".join(f"WHEN regexp_matches(text, '{q(c.regex)}') THEN '{c.command}'" for c in rows)
            path = " ".join(f"WHEN regexp_matches(text, '{q(c.regex)}') THEN coalesce(nullif(regexp_extract(text, '{q(c.regex)}', 1), ''), regexp_extract(text, '{q(c.regex)}', 2))" for c in rows)
            out.append(f"SELECT doc_id, language, line, '{kind}' AS kind, CASE {which} END AS command, CASE {path} END AS raw_path FROM l WHERE language = '{lang}'")
    return f"WITH {_script_lines_sql()} SELECT * FROM ({' UNION ALL '.join(out)}) WHERE command IS NOT NULL"


@query(_line_events_sql())
def e01_line_events(spark, sf):
    d = lang_docs(spark, sf)
    return catalog.line_events(catalog.split_lines(d, ["doc_id", "language"]), F.col("language")).select("doc_id", "language", "line", "kind", "command", "raw_path")


@query(
    "SELECT doc_id, ordinality::INTEGER AS line, text FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS ordinality FROM documents WHERE text IS NOT NULL AND source = 'script')"
)
def o01_lines(spark, sf):
    return catalog.split_lines(table(spark, sf, "documents").where("source = 'script'"), ["doc_id"])


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}', {}, '{}', '{}')".format(c.language, c.kind, i, c.command, c.regex.replace("'", "''")) for i, c in enumerate(catalog.CATALOG)) + ") t(language, kind, priority, command, regex)")
def e00_catalog(spark, sf):
    return catalog.catalog_table(spark)


# F: order of scripts, inherited values


def _calls(spark, sf):
    """(parent, child) calls between scripts."""
    return hierarchy.clean_links(table(spark, sf, "script_results"), "script", "script", "child_scripts").select("parent", "child")


@query(
    """WITH RECURSIVE raw AS (SELECT regexp_replace(script, '^\\s+|\\s+$', '', 'g') AS p, unnest(CASE WHEN len(child_scripts) > 0 THEN child_scripts ELSE [NULL] END) AS c FROM script_results),
l AS (SELECT DISTINCT p, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS c FROM raw WHERE p IS NOT NULL),
v AS (SELECT p AS node FROM l UNION SELECT c FROM l WHERE c IS NOT NULL),
r AS (SELECT node, 0 AS level FROM v WHERE node NOT IN (SELECT c FROM l WHERE c IS NOT NULL) UNION ALL SELECT l.c, r.level + 1 FROM r JOIN l ON l.p = r.node WHERE l.c IS NOT NULL)
SELECT v.node, coalesce(max(r.level), -1)::INTEGER AS level FROM v LEFT JOIN r ON r.node = v.node GROUP BY v.node"""
)
def f20_levels(spark, sf):
    """Topological levels of scripts; -1 on and behind rings."""
    c = _calls(spark, sf)
    v = c.select(F.col("parent").alias("node")).union(c.where("child IS NOT NULL").select("child")).distinct()
    return graph.levels(v, c.where("child IS NOT NULL"))


@query(
    """WITH l AS (SELECT DISTINCT regexp_replace(script, '^\\s+|\\s+$', '', 'g') AS p, regexp_replace(unnest(child_scripts), '^\\s+|\\s+$', '', 'g') AS c FROM script_results WHERE script IS NOT NULL),
g AS (SELECT regexp_replace(script, '^\\s+|\\s+$', '', 'g') AS p, unnest(map_keys(globals_map)) AS name, unnest(map_values(globals_map)) AS value, result_id FROM script_results)
SELECT l.c AS script, g.name, arg_max(g.value, {'p': g.p, 'r': g.result_id}) AS value FROM l JOIN g ON g.p = l.p WHERE l.c IS NOT NULL GROUP BY ALL"""
)
def f21_inherited(spark, sf):
    """The values a script inherits from those that call it; of several the last caller's."""
    s = table(spark, sf, "script_results")
    own = s.select(F.regexp_replace("script", r"(?U)^\s+|\s+$", "").alias("parent"), "result_id", F.explode("globals_map").alias("name", "value"))
    return _calls(spark, sf).where("child IS NOT NULL").join(own, "parent").groupBy(F.col("child").alias("script"), "name").agg(F.max_by("value", F.struct("parent", "result_id")).alias("value"))


# G: assembly


@query(f"WITH {_ROUTED} SELECT language, kind, command, count(*) AS n FROM routed GROUP BY ALL")
def g01_routing(spark, sf):
    return assemble.routed(events(spark, sf)).groupBy("language", "kind", "command").agg(F.count("*").alias("n"))


@query(f"WITH {_ACC} SELECT * FROM acc")
def g02_accesses(spark, sf):
    return assemble.accesses(events(spark, sf), BY)


@query(f"WITH {_ACC} SELECT project_id, path, count(DISTINCT script) FILTER (WHERE kind = 'read') AS n_consumers, count(DISTINCT script) FILTER (WHERE kind = 'write') AS n_producers, coalesce(bool_or(kind = 'erase'), false) AS erased FROM acc GROUP BY ALL")
def g03_usage(spark, sf):
    return assemble.usage(assemble.accesses(events(spark, sf), BY), BY).drop("consumer")


@query(f"WITH {_CLASS} SELECT project_id, script, kind, path, command, status, pattern, role, suppressed FROM k")
def g05_roles(spark, sf):
    return assemble.classified(events(spark, sf), BY).drop("unconsumed", "erased")


@query(f"WITH {_CLASS} SELECT DISTINCT project_id, path FROM k WHERE kind = 'write' AND status = 'full' AND NOT tmp AND suppressed AND nc = 0 AND role <> 'deliverable' AND NOT elsewhere")
def g07_internal_unconsumed(spark, sf):
    return assemble.classified(events(spark, sf), BY).where("unconsumed").select(*BY, "path").distinct()


@query(
    f"""WITH {_CLASS}, shown AS (SELECT * FROM k WHERE NOT suppressed AND (kind = 'read' OR role <> 'temporary'))
SELECT project_id, CASE WHEN kind = 'read' THEN path ELSE script END AS source, CASE WHEN kind = 'read' THEN script ELSE path END AS target, command AS operation, role AS kind, command AS visible_label,
  CASE WHEN kind = 'read' THEN 2 ELSE 3 END AS phase FROM shown"""
)
def g08_edges(spark, sf):
    return assemble.data_edges(assemble.classified(events(spark, sf), BY), BY).drop("status", "pattern")


@query(
    """WITH c AS (SELECT project_id, regexp_replace(script, '^\\s+|\\s+$', '', 'g') AS script, regexp_replace(unnest(child_scripts), '^\\s+|\\s+$', '', 'g') AS child FROM script_results),
d AS (SELECT DISTINCT *, lower(regexp_extract(script, '\\.[^.]+$')) AS e FROM c WHERE child IS NOT NULL AND child <> '' AND script IS NOT NULL)
SELECT project_id, CASE WHEN e IN ('.py', '.r') THEN child ELSE script END AS source, CASE WHEN e IN ('.py', '.r') THEN script ELSE child END AS target,
  CASE e WHEN '.do' THEN 'do' WHEN '.py' THEN 'import' WHEN '.r' THEN 'source' ELSE 'call' END AS operation FROM d"""
)
def g10_call_edges(spark, sf):
    ends = r"(?U)^\s+|\s+$"
    c = table(spark, sf, "script_results").select("project_id", F.regexp_replace("script", ends, "").alias("script"), F.explode("child_scripts").alias("child"))
    c = c.withColumn("child", F.regexp_replace("child", ends, "")).where("child <> '' AND script IS NOT NULL").distinct()
    return assemble.call_edges(c, BY).select("project_id", "source", "target", "operation")


@query(
    f"""WITH {_CLASS}, shown AS (SELECT *, CASE role WHEN 'deliverable' THEN 3 WHEN 'intermediate' THEN 2 WHEN 'generated_artifact' THEN 1 ELSE 0 END AS pr FROM k WHERE NOT suppressed AND (kind = 'read' OR role <> 'temporary')),
f AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY project_id, path ORDER BY CASE WHEN kind = 'write' THEN 2 ELSE 1 END, script, path, command, status NULLS FIRST, pattern NULLS FIRST) = 1),
w AS (SELECT project_id, path, max(pr) AS pr, arg_max(role, {{'p': pr, 'r': role}}) AS role FROM shown WHERE kind = 'write' GROUP BY ALL)
SELECT f.project_id, f.path AS node_id, {_BASE.format('f.path')} AS label, CASE WHEN f.status = 'full' THEN 'artifact' ELSE 'artifact_placeholder' END AS node_type,
  CASE WHEN f.status = 'full' THEN f.path END AS path, CASE WHEN w.pr > f.pr THEN w.role ELSE f.role END AS role FROM f LEFT JOIN w ON w.project_id IS NOT DISTINCT FROM f.project_id AND w.path = f.path"""
)
def g11_nodes(spark, sf):
    return assemble.artifact_nodes(assemble.classified(events(spark, sf), BY), BY).drop("metadata")


@query(
    f"""WITH {_ROUTED}, s AS (SELECT *, script || ':' || line::VARCHAR AS place FROM routed)
SELECT project_id, 'absolute_path_usage' AS code, script, line, 'Absolute path detected in ' || place AS message FROM s WHERE was_absolute
UNION ALL SELECT project_id, 'dynamic_path_partial_resolution', script, line, 'Dynamic path partially resolved in ' || place FROM s WHERE resolution_status = 'partial'
UNION ALL SELECT project_id, 'dynamic_path_unresolved', script, line, 'Dynamic path unresolved in ' || place FROM s WHERE resolution_status NOT IN ('full', 'partial')
UNION ALL SELECT project_id, 'erased_artifact', script, line, 'Artifact erased inside script: ' || p FROM (SELECT *, unnest(normalized_paths) AS p FROM s WHERE kind = 'erase')
UNION ALL SELECT project_id, 'unknown_command', script, line, 'Command is in no catalog: ' || coalesce(command, 'NULL') FROM s WHERE kind IS NULL"""
)
def g12_event_diagnostics(spark, sf):
    return assemble.event_diagnostics(events(spark, sf), BY).select("project_id", "code", "script", "line", "message")


@query(f"WITH {_CLASS} SELECT project_id, count(*) AS n_temporary, count(*) FILTER (WHERE e) AS n_erased FROM (SELECT project_id, path, bool_or(erased) AS e FROM k WHERE kind = 'write' AND role = 'temporary' GROUP BY ALL) GROUP BY project_id")
def g13_temporary(spark, sf):
    return assemble.temporary_summary(assemble.classified(events(spark, sf), BY), BY)


# H: version families

_FAM = r"regexp_replace(path, '(?i)(?:_v\d+|_(?:qc|pp|final|draft))(\.[^./]+)$', '\1')"
_MEMBERS = f"{_NODES}, m AS (SELECT DISTINCT project_id, {_FAM} AS family, path AS member FROM n WHERE node_type LIKE 'artifact%' AND path IS NOT NULL AND {_FAM} <> path)"
_SNAP = "files AS (SELECT project_id, id AS path, max(mtime) AS mtime FROM snapshot_left GROUP BY ALL)"


def _files(spark, sf):
    """Modification times of files: those of the snapshot."""
    s = table(spark, sf, "snapshot_left")
    return s.groupBy("project_id", F.col("id").alias("path")).agg(F.max("mtime").alias("mtime"))


@query(f"WITH {_MEMBERS} SELECT project_id, family, array_to_string(list_sort(list(member))[1:1000], ' | ') AS members, count(*) AS n_members FROM m GROUP BY ALL HAVING count(*) > 1")
def h01_families(spark, sf):
    return versions.families(nodes(spark, sf), BY)


@query(f"WITH {_MEMBERS}, {_SNAP}, t AS (SELECT m.project_id, family, mtime, count(*) AS n FROM m JOIN files f ON f.project_id = m.project_id AND f.path = m.member GROUP BY ALL) SELECT project_id, family, mtime, n FROM (SELECT *, row_number() OVER (PARTITION BY project_id, family ORDER BY mtime DESC) AS r FROM t) WHERE r = 1 AND n > 1")
def h02_newest_ties(spark, sf):
    return versions.newest_ties(versions.members(nodes(spark, sf), BY), _files(spark, sf), BY)


def _chosen(spark, sf, mode):
    v = cfg.VersionFamilies(mode=mode)
    return versions.canonical(versions.members(nodes(spark, sf), BY), BY, v, _files(spark, sf))


_PICK = "WITH {m}, {s}, j AS (SELECT m.*, f.mtime, {score} AS score FROM m LEFT JOIN files f ON f.project_id = m.project_id AND f.path = m.member), b AS (SELECT project_id, family, count(*) AS c FROM m GROUP BY ALL HAVING count(*) > 1), k AS (SELECT * FROM j WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, family ORDER BY score DESC, mtime DESC NULLS LAST, member DESC) = 1) SELECT b.project_id, b.family, k.member AS canonical FROM b LEFT JOIN k ON k.project_id = b.project_id AND k.family = b.family"


@query(_PICK.format(m=_MEMBERS, s=_SNAP, score="f.mtime"))
def h03_latest_modified(spark, sf):
    return _chosen(spark, sf, "latest_modified")


@query(_PICK.format(m=_MEMBERS, s=_SNAP, score=r"try_cast(nullif(regexp_extract(member, '(?i)_v(\d+)\.[^./]+$', 1), '') AS BIGINT)"))
def h04_highest_numeric(spark, sf):
    return _chosen(spark, sf, "highest_numeric")


@query(_PICK.format(m=_MEMBERS, s=_SNAP, score=r"CASE lower(regexp_extract(member, '(?i)_([a-z][a-z0-9]*)\.[^./]+$', 1)) WHEN 'qc' THEN 0 WHEN 'pp' THEN -1 WHEN 'final' THEN -2 WHEN 'draft' THEN -3 END"))
def h05_priority_suffix(spark, sf):
    return _chosen(spark, sf, "priority_suffix")


@query(
    "WITH RECURSIVE "
    + _PICK.format(m=_MEMBERS, s=_SNAP, score=r"try_cast(nullif(regexp_extract(member, '(?i)_v(\d+)\.[^./]+$', 1), '') AS BIGINT)").removeprefix("WITH ").replace(" SELECT b.project_id, b.family, k.member", ", chosen AS (SELECT b.project_id, b.family, k.member", 1)
    + """), d AS (SELECT m.project_id, m.member, c.canonical FROM m JOIN chosen c ON c.project_id = m.project_id AND c.family = m.family WHERE c.canonical IS NOT NULL AND m.member <> c.canonical)
SELECT e.project_id, coalesce(a.canonical, source) AS source, coalesce(z.canonical, target) AS target, operation, kind, visible_label, min(edge_ord) AS edge_ord
FROM edges e LEFT JOIN d a ON a.project_id = e.project_id AND a.member = e.source LEFT JOIN d z ON z.project_id = e.project_id AND z.member = e.target GROUP BY ALL"""
)
def h06_collapsed_edges(spark, sf):
    mem = versions.members(nodes(spark, sf), BY)
    return versions.collapse(nodes(spark, sf), edges(spark, sf), mem, _chosen(spark, sf, "highest_numeric"), BY)[1]


@query("SELECT project_id, source, target, operation, kind, visible_label, min(edge_ord) AS edge_ord FROM edges GROUP BY ALL")
def h07_edge_dedup(spark, sf):
    return versions.dedupe_edges(edges(spark, sf), BY)


# I: clustering

_DEPS = f"""e AS (SELECT DISTINCT project_id, source, target, {_SCRIPT.format('source')} AS s, {_SCRIPT.format('target')} AS t FROM edges),
deps AS (SELECT project_id, source, target FROM e WHERE s AND t AND source <> target
  UNION SELECT w.project_id, w.source, r.target FROM e w JOIN e r ON w.project_id = r.project_id AND w.target = r.source WHERE w.s AND NOT w.t AND NOT r.s AND r.t AND w.source <> r.target),
fl AS (SELECT DISTINCT project_id, {_DIR.format('source')} AS a, {_DIR.format('target')} AS b FROM deps WHERE {_DIR.format('source')} <> {_DIR.format('target')})"""
_MERGE = """mg AS (SELECT fl.project_id, fl.a, fl.b FROM fl WHERE (SELECT count(*) FROM fl x WHERE x.project_id = fl.project_id AND x.a = fl.a) = 1 AND (SELECT count(*) FROM fl x WHERE x.project_id = fl.project_id AND x.b = fl.b) = 1
  AND len(string_split(fl.a, '/')) + len(string_split(fl.b, '/')) - 2 * len(list_filter(range(1, least(len(string_split(fl.a, '/')), len(string_split(fl.b, '/'))) + 1), lambda i: string_split(fl.a, '/')[1:i] = string_split(fl.b, '/')[1:i])) <= 2)"""


@query(f"WITH {_DEPS} SELECT * FROM deps")
def i02_script_dependencies(spark, sf):
    return clustering.script_dependencies(edges(spark, sf), scripts(spark, sf), BY)


@query(f"WITH {_DEPS} SELECT project_id, folder, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT project_id, a AS folder, 1 AS o, 0 AS i FROM fl UNION ALL SELECT project_id, b, 0, 1 FROM fl) GROUP BY ALL")
def i03_folder_degrees(spark, sf):
    links = clustering.folder_links(edges(spark, sf), scripts(spark, sf), BY)
    d = validate.degrees(links.withColumnsRenamed({"a": "source", "b": "target"}), BY)
    return d.select("project_id", F.col("node_id").alias("folder"), "n_out", "n_in")


@query(f"WITH {_DEPS}, {_MERGE} SELECT * FROM mg")
def i04_mergeable_folders(spark, sf):
    return clustering.mergeable(clustering.folder_links(edges(spark, sf), scripts(spark, sf), BY), BY)


@query(
    f"""WITH RECURSIVE {_DEPS}, {_MERGE},
sc AS (SELECT DISTINCT project_id, x AS node_id, {_DIR.format('x')} AS folder FROM (SELECT project_id, unnest([source, target]) AS x FROM edges) WHERE {_SCRIPT.format('x')}),
fo AS (SELECT DISTINCT project_id, folder FROM sc), both_ AS (SELECT project_id, a, b FROM mg UNION SELECT project_id, b, a FROM mg),
reach AS (SELECT project_id, folder AS v, folder AS c FROM fo UNION SELECT r.project_id, r.v, x.b FROM reach r JOIN both_ x ON x.project_id = r.project_id AND x.a = r.c),
comp AS (SELECT project_id, v AS folder, min(c) AS first FROM reach GROUP BY ALL),
num AS (SELECT project_id, first, row_number() OVER (PARTITION BY project_id ORDER BY first) AS i FROM (SELECT DISTINCT project_id, first FROM comp))
SELECT sc.project_id, sc.node_id, 'cluster_' || lpad(i::VARCHAR, 3, '0') AS cluster_id, (1000 + i)::INTEGER AS cluster_order FROM sc JOIN comp ON comp.project_id = sc.project_id AND comp.folder = sc.folder JOIN num ON num.project_id = comp.project_id AND num.first = comp.first"""
)
def i05_clusters(spark, sf):
    return clustering.clusters(edges(spark, sf), scripts(spark, sf), BY).select("project_id", "node_id", "cluster_id", "cluster_order")


@query(
    f"""WITH {_NODES}, s AS (SELECT * FROM n WHERE node_type = 'script' AND cluster_id IS NOT NULL),
b AS (SELECT project_id, source AS a, target AS s FROM edges UNION ALL SELECT project_id, target, source FROM edges)
SELECT b.project_id, b.a AS node_id, min(s.cluster_id) AS cluster_id FROM b JOIN s ON s.project_id = b.project_id AND s.node_id = b.s JOIN n ON n.project_id = b.project_id AND n.node_id = b.a AND n.node_type LIKE 'artifact%' GROUP BY ALL HAVING count(DISTINCT s.cluster_id) = 1"""
)
def i07_artifact_clusters(spark, sf):
    return clustering.artifact_clusters(edges(spark, sf), nodes(spark, sf), BY)


# J: clusters by hand

_ORD = "cluster_row_id"


@query(
    """WITH c AS (SELECT *, trim(cluster_id) AS cid, try_cast(metadata['order'] AS INTEGER) AS o FROM clusters WHERE trim(cluster_id) <> '')
SELECT project_id, cid AS cluster_id, coalesce(arg_max(label, cluster_row_id) FILTER (WHERE label IS NOT NULL), cid) AS label, coalesce(arg_max(o, cluster_row_id) FILTER (WHERE o IS NOT NULL), 1000000) AS cluster_order,
  coalesce(arg_max(metadata['collapse'], cluster_row_id) FILTER (WHERE metadata['collapse'] IS NOT NULL), 'false') AS collapse, coalesce(arg_max(metadata['kind'], cluster_row_id) FILTER (WHERE metadata['kind'] IS NOT NULL), 'auto') AS kind, count(*) AS n_definitions
FROM c GROUP BY project_id, cid"""
)
def j01_definitions(spark, sf):
    return overrides.latest_definitions(table(spark, sf, "clusters"), BY, F.col(_ORD))


_ASSIGNED = "asg AS (SELECT project_id, node_id, arg_max(cluster_id, {'r': cluster_row_id, 'p': p}) AS cluster_id FROM (SELECT project_id, cluster_id, cluster_row_id, unnest(node_ids) AS node_id, generate_subscripts(node_ids, 1) AS p FROM clusters) WHERE node_id IS NOT NULL GROUP BY project_id, node_id)"


@query(f"WITH {_ASSIGNED} SELECT * FROM asg")
def j02_assignments(spark, sf):
    return overrides.assignments(table(spark, sf, "clusters"), BY, F.col(_ORD))


@query(f"WITH {_ASSIGNED} SELECT * FROM asg WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.project_id = asg.project_id AND n.node_id = asg.node_id)")
def j03_missing_members(spark, sf):
    return overrides.missing_members(overrides.assignments(table(spark, sf, "clusters"), BY, F.col(_ORD)), table(spark, sf, "nodes"), BY)


@query("SELECT project_id, trim(cluster_id) AS cluster_id FROM clusters GROUP BY project_id, trim(cluster_id) HAVING max(coalesce(len(list_filter(node_ids, lambda x: x IS NOT NULL)), 0) + coalesce(len(list_filter(member_cluster_ids, lambda x: x IS NOT NULL)), 0)) = 0")
def j04_empty_clusters(spark, sf):
    return overrides.empty_clusters(table(spark, sf, "clusters"), BY)


@query(
    """WITH c AS (SELECT project_id, trim(cluster_id) AS cluster_id, coalesce(list_filter(node_ids, lambda x: x IS NOT NULL), []) AS n, coalesce(list_filter(list_transform(member_cluster_ids, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> ''), []) AS m FROM clusters),
mem AS (SELECT project_id, cluster_id, unnest(m) AS x FROM c), nod AS (SELECT DISTINCT project_id, cluster_id, unnest(n) AS x FROM c)
SELECT project_id, 'invalid_meta_cluster' AS code, cluster_id, NULL AS subject FROM c WHERE len(n) > 0 AND len(m) > 0
UNION SELECT project_id, 'empty_manual_cluster', cluster_id, NULL FROM c WHERE len(n) = 0 AND len(m) = 0
UNION SELECT project_id, 'meta_cluster_self_reference', cluster_id, x FROM mem WHERE x = cluster_id
UNION SELECT project_id, 'meta_cluster_unknown_ref', cluster_id, x FROM mem WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project_id = mem.project_id AND c.cluster_id = mem.x)
UNION SELECT project_id, 'duplicate_manual_cluster_id', cluster_id, NULL FROM c GROUP BY project_id, cluster_id HAVING count(*) > 1
UNION SELECT project_id, 'duplicate_manual_cluster_member', min(cluster_id), x FROM nod GROUP BY project_id, x HAVING count(*) > 1"""
)
def j07_cluster_problems(spark, sf):
    return overrides.cluster_problems(table(spark, sf, "clusters"), BY)


# K: edges by hand

#: Configured edges of the query: one that exists, missing ends with and without placeholders, a blank, a spelling.
_MANUAL = [cfg.ManualEdge("", "x"), cfg.ManualEdge("new/a.py", "new/b.csv"), cfg.ManualEdge(".\\new\\a.py", "./new/b.csv", on_missing="placeholder"), cfg.ManualEdge("new/a.py", "new/b.csv"), cfg.ManualEdge("new/b.csv", "new/a.py", "back")]


@query("SELECT * FROM (VALUES ('new/a.py', 'new/b.csv', 'script_to_artifact', NULL), ('new/b.csv', 'new/a.py', 'artifact_to_script', 'back')) t(source, target, kind, visible_label)")
def k01_manual_edges(spark, sf):
    new, _, _ = overrides.apply_manual_edges(_MANUAL, nodes(spark, sf), edges(spark, sf))
    return spark.createDataFrame([(e["source"], e["target"], e["kind"], e["visible_label"]) for e in new], "source string, target string, kind string, visible_label string")


@query(f"SELECT DISTINCT e.project_id, e.source, e.target, CASE WHEN {_SCRIPT.format('e.source')} THEN 'script' ELSE 'artifact' END || '_to_' || CASE WHEN {_SCRIPT.format('e.target')} THEN 'script' ELSE 'artifact' END AS kind FROM edges e")
def k05_edge_kinds(spark, sf):
    kind = overrides.edge_kind(validate.ends_in_script(F.col("source")), validate.ends_in_script(F.col("target")))
    return edges(spark, sf).select("project_id", "source", "target", kind.alias("kind")).distinct()


# M: validation


def _writers(spark, sf):
    return validate.multiple_writers(edges(spark, sf), BY)


@query(f"SELECT project_id, target AS path, count(*) AS n_writes, array_to_string(list_sort(list(DISTINCT source))[1:1000], ' | ') AS scripts FROM edges WHERE {_SCRIPT.format('source')} AND NOT {_SCRIPT.format('target')} GROUP BY ALL HAVING count(*) > 1")
def m02_multiple_writers(spark, sf):
    return _writers(spark, sf)


@query(
    f"""SELECT DISTINCT project_id, target AS path FROM edges e WHERE {_SCRIPT.format('source')} AND NOT {_SCRIPT.format('target')} AND NOT regexp_matches(target, '\\.(png|pdf|svg|csv|xlsx|ster|dot|viz)$')
  AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.project_id = e.project_id AND r.source = e.target AND {_SCRIPT.format('r.target')})"""
)
def m03_unconsumed_output(spark, sf):
    return validate.unconsumed_output(edges(spark, sf), BY)


@query(
    f"""WITH {_NODES} SELECT project_id, node_id FROM n WHERE node_type LIKE 'artifact%' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND ((e.target = n.node_id AND {_SCRIPT.format('e.source')} AND NOT {_SCRIPT.format('e.target')}) OR (e.source = n.node_id AND {_SCRIPT.format('e.target')} AND NOT {_SCRIPT.format('e.source')})))"""
)
def m04_orphan_artifacts(spark, sf):
    return validate.orphan_artifacts(nodes(spark, sf), edges(spark, sf), BY)


@query(f"WITH {_NODES} SELECT project_id, node_id, node_type FROM n WHERE node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND (e.source = n.node_id OR e.target = n.node_id))")
def m05_orphan_nodes(spark, sf):
    return validate.orphan_nodes(nodes(spark, sf).where("node_id IS NOT NULL"), edges(spark, sf), BY)


@query(f"SELECT DISTINCT project_id, node_id, role FROM nodes WHERE node_type LIKE 'artifact%' AND (role IS NULL OR role NOT IN ({_LIST(cfg.ARTIFACT_ROLES)}))")
def m06_unknown_roles(spark, sf):
    return validate.unknown_roles(table(spark, sf, "nodes"), BY)


@query(f"SELECT project_id, node_type, {_BASE.format('node_id')} AS name, count(*) AS n_paths, array_to_string(list_sort(list(node_id))[1:1000], ' | ') AS paths FROM (SELECT DISTINCT project_id, node_type, node_id FROM nodes WHERE node_id IS NOT NULL) GROUP BY ALL HAVING count(*) > 1")
def m07_ambiguous_names(spark, sf):
    return validate.ambiguous_names(table(spark, sf, "nodes").where("node_id IS NOT NULL"), BY)


@query(
    f"""WITH {_NODES} SELECT DISTINCT project_id, path, node_type FROM n WHERE path IS NOT NULL AND NOT starts_with(path, '/')
  AND NOT (node_type LIKE 'artifact%' AND EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.target = n.node_id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.source = n.node_id))
  AND NOT EXISTS (SELECT 1 FROM snapshot_left f WHERE f.project_id = n.project_id AND f.id = n.path)"""
)
def m08_missing_files(spark, sf):
    return validate.missing_files(nodes(spark, sf), edges(spark, sf), _files(spark, sf), BY)


@query("SELECT project_id, node_id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT project_id, source AS node_id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT project_id, target, 1, 0 FROM edges) GROUP BY ALL")
def m10_degrees(spark, sf):
    return validate.degrees(edges(spark, sf), BY)


@query(
    """WITH d AS (SELECT project_id, diag_id, payload['script'] AS script, string_split(coalesce(payload['path'], ''), ' | ') AS p FROM diagnostics WHERE code = 'absolute_path_usage' AND payload['script'] <> ''),
x AS (SELECT project_id, script, diag_id, trim(unnest(p)) AS path, generate_subscripts(p, 1) AS i FROM d),
o AS (SELECT project_id, script, path, min({'d': diag_id, 'i': i}) AS place FROM x WHERE path <> '' GROUP BY ALL)
SELECT d.project_id, d.script, min(d.diag_id) AS first, count(*) AS n, coalesce(any_value(u.c), 0) AS unique_paths, coalesce(any_value(u.s), '') AS sample_paths
FROM d LEFT JOIN (SELECT project_id, script, count(*) AS c, array_to_string(list(path ORDER BY place)[1:5], ' | ') AS s FROM o GROUP BY ALL) u ON u.project_id = d.project_id AND u.script = d.script GROUP BY d.project_id, d.script"""
)
def m01_bundled_absolute(spark, sf):
    return validate.bundle_absolute(table(spark, sf, "diagnostics"), BY)


@query("SELECT project_id, level, code, min(diag_id) AS diag_id, count(*) AS n FROM (SELECT *, list_sort(map_entries(payload)) AS e FROM diagnostics) GROUP BY project_id, level, code, e")
def m11_diagnostic_dedup(spark, sf):
    return validate.dedupe(table(spark, sf, "diagnostics"), BY).drop("payload")


@query("SELECT 'level' AS kind, level AS value, count(*) AS n FROM diagnostics GROUP BY ALL UNION ALL SELECT 'code', code, count(*) FROM diagnostics GROUP BY ALL")
def b03_counts(spark, sf):
    return validate.counts(table(spark, sf, "diagnostics"))


@query(
    """WITH RECURSIVE raw AS (SELECT regexp_replace(cluster_id, '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(unnest(member_cluster_ids), '^\\s+|\\s+$', '', 'g') AS b FROM clusters),
l AS (SELECT DISTINCT a, b FROM raw WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT a AS s, b AS v FROM l UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.v),
ring AS (SELECT DISTINCT s AS node FROM r WHERE s = v)
SELECT DISTINCT x AS node FROM (SELECT s AS x FROM r UNION SELECT v FROM r) WHERE (x IN (SELECT node FROM ring) OR (x IN (SELECT s FROM r WHERE v IN (SELECT node FROM ring)) AND x IN (SELECT v FROM r WHERE s IN (SELECT node FROM ring))))"""
)
def m09_cyclic_core(spark, sf):
    c = hierarchy.clean_links(table(spark, sf, "clusters"), "c", "cluster_id", "member_cluster_ids").where("child IS NOT NULL")
    return graph.cyclic_core(c.select(F.col("parent").alias("source"), F.col("child").alias("target")))


@query()
def m09_cycles(spark, sf):
    """The cycles of each project's edges. Which ones a depth-first search finds has no plain SQL; tests compare them with a search of each whole project."""
    return graph.found_cycles(edges(spark, sf), BY).select("project_id", "cycle")


@query()
def m00_diagnostics(spark, sf):
    """All checks in one relation."""
    e = edges(spark, sf)
    return validate.diagnostics(nodes(spark, sf), e, _files(spark, sf), BY).unionByName(validate.cycle_detected(e, BY).drop("start", "i"))


# N: rendering


@query(f"WITH {_NODES} SELECT project_id, node_id FROM n WHERE node_type IN ('script', 'script_placeholder') OR role IN ({_LIST(render.DELIVERABLE_VIEW_ROLES)})")
def n01_deliverables_view(spark, sf):
    return render.visible(nodes(spark, sf), edges(spark, sf), BY, cfg.Display(view="deliverables")).select("project_id", "node_id")


_N06 = f"""WITH {_NODES}, sh AS (SELECT project_id, node_id FROM n WHERE node_type IN ('script', 'script_placeholder')),
i AS (SELECT DISTINCT e.project_id, e.target AS mid, e.source AS a FROM edges e JOIN sh ON sh.project_id = e.project_id AND sh.node_id = e.source),
o AS (SELECT DISTINCT e.project_id, e.source AS mid, e.target AS b FROM edges e JOIN sh ON sh.project_id = e.project_id AND sh.node_id = e.target),
mids AS (SELECT project_id, node_id AS mid FROM n WHERE node_type NOT IN ('script', 'script_placeholder'))
SELECT DISTINCT i.project_id, a AS source, b AS target FROM i JOIN o ON o.project_id = i.project_id AND o.mid = i.mid JOIN mids ON mids.project_id = i.project_id AND mids.mid = i.mid WHERE a <> b"""


@query(_N06)
def n06_bridges(spark, sf):
    n = nodes(spark, sf)
    d = cfg.Display(view="scripts_only")
    return render.bridges(edges(spark, sf), render.aliases(n, render.visible(n, edges(spark, sf), BY, d), None, BY), n, BY, d.view)


@query(f"WITH {_NODES} SELECT e.project_id, source, target, coalesce(operation, '') AS label, min(edge_ord) AS edge_ord FROM edges e JOIN n a ON a.project_id = e.project_id AND a.node_id = e.source JOIN n b ON b.project_id = e.project_id AND b.node_id = e.target GROUP BY e.project_id, source, target, coalesce(operation, '')")
def n08_drawn_edges(spark, sf):
    n = nodes(spark, sf)
    return render.drawn_edges(edges(spark, sf), render.aliases(n, n, None, BY), BY, cfg.Display(edge_label_mode="operation"))


# O: sections


def _sections_sql() -> str:
    """RE2 has no lookahead: of a header after hashes, one blank and a bracketed number is refused by a second pattern."""

    def title(rx: str) -> str:
        refused = ""
        if r"(?!\[\d)" in rx:
            rx, refused = rx.replace(r"(?!\[\d)", ""), r" AND NOT regexp_matches(text, '^\s*#{2,}\s\[\d')"
        clean = rf"regexp_replace(regexp_extract(text, '{rx}', 1), '^[*\-=_~#\s]+|[*\-=_~#\s]+$', '', 'g')"
        return rf"CASE WHEN regexp_matches(text, '{rx}'){refused} AND NOT regexp_matches({clean}, '^[^\p{{L}}\p{{N}}]*$') THEN {clean} END"

    by = []
    for lang, forms in sections.HEADERS.items():
        t = f"coalesce({', '.join(map(title, forms))})"
        if lang == "python":
            cell = f"regexp_extract(text, '{sections.CELL}', 1)"
            t = f"CASE WHEN regexp_matches(text, '{sections.CELL}') THEN CASE WHEN {cell} = '' THEN '(untitled cell)' ELSE {cell} END WHEN regexp_matches(text, '{sections.NOTEBOOK}') THEN 'In[' || regexp_extract(text, '{sections.NOTEBOOK}', 1) || ']:' ELSE {t} END"
        by.append(f"WHEN language = '{lang}' AND NOT regexp_matches(text, '{sections.DECORATION[lang]}') THEN {t}")
    header = " ".join(f"WHEN language = '{k}' THEN regexp_matches(text, '{v}')" for k, v in sections.HEADER_COMMENT.items())
    speaks = " OR ".join(f"contains(said, '{w}')" for w in sections.TOC_WORDS)
    return f"""WITH {_script_lines_sql()}, f AS (SELECT doc_id, line, CASE {" ".join(by)} END AS title FROM l),
top AS (SELECT *, CASE {header} END AS h FROM l WHERE line <= {sections.TOC_WITHIN}),
isl AS (SELECT *, count(*) FILTER (WHERE NOT h) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM top WHERE h OR trim(text) <> ''),
runs AS (SELECT doc_id, run, count(*) AS n, max(line) AS last, lower(string_agg(trim(text), ' ' ORDER BY line)) AS said FROM isl WHERE h GROUP BY ALL),
toc AS (SELECT doc_id, min(last) AS toc_end FROM runs WHERE n >= {sections.TOC_LEAST} AND ({speaks}) GROUP BY ALL),
kept AS (SELECT f.*, len(string_split(nullif(regexp_extract(title, '^([A-Za-z\\d]+(?:\\.[A-Za-z\\d]+)*)\\s*\\.?\\s', 1), ''), '.')) AS lv FROM f LEFT JOIN toc USING (doc_id) WHERE title IS NOT NULL AND (toc_end IS NULL OR line > toc_end))
SELECT doc_id, line, CASE WHEN lv > 3 THEN 3 ELSE coalesce(lv, 1) END::INTEGER AS level, title FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, trim(title) ORDER BY line DESC) = 1"""


@query(_sections_sql())
def o03_sections(spark, sf):
    return sections.sections(lang_docs(spark, sf), ["doc_id"], F.col("language"))


@query(
    r"""WITH l AS (SELECT doc_id, t, i FROM (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM documents WHERE source = 'script' AND text IS NOT NULL))),
h AS (SELECT *, regexp_matches(t, '^\s*#{1,}\s*\S') AS h FROM l WHERE i <= 30 AND trim(t) <> ''),
r AS (SELECT *, count(*) FILTER (WHERE NOT h) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h)
SELECT doc_id, run, count(*) AS n, max(i)::INTEGER AS last FROM r WHERE h GROUP BY ALL HAVING count(*) >= 3"""
)
def o08_comment_islands(spark, sf):
    """Islands of at least three header comments near the top, by gaps and islands."""
    lines = catalog.split_lines(table(spark, sf, "documents").where("source = 'script'"), ["doc_id"]).where("line <= 30 AND trim(text) <> ''")
    lines = lines.withColumn("h", F.col("text").rlike(r"^\s*#{1,}\s*\S"))
    run = F.count_if(~F.col("h")).over(Window.partitionBy("doc_id").orderBy("line"))
    return lines.withColumn("run", run).where("h").groupBy("doc_id", "run").agg(F.count("*").alias("n"), F.max("line").alias("last")).where("n >= 3")


def multiple_writers(spark: SparkSession, sf: str) -> DataFrame:
    return _writers(spark, sf)


QUERIES["multiple_writers"] = multiple_writers
SQL["multiple_writers"] = SQL["m02_multiple_writers"]
