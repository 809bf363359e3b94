"""Further queries over the lineage tables: paths folded in SQL, memberships, views, labels, cycles of clusters, all checks in one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import config as cfg
from strandline.functions import paths
from strandline.operators import assemble, clustering, graph, hierarchy, overrides, render, validate, versions
from strandline.plans import lineage as q
from strandline.plans.lineage import BY, SQL, edges, events, nodes, query
from strandline.plans.problems import table
from strandline.streaming import changes

# C: folding of dots, as a reduction of the list of a path's parts

_UBLANK = q._UWS


def _folded(text: str, source: str = "SELECT event_id, raw_path, NULL AS kept FROM parsed_events WHERE raw_path IS NOT NULL") -> str:
    """SQL of normalize_token (column v) of a text of source: blanks and quotes stripped, slashes forward and single, dots folded."""
    bare = rf"regexp_replace({text}, '^{_UBLANK}+|{_UBLANK}+$', '', 'g')"
    for quote in ('"', "\'\'"):
        bare = f"regexp_replace({bare}, '^{quote}+|{quote}+$', '', 'g')"
    slashed = f"regexp_replace(replace({bare}, '\\', '/'), '/+', '/', 'g')"
    step = (
        "CASE WHEN x[1] IN ('', '.') THEN acc WHEN x[1] <> '..' THEN list_concat(acc, x) WHEN len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:len(acc) - 1] "
        "WHEN x[2] = '/' THEN acc ELSE list_concat(acc, x[1:1]) END"
    ).replace("list_concat(acc, x) ", "list_concat(acc, x[1:1]) ")
    return f"""SELECT event_id, raw_path, kept, s, CASE WHEN starts_with(s, '/') THEN '/' || b WHEN b = '' THEN '.' ELSE b END AS v FROM (
  SELECT *, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(s, '/'), lambda p: [p, s[1:1]])), lambda acc, x: {step}), '/') AS b
  FROM (SELECT event_id, raw_path, kept, {slashed} AS s FROM ({source})))"""


SQL["c01_normalized"] = f"SELECT event_id, v AS path, regexp_full_match(v, '[./\\\\]*') AS bare FROM ({_folded('raw_path')})"


_BELOW = " ".join(f"WHEN v = '{p}' THEN '.' WHEN starts_with(v, '{p}/') THEN v[{len(p) + 2}:]" for p in ("${GL_ROOT}", "{BASE_DIR}", "$gl_base", "/work/project", "project"))
_MARKED = " ".join(f"WHEN kept.absolute AND contains(whole, '/{m}/') THEN regexp_replace(whole[strpos(whole, '/{m}/') + {len(m) + 2}:], '/$', '')" for m in ("work/project", "srv/proj", "project"))
_UP = "rtrim(CASE WHEN p[1] = 'work' THEN '../' || array_to_string(p[2:], '/') ELSE '../../' || array_to_string(p, '/') END, '/')"
_ABSOLUTE = r"SELECT event_id, raw_path, {'absolute': regexp_matches(raw_path, '^(/|\\\\|[A-Za-z]:[\\/])'), 'value': NULL::VARCHAR} AS kept FROM parsed_events WHERE raw_path IS NOT NULL"
_PARTS = f"SELECT *, list_filter(string_split(v, '/'), lambda x: x NOT IN ('', '.')) AS p, '/' || array_to_string(list_filter(string_split(v, '/'), lambda x: x NOT IN ('', '.')), '/') || '/' AS whole FROM ({_folded('raw_path', _ABSOLUTE)})"
# what lies below an alias, the root or a marker is normalised once more
_INSIDE = f"SELECT event_id, CASE {_BELOW} {_MARKED} END AS raw_path, {{'absolute': kept.absolute, 'value': CASE WHEN kept.absolute AND starts_with(v, '/') THEN {_UP} ELSE v END}} AS kept FROM ({_PARTS})"
SQL["c09_project_relative"] = f"SELECT event_id, CASE WHEN raw_path IS NULL THEN kept.value ELSE v END AS value, kept.absolute AS was_absolute FROM ({_folded('raw_path', _INSIDE)})"


# memberships of the groups that lists show the first of


@query(
    f"""WITH w AS (SELECT project_id, target AS path, source FROM edges WHERE {q._SCRIPT.format('source')} AND NOT {q._SCRIPT.format('target')})
SELECT project_id, path, source, count(*) AS n_writes FROM w GROUP BY project_id, path, source QUALIFY sum(count(*)) OVER (PARTITION BY project_id, path) > 1"""
)
def m02_writers(spark: SparkSession, sf: str) -> DataFrame:
    return validate.writers(edges(spark, sf), BY)


@query(f"SELECT project_id, node_type, {q._BASE.format('node_id')} AS name, node_id FROM (SELECT DISTINCT project_id, node_type, node_id FROM nodes WHERE node_id IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY project_id, node_type, {q._BASE.format('node_id')}) > 1")
def m07_same_name(spark: SparkSession, sf: str) -> DataFrame:
    return validate.same_name(table(spark, sf, "nodes").where("node_id IS NOT NULL"), BY)


# G, H: inputs for which rules have something to do

_NAMED = ["panel", "final", "draft"]


@query(SQL["g13_temporary"].replace(q._TEMP, "(" + " OR ".join(f"contains(lower(a.path), '{p}')" for p in _NAMED) + " OR u.erased)"))
def g13_temporary_named(spark: SparkSession, sf: str) -> DataFrame:
    """Temporary outputs, by name patterns of a configuration that these paths meet."""
    c = cfg.Classification(temporary_name_patterns=_NAMED)
    return assemble.temporary_summary(assemble.classified(events(spark, sf), BY, c), BY)


@query(SQL["h02_newest_ties"].replace(q._SNAP, "files AS (SELECT project_id, path, date_trunc('year', max(seen_at)) AS mtime FROM nodes GROUP BY ALL)"))
def h02_newest_ties_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Members of families seen last in the same year."""
    files = table(spark, sf, "nodes").groupBy("project_id", "path").agg(F.date_trunc("year", F.max("seen_at")).alias("mtime"))
    return versions.newest_ties(versions.members(nodes(spark, sf), BY), files, BY)


@query(f"WITH {q._MEMBERS} SELECT project_id, family, member FROM m")
def h01_members(spark: SparkSession, sf: str) -> DataFrame:
    return versions.members(nodes(spark, sf), BY)


# I: dependencies in linear size


@query(
    f"""WITH e AS (SELECT DISTINCT project_id, source, target, {q._SCRIPT.format('source')} AS s, {q._SCRIPT.format('target')} AS t FROM edges),
w AS (SELECT project_id, target AS artifact, source AS script FROM e WHERE s AND NOT t), r AS (SELECT project_id, source AS artifact, target AS script FROM e WHERE t AND NOT s)
SELECT w.project_id, w.artifact, count(DISTINCT w.script) AS n_writers, count(DISTINCT r.script) AS n_readers, count(*) FILTER (WHERE w.script <> r.script) AS n_pairs
FROM w JOIN r ON r.project_id = w.project_id AND r.artifact = w.artifact GROUP BY ALL"""
)
def i02_shared_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.shared_artifacts(edges(spark, sf), q.scripts(spark, sf), BY)


# J: clusters


@query(
    f"""WITH {q._NODES}, {q._ASSIGNED}, s AS (SELECT * FROM n WHERE node_type = 'script' AND cluster_id IS NOT NULL),
b AS (SELECT project_id, source AS a, target AS s FROM edges UNION ALL SELECT project_id, target, source FROM edges)
SELECT b.project_id, b.a AS node_id, min(s.cluster_id) AS cluster_id FROM b JOIN s ON s.project_id = b.project_id AND s.node_id = b.s JOIN n ON n.project_id = b.project_id AND n.node_id = b.a AND n.node_type LIKE 'artifact%'
WHERE NOT EXISTS (SELECT 1 FROM asg WHERE asg.project_id = b.project_id AND asg.node_id = b.a) GROUP BY ALL HAVING count(DISTINCT s.cluster_id) = 1"""
)
def j05_reassigned(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters that artifacts follow their scripts to, but those that a definition lists."""
    held = overrides.assignments(table(spark, sf, "clusters"), BY, F.col("cluster_row_id")).select(*BY, "node_id")
    return clustering.artifact_clusters(edges(spark, sf), nodes(spark, sf), BY, held)


@query(
    r"""WITH RECURSIVE raw AS (SELECT regexp_replace(cluster_id, '^\s+|\s+$', '', 'g') AS p, regexp_replace(unnest(member_cluster_ids), '^\s+|\s+$', '', 'g') AS c FROM clusters),
up AS (SELECT c, min(p) AS p FROM raw WHERE c IS NOT NULL AND c <> '' AND p IS NOT NULL GROUP BY c),
w AS (SELECT c AS s, p AS v, [c] AS path FROM up UNION ALL SELECT w.s, up.p, list_append(w.path, w.v) FROM w JOIN up ON up.c = w.v WHERE w.v <> w.s AND NOT list_contains(w.path, w.v))
SELECT DISTINCT least(path, list_prepend(path[1], list_reverse(path[2:]))) AS cycle FROM w WHERE v = s AND s = list_min(path)"""
)
def j08_cluster_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The rings of clusters that contain each other, each from its smallest rotation, whichever way round."""
    c = hierarchy.clean_links(table(spark, sf, "clusters"), "c", "cluster_id", "member_cluster_ids").where("child IS NOT NULL")
    links = c.select(F.col("parent").alias("source"), F.col("child").alias("target"), F.xxhash64("parent", "child").alias("edge_ord"))
    return graph.found_cycles(links, []).select("cycle").distinct()


# K: what becomes of edges by hand


@query(
    """SELECT * FROM (VALUES ('warning', 'invalid_manual_edge', '', 'x', NULL, '1'), ('warning', 'manual_edge_node_not_found', 'new/a.py', 'new/b.csv', 'new/a.py', '2'),
('warning', 'manual_edge_node_not_found', 'new/a.py', 'new/b.csv', 'new/b.csv', '2'), ('info', 'manual_edge_placeholder_injected', 'new/a.py', 'new/b.csv', 'new/a.py', NULL),
('info', 'manual_edge_placeholder_injected', 'new/a.py', 'new/b.csv', 'new/b.csv', NULL), ('info', 'manual_edge_duplicate', 'new/a.py', 'new/b.csv', NULL, NULL),
('info', 'manual_edges_applied', '2', '3', '5', NULL)) t(level, code, a, b, c, entry)"""
)
def k02_manual_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The diagnostics of configured edges: blank ends, repeats, missing ends with and without placeholders, and the count of all."""
    _, _, said = overrides.apply_manual_edges(q._MANUAL, nodes(spark, sf), edges(spark, sf))
    rows = []
    for s in said:
        p = s["payload"]
        a, b, c = ("applied", "skipped", "total") if s["code"] == "manual_edges_applied" else ("source", "target", "node_id")
        rows.append((s["level"], s["code"], p.get(a), p.get(b), p.get(c), p.get("entry_index")))
    return spark.createDataFrame(rows, "level string, code string, a string, b string, c string, entry string")


@query("SELECT * FROM (VALUES ('new/a.py', 'a.py', 'script_placeholder', 'placeholder_script'), ('new/b.csv', 'b.csv', 'artifact_placeholder', 'placeholder_artifact')) t(node_id, label, node_type, role)")
def k04_manual_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    _, new, _ = overrides.apply_manual_edges(q._MANUAL, nodes(spark, sf), edges(spark, sf))
    return spark.createDataFrame([(n["node_id"], n["label"], n["node_type"], n["role"]) for n in new], "node_id string, label string, node_type string, role string")


# M: all checks but cycles

_CHECKS = [
    ("m02_multiple_writers", "warning", "multiple_writers", "'Several scripts write ' || path"),
    ("m03_unconsumed_output", "info", "unconsumed_output", "'Produced artifact is not consumed downstream: ' || path"),
    ("m04_orphan_artifacts", "info", "orphan_artifact", "'Orphan artifact: ' || node_id"),
    ("m05_orphan_nodes", "warning", "orphan_node", "'Node without edges: ' || node_id"),
    ("m07_ambiguous_names", "info", "ambiguous_name", "'Several nodes share a file name: ' || name"),
    ("m08_missing_files", "warning", "missing_referenced_file", "'Referenced path does not exist in project tree: ' || path"),
]
_ROLES = f"SELECT project_id, 'warning' AS level, 'unknown_file_role' AS code, 'Artifact of unknown role: ' || node_id AS message FROM (WITH {q._NODES} SELECT project_id, node_id, role FROM n WHERE node_type LIKE 'artifact%' AND (role IS NULL OR role NOT IN ({q._LIST(cfg.ARTIFACT_ROLES)})))"
_NAMES = SQL["m07_ambiguous_names"].replace("FROM nodes WHERE", "FROM n WHERE")


@query(
    " UNION ALL ".join([f"SELECT project_id, '{level}' AS level, '{code}' AS code, {message} AS message FROM ({f'WITH {q._NODES} ' + _NAMES if name.startswith('m07') else SQL[name]})" for name, level, code, message in _CHECKS] + [_ROLES])
)
def m00_checks(spark: SparkSession, sf: str) -> DataFrame:
    """All checks but cycles in one relation, as m00_diagnostics has them."""
    n = nodes(spark, sf).where("node_id IS NOT NULL")
    return validate.diagnostics(n, edges(spark, sf), q._files(spark, sf), BY).select("project_id", "level", "code", "message")


# N: views, aliases, labels

_SCRIPTS_OF = "node_type IN ('script', 'script_placeholder')"
_VIEWS = {
    "overview": (cfg.Display(), "true"),
    "no_terminal": (cfg.Display(show_terminal_outputs=False), "NOT (node_type IN ('artifact', 'artifact_placeholder') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.source = n.node_id))"),
    "technical": (cfg.Display(view="technical"), "true"),
    "deliverables": (cfg.Display(view="deliverables"), f"{_SCRIPTS_OF} OR role IN ({q._LIST(render.DELIVERABLE_VIEW_ROLES)})"),
    "scripts_only": (cfg.Display(view="scripts_only"), _SCRIPTS_OF),
    "stage_overview": (cfg.Display(view="stage_overview"), f"{_SCRIPTS_OF} AND coalesce(cluster_id, '') = ''"),
}


@query(f"WITH {q._NODES} " + " UNION ALL ".join(f"SELECT '{v}' AS view, project_id, node_id FROM n WHERE node_id IS NOT NULL AND ({w})" for v, (_, w) in _VIEWS.items()))
def n01_views(spark: SparkSession, sf: str) -> DataFrame:
    """What each view shows."""
    n, e = nodes(spark, sf).where("node_id IS NOT NULL"), edges(spark, sf)
    return reduce(DataFrame.unionByName, (render.visible(n, e, BY, d).select(F.lit(v).alias("view"), "project_id", "node_id") for v, (d, _) in _VIEWS.items()))


_COLLAPSED = f"{q._NODES}, d AS ({SQL['j01_definitions']}), c AS (SELECT project_id, cluster_id FROM d WHERE kind = 'auto')"


def _collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters that are drawn as one: here the automatic ones, as these definitions set no collapse."""
    return overrides.latest_definitions(table(spark, sf, "clusters"), BY, F.col("cluster_row_id")).where("kind = 'auto'").select(*BY, "cluster_id")


@query(f"WITH {_COLLAPSED} SELECT n.project_id, n.node_id, CASE WHEN c.cluster_id IS NOT NULL THEN 'cluster::' || n.cluster_id ELSE n.node_id END AS alias FROM n LEFT JOIN c ON c.project_id = n.project_id AND c.cluster_id = n.cluster_id WHERE n.node_id IS NOT NULL")
def n03_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of collapsed clusters stand for the cluster."""
    n = nodes(spark, sf).where("node_id IS NOT NULL")
    return render.aliases(n, n, _collapsed(spark, sf), BY)


_LABELS = {
    "auto": (cfg.Display(), "''"),
    "labels": (cfg.Display(show_edge_labels=True), "coalesce(visible_label, '')"),
    "show": (cfg.Display(edge_label_mode="show"), "coalesce(visible_label, '')"),
    "operation": (cfg.Display(edge_label_mode="operation"), "coalesce(operation, '')"),
    "hidden": (cfg.Display(edge_label_mode="hidden", show_edge_labels=True), "''"),
    "technical": (cfg.Display(view="technical", edge_label_mode="hidden"), "coalesce(visible_label, '')"),
}


@query(" UNION ALL ".join(f"SELECT '{m}' AS mode, project_id, edge_ord, {s} AS label FROM edges" for m, (_, s) in _LABELS.items()))
def n07_edge_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The label of every edge in each mode."""
    e = edges(spark, sf)
    return reduce(DataFrame.unionByName, (e.select(F.lit(m).alias("mode"), "project_id", "edge_ord", render.edge_label(d).alias("label")) for m, (d, _) in _LABELS.items()))


@query(
    f"""WITH {_COLLAPSED}, a AS (SELECT n.project_id, n.node_id, CASE WHEN c.cluster_id IS NOT NULL THEN 'cluster::' || n.cluster_id ELSE n.node_id END AS alias FROM n LEFT JOIN c ON c.project_id = n.project_id AND c.cluster_id = n.cluster_id WHERE n.node_id IS NOT NULL)
SELECT e.project_id, x.alias AS source, y.alias AS target, coalesce(e.visible_label, '') AS label, min(edge_ord) AS edge_ord FROM edges e JOIN a x ON x.project_id = e.project_id AND x.node_id = e.source JOIN a y ON y.project_id = e.project_id AND y.node_id = e.target GROUP BY ALL"""
)
def n08_collapsed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between aliases, each once, loops of collapsed clusters too."""
    return render.drawn_edges(edges(spark, sf), n03_aliases(spark, sf), BY, cfg.Display(show_edge_labels=True))


@query(
    f"""WITH {_COLLAPSED}, a AS (SELECT n.project_id, n.node_id, CASE WHEN c.cluster_id IS NOT NULL THEN 'cluster::' || n.cluster_id ELSE n.node_id END AS alias FROM n LEFT JOIN c ON c.project_id = n.project_id AND c.cluster_id = n.cluster_id WHERE n.node_id IS NOT NULL),
i AS (SELECT DISTINCT e.project_id, e.target AS mid, a.alias AS a FROM edges e JOIN a ON a.project_id = e.project_id AND a.node_id = e.source),
o AS (SELECT DISTINCT e.project_id, e.source AS mid, a.alias AS b FROM edges e JOIN a ON a.project_id = e.project_id AND a.node_id = e.target),
near AS (SELECT project_id, mid FROM i WHERE starts_with(a, 'cluster::') UNION SELECT project_id, mid FROM o WHERE starts_with(b, 'cluster::')),
mids AS (SELECT n.project_id, n.node_id AS mid FROM n JOIN near ON near.project_id = n.project_id AND near.mid = n.node_id WHERE NOT ({_SCRIPTS_OF}))
SELECT DISTINCT i.project_id, a AS source, b AS target FROM i JOIN o ON o.project_id = i.project_id AND o.mid = i.mid JOIN mids ON mids.project_id = i.project_id AND mids.mid = i.mid WHERE a <> b"""
)
def n06_collapsed_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """What leads over one artifact from or to a collapsed cluster, in the overview."""
    n = nodes(spark, sf).where("node_id IS NOT NULL")
    return render.bridges(edges(spark, sf), n03_aliases(spark, sf), n, BY)


# B: edge lists

_CSV = "CASE WHEN regexp_matches({0}, '[\",\n\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE coalesce({0}, '') END"


@query("SELECT project_id, edge_ord, " + " || ',' || ".join(_CSV.format(c) for c in ("source", "target", "operation", "kind")) + " AS line FROM edges")
def b01_edge_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the edge list: source, target, command, kind, quoted where they need it."""
    return edges(spark, sf).select("project_id", "edge_ord", paths.csv_line(*(F.col(c) for c in ("source", "target", "operation", "kind"))).alias("line"))


# streams, as batches over what has arrived


@query(
    f"WITH {q._ROUTED} SELECT strftime(date_trunc('hour', scanned_at), '%Y-%m-%d %H:%M:%S') AS window_start, project_id, kind, count(*) AS n FROM routed WHERE scanned_at IS NOT NULL GROUP BY ALL"
)
def s01_usage_by_window(spark: SparkSession, sf: str) -> DataFrame:
    """Reads, writes and erases by hour of all events."""
    w = changes.usage_by_window(events(spark, sf), late=None)
    return w.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


_ON_TIME = "scanned_at IS NOT NULL AND loaded_at <= scanned_at + INTERVAL 2 HOUR"


@query(f"SELECT event_id FROM parsed_events EXCEPT SELECT event_id FROM parsed_events WHERE {_ON_TIME}")
def s02_missed(spark: SparkSession, sf: str) -> DataFrame:
    """The events that come more than two hours late, or without a time, which a stream leaves to the batch."""
    e = events(spark, sf)
    return changes.missed(e, e.where(_ON_TIME), ["event_id"]).select("event_id")
