"""Queries p1, p3, p4 and p5: the general record problems over the lineage tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import diff, drift, hierarchy, unpack

SNAPSHOT_KEYS = ["project_id", "id"]
SNAPSHOT_FIELDS = ["type", "role", "cluster_id", "code", "level", "size_bytes", "mtime"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1: schemas that drift


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = drift.Drift(table(spark, sf_dir, "snapshot_raw")).changes()
    return log.select(F.col("file").alias("file_name"), "change", "field_before", "field_after")


def p1_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes in order, with types."""
    log = drift.Drift(table(spark, sf_dir, "snapshot_raw")).changes()
    return log.orderBy("series", "n", "change", "field_before", "field_after")


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable records in one table with one column for each field."""
    raw = table(spark, sf_dir, "snapshot_raw")
    return drift.consistent_table(raw, drift.Drift(raw), ["raw_id", "project_id", "graph_id", "file_name", "rec_no", "written_at"])


def p1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of that table: the names and types each had, its type, and whether values needed a wider one than the types alone."""
    rows = drift.Drift(table(spark, sf_dir, "snapshot_raw")).columns()
    return spark.createDataFrame([tuple(c.values()) for c in rows], "name string, fields array<string>, types array<string>, widened boolean, type string")


# 3: several values in one field


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack.unpack_map(table(spark, sf_dir, "diagnostics"), ["diag_id"], "payload", ["assigned_nodes", "clusters"])


# 4: hierarchies


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = hierarchy.clean_links(table(spark, sf_dir, "clusters"), "cluster", "cluster_id", "member_cluster_ids")
    return clusters.unionByName(hierarchy.clean_links(table(spark, sf_dir, "script_results"), "script", "script", "child_scripts"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.Forest(_links(spark, sf_dir)).table()


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node below each of its ancestors, with the distance."""
    return hierarchy.Forest(_links(spark, sf_dir)).descendants()


# 5: differences between two copies


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.differences(table(spark, sf_dir, "snapshot_left"), table(spark, sf_dir, "snapshot_right"), SNAPSHOT_KEYS, SNAPSHOT_FIELDS)


def p5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that both copies have, but not as often."""
    return diff.repeats(table(spark, sf_dir, "snapshot_left"), table(spark, sf_dir, "snapshot_right"), [*SNAPSHOT_KEYS, *SNAPSHOT_FIELDS])


QUERIES = {f.__name__: f for f in (p1_found, p1_log, p1_nodes, p1_columns, p3_found, p4_found, p4_descendants, p5_found, p5_repeats)}

_FOREST = r"""
WITH RECURSIVE raw AS (
  SELECT 'cluster' AS relation, regexp_replace(cluster_id, '^\s+|\s+$', '', 'g') AS parent, unnest(CASE WHEN len(member_cluster_ids) > 0 THEN member_cluster_ids ELSE [NULL] END) AS c FROM clusters
  UNION ALL
  SELECT 'script', regexp_replace(script, '^\s+|\s+$', '', 'g'), unnest(CASE WHEN len(child_scripts) > 0 THEN child_scripts ELSE [NULL] END) FROM script_results),
links AS (SELECT DISTINCT relation, parent, regexp_replace(c, '^\s+|\s+$', '', 'g') AS child FROM raw WHERE parent IS NOT NULL),
nodes_ AS (SELECT relation, parent AS node FROM links UNION SELECT relation, child FROM links WHERE child IS NOT NULL),
up AS (SELECT relation, child, min(parent) AS parent FROM links WHERE child IS NOT NULL GROUP BY ALL),
anc AS (
  SELECT relation, node, node AS cur, 0::BIGINT AS depth, [node] AS path FROM nodes_
  UNION ALL
  SELECT a.relation, a.node, u.parent, a.depth + 1, list_prepend(u.parent, a.path)
  FROM anc a JOIN up u ON u.relation = a.relation AND u.child = a.cur WHERE NOT list_contains(a.path, u.parent))
"""

_ROW = ", ".join([*SNAPSHOT_KEYS, *SNAPSHOT_FIELDS])

SQL = {
    "p5_repeats": f"SELECT {_ROW}, count(*) FILTER (WHERE l) AS n_left, count(*) FILTER (WHERE NOT l) AS n_right FROM (SELECT {_ROW}, true AS l FROM snapshot_left UNION ALL SELECT {_ROW}, false FROM snapshot_right) GROUP BY {_ROW} HAVING n_left > 0 AND n_right > 0 AND n_left <> n_right",
    "p4_found": _FOREST
    + """,
ends AS (SELECT a.*, u.parent AS again FROM anc a LEFT JOIN up u ON u.relation = a.relation AND u.child = a.cur
         QUALIFY row_number() OVER (PARTITION BY a.relation, a.node ORDER BY a.depth DESC) = 1),
below AS (SELECT relation, cur AS node, count(*) FILTER (WHERE cur <> node) AS n FROM anc GROUP BY relation, cur)
SELECT e.relation, e.node,
  CASE WHEN again IS NULL THEN cur ELSE list_min(path[1:list_position(path, again)]) END AS root,
  CASE WHEN again IS NULL THEN depth WHEN again = e.node THEN -1 ELSE -2 END AS depth,
  CASE WHEN again IS NULL THEN array_to_string(path, ' > ') ELSE '' END AS path,
  coalesce(b.n, 0)::BIGINT AS n_below
FROM ends e LEFT JOIN below b ON b.relation = e.relation AND b.node = e.node""",
    "p4_descendants": _FOREST
    + """,
rings AS (SELECT a.relation, a.node FROM anc a JOIN up u ON u.relation = a.relation AND u.child = a.cur AND u.parent = a.node),
tree AS (SELECT * FROM up ANTI JOIN rings ON rings.relation = up.relation AND rings.node = up.child),
d AS (
  SELECT relation, parent AS ancestor, child AS node, 1::BIGINT AS distance FROM tree
  UNION ALL
  SELECT d.relation, t.parent, d.node, d.distance + 1 FROM d JOIN tree t ON t.relation = d.relation AND t.child = d.ancestor)
SELECT relation, ancestor, node, distance FROM d""",
    "p5_found": """
WITH l AS (SELECT DISTINCT * FROM snapshot_left), r AS (SELECT DISTINCT * FROM snapshot_right),
j AS (SELECT l.project_id IS NOT NULL OR l.id IS NOT NULL AS inl, r.project_id IS NOT NULL OR r.id IS NOT NULL AS inr,
  coalesce(l.project_id, r.project_id) AS project_id, coalesce(l.id, r.id) AS id, l, r
  FROM l FULL JOIN r ON l.project_id IS NOT DISTINCT FROM r.project_id AND l.id IS NOT DISTINCT FROM r.id)
SELECT project_id, id, 'left_only' AS kind, '' AS field FROM j WHERE NOT inr
UNION ALL SELECT project_id, id, 'right_only', '' FROM j WHERE NOT inl
"""
    + "".join(f"UNION ALL SELECT project_id, id, 'differs', '{f}' FROM j WHERE inl AND inr AND l.{f} IS DISTINCT FROM r.{f}\n" for f in SNAPSHOT_FIELDS),
}
