"""Queries over links between records: hierarchies and orphan references."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import descendant_counts, hierarchy, parent_links
from ..operators.orphans import orphan_references, orphan_report
from ..session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(parent_links(table(spark, d, "graph_edges")), paths=False)


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy(parent_links(table(spark, d, "graph_edges")))
    return t.select("node_id", "root_id", "node_depth", F.array_join("path", " > ").alias("node_path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendant_counts(hierarchy(parent_links(table(spark, d, "graph_edges"))))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "graph_edges"), table(spark, d, "graph_nodes"), table(spark, d, "reference_nodes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("edge_id", "reason")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p4_found, p4_paths, p4_descendants, p5_found, p5_report)}

_LINKS = """links AS (
  SELECT lower(trim(src, chr(32) || chr(9) || chr(10) || chr(13))) AS node_id, min(lower(trim(dst, chr(32) || chr(9) || chr(10) || chr(13)))) AS parent_id
  FROM graph_edges WHERE translate(lower(trim(kind, chr(32) || chr(9) || chr(10) || chr(13))), ' -', '__') = 'part_of' AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1),
up AS (
  SELECT node_id, parent_id AS anc, CAST(1 AS BIGINT) AS dist, parent_id AS path FROM links
  UNION ALL
  SELECT u.node_id, l.parent_id, u.dist + 1, l.parent_id || ' > ' || u.path FROM up u JOIN links l ON l.node_id = u.anc WHERE u.dist < 64)"""
_TREE = f"""WITH RECURSIVE {_LINKS},
done AS (SELECT u.* FROM up u ANTI JOIN links l ON l.node_id = u.anc)
"""
_ORPHANS = """WITH b AS (SELECT chr(32) || chr(9) || chr(10) || chr(13) AS s),
lives AS (
  SELECT lower(trim(lineage_id, s)) AS k, created_at, deleted_at FROM graph_nodes, b UNION ALL
  SELECT lower(trim(lineage_id, s)), created_at, deleted_at FROM reference_nodes, b),
refs AS (
  SELECT DISTINCT edge_id, recorded_at, coalesce(lower(trim(dst, s)), lower(trim(doc_id, s)) || ':article:' || lower(trim(ref_number, s))) AS k FROM graph_edges, b),
keyed AS (SELECT k, count(*) AS n, count(*) FILTER (deleted_at IS NULL) AS live FROM lives GROUP BY k),
orphans AS (
  SELECT r.edge_id, r.k, r.recorded_at,
    CASE WHEN y.n IS NULL THEN 'missing' WHEN y.live = 0 THEN 'deleted' ELSE 'late' END AS reason
  FROM refs r LEFT JOIN keyed y USING (k)
  WHERE r.k IS NOT NULL AND (y.n IS NULL OR y.live = 0 OR NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.k = r.k AND l.created_at <= r.recorded_at AND (l.deleted_at IS NULL OR r.recorded_at < l.deleted_at))))
"""

ORACLE = {
    "p4_found": _TREE + "SELECT node_id, anc AS root_id, dist AS node_depth FROM done UNION ALL SELECT node_id, 'cycle', CAST(-1 AS BIGINT) FROM links ANTI JOIN done USING (node_id)",
    "p4_paths": _TREE + "SELECT node_id, anc AS root_id, dist AS node_depth, path || ' > ' || node_id AS node_path FROM done UNION ALL SELECT node_id, 'cycle', CAST(-1 AS BIGINT), NULL FROM links ANTI JOIN done USING (node_id)",
    "p4_descendants": _TREE + "SELECT u.anc AS ancestor_id, count(*) AS n_descendants, max(u.dist) AS height FROM up u SEMI JOIN done d ON d.node_id = u.node_id GROUP BY 1",
    "p5_found": _ORPHANS + "SELECT edge_id, reason FROM orphans",
    "p5_report": _ORPHANS + "SELECT CASE WHEN starts_with(k, 'corpus:') OR starts_with(k, 'ext:') THEN 'reference_nodes' ELSE 'graph_nodes' END AS ref_table, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS period, reason, count(*) AS n_edges FROM orphans GROUP BY 1, 2, 3",
}
