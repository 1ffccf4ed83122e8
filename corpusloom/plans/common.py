"""Views that several queries share, in Spark and in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..keys import norm_key, norm_label
from ..operators.graphs import clean_edges, clean_nodes
from ..session import table


def edges(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Edges with src, dst, kind, edge_ord and the columns ``more``."""
    return clean_edges(table(spark, d, "graph_edges"), ["src", "dst", "kind", *more])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return clean_nodes(table(spark, d, "graph_nodes"), table(spark, d, "reference_nodes"))


def lists(spark: SparkSession, d: str) -> DataFrame:
    """Ranked lists (query_id, method, rank, lineage_id, score) of the retrieved items, one list per set of methods."""
    r = table(spark, d, "retrieved_chunks")
    name = F.array_join(F.array_sort(F.array_distinct(F.transform("source_methods", norm_label))), "+")
    x = r.select("query_id", name.alias("method"), norm_key(F.col("lineage_id")).alias("lineage_id"), "score").filter("score is not null and not isnan(score)")
    x = x.groupBy("query_id", "method", "lineage_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "method").orderBy(F.col("score").desc(), "lineage_id")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).select("query_id", "method", "rank", "lineage_id", "score")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """All lists but the reranker's as systems."""
    return lists(spark, d).filter("method != 'rerank'").withColumnRenamed("method", "system")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """The reranker's first three items of each query serve as its relevant ones."""
    return lists(spark, d).filter("method = 'rerank' and rank <= 3").select("query_id", "lineage_id", "rank")


def seeds(spark: SparkSession, d: str, k: int | None = 10) -> DataFrame:
    """The sparse list's first items of each query that are nodes; all of the list without ``k``."""
    s = lists(spark, d).filter("method = 'sparse'" + ("" if k is None else f" and rank <= {k}")).select("query_id", F.col("lineage_id").alias("node_id"))
    return s.join(nodes(spark, d).select("node_id"), "node_id", "left_semi").select("query_id", "node_id").distinct()


def clean_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Structured chunks, each key once (the latest arrival): lineage_id, doc_id, node_type, text, span_start, span_end, thin, absorbed."""
    c = table(spark, d, "chunks").filter("page_no is null")
    x = c.select(norm_key(F.col("lineage_id")).alias("lineage_id"), norm_key(F.col("doc_id")).alias("doc_id"), norm_key(F.col("node_type")).alias("node_type"), "text", "span_start", "span_end", "thin", "absorbed", "chunk_id", "ingested_at")
    last = x.groupBy("lineage_id").agg(F.max(F.struct("ingested_at", "chunk_id")).alias("m")).select("lineage_id", "m.ingested_at", "m.chunk_id")
    return x.join(last, ["lineage_id", "ingested_at", "chunk_id"], "left_semi").dropDuplicates(["lineage_id"]).drop("ingested_at")


B = "chr(32) || chr(9) || chr(10) || chr(13)"

EDGES = f"""e0 AS (SELECT edge_id, lower(trim(src, {B})) AS src, lower(trim(dst, {B})) AS dst, upper(translate(lower(trim(kind, {B})), ' -', '__')) AS kind, lower(trim(doc_id, {B})) AS doc_id, char_offset, snippet, unresolved, recorded_at,
  row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC) AS rn FROM graph_edges),
e AS (SELECT *, edge_id AS edge_ord FROM e0 WHERE rn = 1)"""

NODES = f"""n0 AS (
  SELECT lower(trim(lineage_id, {B})) AS node_id, lower(trim(kind)) AS kind, lower(trim(doc_id, {B})) AS doc_id, art_number, title, term, created_at, deleted_at FROM graph_nodes UNION ALL
  SELECT lower(trim(lineage_id, {B})), lower(trim(kind)), NULL, art_number, coalesce(title, label), NULL, created_at, deleted_at FROM reference_nodes),
n1 AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC) AS rn FROM n0),
n AS (SELECT node_id, kind, doc_id, art_number, title, term FROM n1 WHERE rn = 1)"""

LISTS = f"""l0 AS (SELECT query_id, array_to_string(list_sort(list_distinct(list_transform(source_methods, lambda x: translate(lower(trim(x, {B})), ' -', '__')))), '+') AS method, lower(trim(lineage_id, {B})) AS lineage_id, max(score) AS score
  FROM retrieved_chunks WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
l AS (SELECT query_id, method, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, lineage_id) AS rank, lineage_id, score FROM l0),
runs AS (SELECT query_id, method AS system, rank, lineage_id, score FROM l WHERE method <> 'rerank'),
gold AS (SELECT query_id, lineage_id, rank FROM l WHERE method = 'rerank' AND rank <= 3)"""

SEEDS = f"""{EDGES}, {NODES}, {LISTS},
seeds AS (SELECT DISTINCT query_id, lineage_id AS node_id FROM l WHERE method = 'sparse' AND rank <= 10 AND lineage_id IN (SELECT node_id FROM n))"""

CHUNKS = f"""c0 AS (SELECT lower(trim(lineage_id, {B})) AS lineage_id, lower(trim(doc_id, {B})) AS doc_id, lower(trim(node_type, {B})) AS node_type, text, span_start, span_end, thin, absorbed,
  row_number() OVER (PARTITION BY lower(trim(lineage_id, {B})) ORDER BY ingested_at DESC, chunk_id DESC) AS rn FROM chunks WHERE page_no IS NULL),
c AS (SELECT * FROM c0 WHERE rn = 1)"""

METRICS = """top AS (SELECT * FROM runs WHERE rank <= 20), ks AS (SELECT unnest([1, 3, 5, 10, 20]) AS k),
nrel AS (SELECT query_id, count(*) AS n_rel FROM gold GROUP BY 1),
h AS (SELECT t.system, t.query_id, k, sum(CASE WHEN t.rank <= k THEN 1 ELSE 0 END) AS n_got, sum(CASE WHEN t.rank <= k AND g.lineage_id IS NOT NULL THEN 1 ELSE 0 END) AS n_hit,
  min(CASE WHEN t.rank <= k AND g.lineage_id IS NOT NULL THEN t.rank END) AS first, sum(CASE WHEN t.rank <= k AND g.lineage_id IS NOT NULL THEN 1 / log2(t.rank + 1) ELSE 0 END) AS dcg
  FROM top t LEFT JOIN gold g USING (query_id, lineage_id) CROSS JOIN ks GROUP BY 1, 2, 3),
v AS (SELECT h.*, coalesce(n_rel, 0) AS n_rel, (SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, 21)) u(i) WHERE i <= greatest(least(coalesce(n_rel, 0), greatest(n_got, 1)), 1)) AS ideal FROM h LEFT JOIN nrel USING (query_id)),
m AS (
  SELECT system, query_id, k, 'recall' AS metric, CASE WHEN n_rel > 0 THEN n_hit / n_rel END AS value FROM v UNION ALL
  SELECT system, query_id, k, 'precision', CASE WHEN n_rel > 0 AND n_got > 0 THEN n_hit / least(k, n_got) END FROM v UNION ALL
  SELECT system, query_id, k, 'hit', CASE WHEN n_hit > 0 THEN 1.0 ELSE 0.0 END FROM v UNION ALL
  SELECT system, query_id, k, 'rr', coalesce(1.0 / first, 0) FROM v UNION ALL
  SELECT system, query_id, k, 'ndcg', CASE WHEN n_rel > 0 THEN dcg / ideal ELSE 0 END FROM v)"""
