"""Queries of the operators for corpora of language models, and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import encoding, mixing, ranking, repetition, scans, splitting


def _pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "split_limits"), table(spark, d, "ast_nodes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("n_pieces > 1").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.page_noise(table(spark, d, "chunks"))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.running_text(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_items(ranking.fused_ranking(table(spark, d, "retrieved_chunks")))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fused_ranking(table(spark, d, "retrieved_chunks")).withColumn("fused", F.round("fused", 6))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    back = encoding.decode(encoding.encode(docs), encoding.piece_table(spark)).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"), F.length("decoded").cast("long").alias("chars"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report.filter("not reachable").select("source_name")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares.drop("source")


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).records


def p7_margins(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).margins


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition_scores(table(spark, d, "documents")).filter(F.col("share") >= repetition.SHARE).select("doc_id").distinct()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_shares(table(spark, d, "documents")).withColumn("share", F.round("share", 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_text, p3_found, p3_ranking, p6_ids, p6_roundtrip, p7_found, p7_shares, p7_records, p7_margins, p8_found, p8_shares)}

_TRIM = "chr(32) || chr(9) || chr(10) || chr(13)"
ORACLE = {
    "p1_found": f"""WITH c AS (SELECT chunk_id, trim(text, {_TRIM}) AS t, coalesce(lower(trim(node_type, {_TRIM})), 'any') AS k FROM chunks)
SELECT DISTINCT chunk_id FROM c JOIN split_limits l ON l.node_type = CASE WHEN k IN (SELECT node_type FROM split_limits) THEN k ELSE 'any' END WHERE length(t) > max_chars""",
    "p6_roundtrip": "SELECT doc_id, true AS same, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM documents",
    "p8_shares": """WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\\p{L}+'), lambda x: lower(x)) AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) > 4),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ') ORDER BY i) AS nth FROM g),
s AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE nth > 1) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CASE WHEN len(ws) = 0 THEN 0 ELSE round(coalesce(n, 0) / len(ws), 6) END AS share FROM w LEFT JOIN s USING (doc_id)""",
}
ORACLE["p8_found"] = "SELECT DISTINCT doc_id FROM (" + ORACLE["p8_shares"].replace("round(coalesce(n, 0) / len(ws), 6)", "coalesce(n, 0) / len(ws)") + ") WHERE share >= 0.3"
