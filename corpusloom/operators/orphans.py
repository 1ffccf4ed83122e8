"""References to records that do not exist, have been deleted, or came later."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..keys import norm_key, referred_table
from ..scale import carry_max, heavy_keys, lookup, write_table


def record_lives(*tables: DataFrame) -> DataFrame:
    """(ref_key, created_at, deleted_at) of all parent tables; rows sent again fall together later. A null key is no record."""
    out = None
    for t in tables:
        x = t.select(norm_key(F.col("lineage_id")).alias("ref_key"), "created_at", "deleted_at").filter(F.length("ref_key") > 0)
        out = x if out is None else out.unionByName(x)
    return out


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, ref_key, recorded_at): the target of each edge; edges that name none are left out.

    The target is ``dst``; where it is null or blank, ``{doc_id}:article:{ref_number}``.
    """
    dst = F.nullif(norm_key(F.col("dst")), F.lit(""))
    by_number = F.concat(norm_key(F.col("doc_id")), F.lit(":article:"), F.nullif(norm_key(F.col("ref_number")), F.lit("")))
    return edges.select("edge_id", F.coalesce(dst, by_number).alias("ref_key"), "recorded_at").filter("ref_key is not null")


def orphan_references(edges: DataFrame, *tables: DataFrame) -> DataFrame:
    """(edge_id, ref_table, ref_key, recorded_at, reason) of edges whose target is not there, rows sent again once.

    reason: 'missing' (no record has the key), 'deleted' (every record has a ``deleted_at``), 'late' (a record without
    ``deleted_at`` exists, but none existed at ``recorded_at``). A null ``recorded_at`` is never late. Empty edges give an
    empty result; empty record tables make every reference 'missing'.

    Parent and child keys go tagged into one long form and are grouped by table and key; map-side sums shrink a hot
    key to one row per task. Only keys that can hold an orphan are joined back to the edges: groups without a parent
    flag or without a live record, and groups whose first reference is older than the first live record.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    lives, refs = record_lives(*tables), references(edges)
    stamp = F.lit(None).cast("timestamp")
    parent = lives.select("ref_key", F.lit(1).alias("is_parent"), F.when(F.col("deleted_at").isNull(), 1).otherwise(0).alias("live"), F.when(F.col("deleted_at").isNull(), F.coalesce("created_at", F.lit("0001-01-02").cast("timestamp"))).alias("live_from"), stamp.alias("seen_at"), F.lit(0).alias("child"))
    child = refs.select("ref_key", F.lit(0).alias("is_parent"), F.lit(0).alias("live"), stamp.alias("live_from"), F.col("recorded_at").alias("seen_at"), F.lit(1).alias("child"))
    grouped = parent.unionByName(child).groupBy(referred_table(F.col("ref_key")).alias("ref_table"), "ref_key").agg(
        F.max("is_parent").alias("has_parent"), F.max("live").alias("has_live"), F.min("live_from").alias("live_from"),
        F.min("seen_at").alias("first_seen"), F.sum("child").alias("n_children"))
    grouped = grouped.filter("n_children > 0 and (has_parent = 0 or has_live = 0 or first_seen < live_from)")
    suspects, _ = write_table(grouped, "suspects")
    total = suspects.agg(F.sum("n_children")).first()[0] or 0
    heavy = heavy_keys(suspects, "ref_key", "n_children", total, parts)
    hit = lookup(refs, suspects.drop("first_seen", "n_children"), "ref_key", heavy, "inner")
    hit = hit.filter("has_parent = 0 or has_live = 0 or recorded_at < live_from")
    sure = hit.filter("has_parent = 0 or has_live = 0").withColumn("reason", F.when(F.col("has_parent") == 0, "missing").otherwise("deleted"))
    maybe = hit.filter("has_parent = 1 and has_live = 1")
    ended = lives.filter("deleted_at is not null").join(suspects.filter("has_live = 1").select("ref_key"), "ref_key", "left_semi")
    # an ended life holds at recorded_at if, of those that began by then, the last to end ends later; no key has to fit one task
    stamps = ended.select("ref_key", F.coalesce("created_at", F.lit("0001-01-02").cast("timestamp")).alias("at"), F.lit(0).alias("tag"), F.lit(None).cast(dict(maybe.dtypes)["edge_id"]).alias("edge_id"), F.lit(None).cast("string").alias("ref_table"), F.col("deleted_at").alias("until")).distinct()
    points = maybe.select("ref_key", F.col("recorded_at").alias("at"), F.lit(1).alias("tag"), "edge_id", "ref_table", stamp.alias("until"))
    late = carry_max(stamps.unionByName(points), ["ref_key"], ["at", "tag", "edge_id"], "until", "top").filter("tag = 1 and (top is null or top <= at)")
    late = late.withColumnRenamed("at", "recorded_at").withColumn("reason", F.lit("late"))
    cols = ["edge_id", "ref_table", "ref_key", "recorded_at", "reason"]
    return sure.select(*cols).unionByName(late.select(*cols)).dropDuplicates(["edge_id", "reason"])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referred table, month of ``recorded_at`` and reason."""
    return orphans.groupBy("ref_table", F.date_format("recorded_at", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n_edges"))
