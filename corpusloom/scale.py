"""Helpers that keep iterative and skewed plans safe on a cluster.

``write_table`` cuts lineage through files in the shared checkpoint folder, so a lost executor costs no
recomputation of earlier rounds. ``lookup`` joins many rows to a table with one row per key and takes hot keys
out of the shuffle: their number is bounded by construction, so broadcasting their entries is bounded too.
"""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where none is set, a session on one machine gets a temporary one, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            root = jdir.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` once into the shared folder and return the table read back, with its path."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/corpusloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table made by ``write_table`` that no later plan reads."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def heavy_keys(counts: DataFrame, key: str, n: str, total: int, parts: int) -> DataFrame:
    """Keys that alone hold more than a quarter of a shuffle partition's fair share: at most ``4 * parts`` of them."""
    return counts.filter(F.col(n) > F.lit(max(total // (4 * max(parts, 1)), 1000))).select(key)


def lookup(probe: DataFrame, table: DataFrame, key: str, heavy: DataFrame | None, how: str = "left") -> DataFrame:
    """Join ``probe`` to ``table`` (one row per ``key``), with hot keys broadcast and the rest shuffled.

    ``heavy`` has the hot keys (see ``heavy_keys``; bounded); ``None`` leaves skew to adaptive execution. Rows with a
    null key match nothing. Row count of ``probe`` is kept for ``left``.
    """
    if heavy is None:
        return probe.join(table, key, how)
    flagged = probe.join(F.broadcast(heavy.withColumn("_hot", F.lit(True))), key, "left")
    hot, rest = flagged.filter("_hot").drop("_hot"), flagged.filter("_hot is null").drop("_hot")
    hot_table = table.join(F.broadcast(heavy), key, "left_semi")
    return hot.join(F.broadcast(hot_table), key, how).unionByName(rest.join(table, key, how))


def likely(df: DataFrame, key: str, keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows whose ``key`` is among ``keys`` (one column), and perhaps a few others, kept without a shuffle.

    Hashes of the keys are broadcast if there are at most ``most`` of them; else all rows stay. An exact join must follow.
    """
    hashes, _ = write_table(keys.select(F.xxhash64(keys.columns[0]).alias("_h")).distinct(), "hashes")
    if hashes.count() > most:
        return df
    return df.withColumn("_h", F.xxhash64(key)).join(F.broadcast(hashes), "_h", "left_semi").drop("_h")


def running_totals(df: DataFrame, group: list[str], order: list[str], n: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``n`` over the rows before, in the order of ``order`` within each group, without a task per group.

    Rows are range partitioned, summed within each partition, and lifted by the sums of the partitions before. ``order``
    must be total within a group.
    """
    from pyspark.sql import Window

    ranged, _ = write_table(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(n).over(w), F.lit(0)))
    parts = ranged.groupBy(*group, "_part").agg(F.sum(n).alias("_sum"))
    v = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(v), F.lit(0))).drop("_sum")
    return local.join(parts, [*group, "_part"]).withColumn(out, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


#: Nodes of a logical plan after which rows are dealt out anew anyway; asking such a plan for its partitions would run it.
_SHUFFLES = re.compile(r"\b(?:Join|Aggregate|Window|Sort|Repartition\w*|RebalancePartitions|GlobalLimit|Distinct|Deduplicate)\b")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where a plain scan has fewer partitions than there are cores (small inputs of few row groups).

    Larger inputs, and plans with a shuffle of their own, are returned as they are, so what this shuffles is at most one
    scan partition for each core.
    """
    if _SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def carry_last(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` of the rows up to this one, in the order of ``order`` within each group.

    As ``running_totals``: range partitions, then what the partitions before carry over; no group has to fit one task.
    """
    from pyspark.sql import Window

    ranged, _ = write_table(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.last(value, ignorenulls=True).over(w))
    ends = ranged.filter(F.col(value).isNotNull()).groupBy(*group, "_part").agg(F.max(F.struct(*order, value)).alias("_m"))
    parts = ranged.select(*group, "_part").distinct().join(ends, [*group, "_part"], "left")
    v = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_carry", F.last(F.col(f"_m.{value}"), ignorenulls=True).over(v)).drop("_m")
    return local.join(parts, [*group, "_part"]).withColumn(out, F.coalesce("_local", "_carry")).drop("_part", "_local", "_carry")


def carry_max(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the largest ``value`` of the rows up to this one, in the order of ``order`` within each group. As ``carry_last``."""
    from pyspark.sql import Window

    ranged, _ = write_table(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.max(value).over(w))
    v = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*group, "_part").agg(F.max(value).alias("_m")).withColumn("_carry", F.max("_m").over(v)).drop("_m")
    return local.join(parts, [*group, "_part"]).withColumn(out, F.greatest("_local", "_carry")).drop("_part", "_local", "_carry")
