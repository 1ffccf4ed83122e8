"""Writers, keyed merges and fingerprints."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relations that a graph store takes.
KINDS = ["CROSS_REFERENCES", "AMENDS", "DEFINED_IN", "APPLIES_TO", "PART_OF", "IMPLEMENTS", "SUPERSEDES"]


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed merge: a row per key of either side, values of ``new`` before those of ``old``, nulls never overwriting.

    Rows of one key within ``new`` fall together (the largest value of each column); a null key is no row.
    """
    cols = [c for c in old.columns if c not in keys]
    n = new.dropna(subset=keys).groupBy(*keys).agg(*[F.max(c).alias(f"_n_{c}") for c in cols])
    return old.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) for c in cols])


def reject_malformed(df: DataFrame, required: list[str], kinds: list[str] | None = None) -> DataFrame:
    """``df`` itself; rows that lack a required value or have an unknown kind raise an error with their number."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    if kinds is not None:
        bad = bad | ~F.coalesce(F.col("kind").isin(kinds), F.lit(False))
    n = df.filter(bad).count()
    if n:
        raise ValueError(f"{n} malformed rows")
    return df


def upsert(path: str, new: DataFrame, keys: list[str], required: list[str] | None = None, kinds: list[str] | None = None) -> None:
    """Idempotent merge of ``new`` into the parquet table at ``path``; the same rows again change nothing.

    The merged table is written once, beside the old one, and the two change places by renames. At any moment the whole
    old or the whole new table exists at ``path`` or ``path.prev``; the next call puts back what a crash left at ``.prev``.
    """
    spark = new.sparkSession
    reject_malformed(new, required or keys, kinds)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, prev, nxt = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".prev", ".next"))
    fs = here.getFileSystem(conf)
    if not fs.exists(here) and fs.exists(prev):
        fs.rename(prev, here)
    if not fs.exists(here):
        merged(new.limit(0), new, keys).write.mode("overwrite").parquet(path + ".next")
    else:
        merged(spark.read.parquet(path), new, keys).write.mode("overwrite").parquet(path + ".next")
        fs.delete(prev, True)
        fs.rename(here, prev)
    fs.rename(nxt, here)
    fs.delete(prev, True)
    spark.catalog.refreshByPath(path)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that come more than once: what a uniqueness constraint would reject."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """nodes and edges as JSON lines, edges partitioned by kind so that readers of few kinds skip the rest, and a summary."""
    from ..operators.graphs import edge_pivot

    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.repartition("kind").write.mode("overwrite").partitionBy("kind").json(f"{folder}/edges")
    edge_pivot(edges, KINDS).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/graph_summary")


def write_chunks(chunks: DataFrame, folder: str) -> None:
    chunks.repartition("doc_id").write.mode("overwrite").parquet(f"{folder}/chunks")
    chunk_summary(chunks).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/chunk_summary")


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_thin, n_absorbed, min_chars, mean_chars, max_chars) of non-null texts; the mean is cut to an integer."""
    n = F.length(F.coalesce("text", F.lit("")))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.coalesce(F.col("thin"), F.lit(False)).cast("long")).alias("n_thin"), F.sum(F.coalesce(F.size("absorbed"), F.lit(0)).cast("long")).alias("n_absorbed"), F.min(n).cast("long").alias("min_chars"), F.floor(F.avg(n)).cast("long").alias("mean_chars"), F.max(n).cast("long").alias("max_chars"))


def write_report(table: DataFrame, folder: str, fmt: str = "csv") -> None:
    """A small table as one file: csv with a header, json lines, or parquet."""
    w = table.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(folder) if fmt == "csv" else w.format(fmt).save(folder)


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A report table as markdown; more than ``most`` rows are an error, as no report has them."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError("not a report table")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("n/a" if v is None else str(v) for v in r) + " |" for r in got)])


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, sha256): a digest of all rows as JSON, whatever their order, from digests of rows added up in parts."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    return df.agg(F.count("*").alias("n_rows"), *words).select("n_rows", F.sha2(F.concat_ws(",", *[F.coalesce(f"w{i}", F.lit(0)).cast("string") for i in range(8)]), 256).alias("sha256"))
