"""Property graph tables: clean-up, validation, summaries and exploration."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import norm_key, norm_label


EDGE_COLUMNS = ["src", "dst", "kind", "doc_id", "char_offset", "snippet", "unresolved", "ref_number", "recorded_at"]


def clean_edges(edges: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Edges with keys and kinds in normal form, each edge_id once (the latest arrival), with edge_ord = edge_id.

    Only ``columns`` (all of EDGE_COLUMNS by default) are read and shuffled.
    """
    forms = {"src": norm_key(F.col("src")), "dst": norm_key(F.col("dst")), "kind": F.upper(norm_label(F.col("kind"))), "doc_id": norm_key(F.col("doc_id")), "ref_number": norm_key(F.col("ref_number"))}
    keep = columns or EDGE_COLUMNS
    x = edges.filter("edge_id is not null").select("edge_id", *[forms.get(c, F.col(c)).alias(c) for c in keep], F.coalesce("ingested_at", F.lit("0001-01-02").cast("timestamp")).alias("at"))
    last = x.groupBy("edge_id").agg(F.max(F.struct("at", *[F.col(c) for c in keep])).alias("m"))
    return last.select("edge_id", *[F.col(f"m.{c}") for c in keep], F.col("edge_id").alias("edge_ord"))


def clean_nodes(nodes: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per node key: node_id, kind, doc_id, art_number, title, term, alive (whether a life is open); the latest life gives the values."""
    cols = ["kind", "doc_id", "art_number", "title", "term"]
    a = nodes.select(norm_key(F.col("lineage_id")).alias("node_id"), F.lower(F.trim("kind")).alias("kind"), norm_key(F.col("doc_id")).alias("doc_id"), "art_number", "title", "term", "created_at", "deleted_at")
    b = reference.select(norm_key(F.col("lineage_id")).alias("node_id"), F.lower(F.trim("kind")).alias("kind"), F.lit(None).cast("string").alias("doc_id"), "art_number", F.coalesce("title", "label").alias("title"), F.lit(None).cast("string").alias("term"), "created_at", "deleted_at")
    x = a.unionByName(b).filter("node_id is not null")
    g = x.groupBy("node_id").agg(F.max(F.struct("created_at", *[F.col(c) for c in cols])).alias("m"), F.max(F.col("deleted_at").isNull()).alias("alive"))
    return g.select("node_id", *[F.col(f"m.{c}") for c in cols], "alive")


def edge_summary(edges: DataFrame) -> DataFrame:
    """Edges and unresolved ones by document and kind, with subtotals ('ALL') of documents and over all."""
    x = edges.rollup("doc_id", "kind").agg(F.count("*").alias("n_edges"), F.sum(F.coalesce(F.col("unresolved"), F.lit(False)).cast("long")).alias("n_unresolved"), F.grouping_id().alias("g"))
    return x.select(F.when(F.col("g") == 3, "ALL").otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("g") >= 1, "ALL").otherwise(F.col("kind")).alias("kind"), "n_edges", "n_unresolved")


def edge_pivot(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """A row per document, a column per kind with the number of its edges."""
    x = edges.groupBy("doc_id").pivot("kind", kinds).agg(F.count(F.lit(1)))
    return x.na.fill(0).select("doc_id", *[F.col(k).cast("long").alias(k.lower()) for k in kinds])


def edge_problems(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(problem, n): duplicate keys, dangling ends, missing evidence, long snippets, wrong unresolved flags."""
    ids = nodes.select("node_id").distinct()
    dup = edges.filter("src is not null and dst is not null").groupBy("src", "dst", "kind").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_key").alias("problem"), F.lit(1).alias("one"))
    dang = lambda c: edges.filter(F.col(c).isNotNull()).join(ids.withColumnRenamed("node_id", c), c, "left_anti").select(F.lit(f"dangling_{c}").alias("problem"), F.lit(1).alias("one"))
    tests = F.array(F.when(F.col("snippet").isNull() | (F.trim("snippet") == ""), F.lit("no_evidence")), F.when(F.length("snippet") > 120, F.lit("long_snippet")), F.when(F.coalesce(F.col("dst").startswith("ext:"), F.lit(False)) != F.coalesce("unresolved", F.lit(False)), F.lit("wrong_flag")))
    own = edges.select(F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("problem"), F.lit(1).alias("one"))
    return dup.unionByName(dang("src")).unionByName(dang("dst")).unionByName(own).groupBy("problem").agg(F.count("*").alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, kind, n_out, n_in, n_distinct_out): degrees of every node, 0 where it has no edge."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n_out"), F.count_distinct("dst").alias("n_distinct_out"))
    inn = edges.filter("dst is not null").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n_in"))
    return nodes.select("node_id", "kind").join(out, "node_id", "left").join(inn, "node_id", "left").na.fill(0, ["n_out", "n_in", "n_distinct_out"]).select("node_id", "kind", "n_out", "n_in", "n_distinct_out")


def hubs(deg: DataFrame) -> DataFrame:
    """(kind, node_id, degree): the node with most edges of each kind of node; of equals the smallest key."""
    x = deg.withColumn("degree", F.col("n_out") + F.col("n_in"))
    top = x.groupBy("kind").agg(F.max("degree").alias("degree"))
    return x.join(top, ["kind", "degree"], "left_semi").groupBy("kind", "degree").agg(F.min("node_id").alias("node_id")).select("kind", "node_id", "degree")


def isolated(deg: DataFrame) -> DataFrame:
    return deg.filter("n_out = 0 and n_in = 0").groupBy("kind").agg(F.count("*").alias("n_isolated"))


def citations(edges: DataFrame) -> DataFrame:
    """(doc_id, cites_out, cited_in): cross-document references of each document, both ways."""
    from ..functions.text import doc_of

    x = edges.filter("kind = 'CROSS_REFERENCES' and dst is not null").select(doc_of(F.col("src")).alias("a"), doc_of(F.col("dst")).alias("b")).filter("a != b")
    both = x.select(F.col("a").alias("doc_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(x.select(F.col("b").alias("doc_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("doc_id").agg(F.sum("o").alias("cites_out"), F.sum("i").alias("cited_in"))


def two_hop_chains(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(a, b, c, k1, k2): chains over two edges whose ends lie in different documents and are not the same node."""
    from ..functions.text import doc_of

    e = edges.filter(F.col("kind").isin(kinds) & F.col("dst").isNotNull()).select("src", "dst", "kind").distinct()
    l, r = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("kind").alias("k1")), e.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("kind").alias("k2"))
    return l.join(r, "b").filter((F.col("a") != F.col("c")) & (doc_of(F.col("a")) != doc_of(F.col("c")))).select("a", "b", "c", "k1", "k2")


def distractors(edges: DataFrame, most: int = 3) -> DataFrame:
    """(src, dst, other): for each cross-reference, other targets of the same source as wrong answers, by stored order, at most ``most``.

    The next different targets in the circle of a source's references are taken, so a source with many references gives
    ``most`` rows per reference and never all pairs.
    """
    from pyspark.sql import Window

    e = edges.filter("kind = 'CROSS_REFERENCES' and dst is not null").groupBy("src", "dst").agg(F.min("edge_ord").alias("edge_ord"))
    w = Window.partitionBy("src").orderBy("edge_ord")
    x = e.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("src")))
    step = x.select("src", "dst", "pos", "n", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("d")).filter("d < n").withColumn("want", (F.col("pos") + F.col("d")) % F.col("n"))
    return step.join(x.select("src", F.col("pos").alias("want"), F.col("dst").alias("other")), ["src", "want"]).select("src", "dst", "other")
