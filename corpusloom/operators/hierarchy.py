"""Parent-child links to full hierarchies by pointer doubling."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import norm_key, norm_label
from ..scale import drop_table, heavy_keys, lookup, write_table

#: Root id of nodes on or below a cycle.
CYCLE = "cycle"


def parent_links(edges: DataFrame, kind: str = "part_of", kind_col: str = "kind", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node_id, parent_id), one row per child. Null or blank ends are no link; a child with several parents takes the smallest key."""
    e = edges.filter(norm_label(F.col(kind_col)) == kind) if kind_col else edges
    e = e.select(norm_key(F.col(src)).alias("node_id"), norm_key(F.col(dst)).alias("parent_id"))
    e = e.filter((F.length("node_id") > 0) & (F.length("parent_id") > 0))
    return e.groupBy("node_id").agg(F.min("parent_id").alias("parent_id"))


def hierarchy(links: DataFrame, paths: bool = True, max_rounds: int = 64) -> DataFrame:
    """Root, depth and (with ``paths``) the path of each child node.

    ``links``: (node_id, parent_id), one row per node_id. Out: node_id, root_id, node_depth and path (root first, the
    node last). Nodes on a cycle, or below one, have root_id 'cycle', node_depth -1 and a null path. An empty table gives
    an empty result; a self-link is a cycle of one.

    Each round joins every unresolved pointer with the pointer of the node it points to, which doubles the distance.
    After round k all nodes of depth up to 2**k are done. As every depth below the largest one occurs, a round that
    resolves nothing proves that what is left hangs on a cycle. Done rows are written once and serve further lookups
    without being rewritten; only the unresolved are carried on.
    """
    spark = links.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    start = links.select("node_id", F.col("parent_id").alias("anc"), F.lit(1).cast("long").alias("dist"), *([F.array("parent_id").alias("path")] if paths else []))
    cols = start.columns
    base, base_path = write_table(start, "links")
    used = [base_path]
    # round 0: a parent that is no child itself is a root
    inner = base.select(F.col("node_id").alias("anc"), F.lit(True).alias("_inner"))
    total = base.count()
    heavy = heavy_keys(base.groupBy("anc").agg(F.count("*").alias("n")), "anc", "n", total, parts)
    state, path = write_table(lookup(base, inner, "anc", heavy).select(*cols, F.col("_inner").isNull().alias("done")), "hier0")
    used.append(path)
    done, todo = [state.filter("done").drop("done")], state.filter("not done").drop("done")
    left = todo.count()
    for k in range(1, max_rounds + 1):
        if not left:
            break
        seen = done[0]
        for d in done[1:]:
            seen = seen.unionByName(d)
        table = seen.withColumn("_done", F.lit(True)).unionByName(todo.withColumn("_done", F.lit(False)))
        table = table.select(F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), *([F.col("path").alias("path2")] if paths else []), "_done")
        heavy = heavy_keys(todo.groupBy("anc").agg(F.count("*").alias("n")), "anc", "n", left, parts)
        stepped = lookup(todo, table, "anc", heavy, "inner").select(
            "node_id", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"),
            *([F.concat("path2", "path").alias("path")] if paths else []), F.col("_done").alias("done"))
        state, path = write_table(stepped, f"hier{k}")
        used.append(path)
        done.append(state.filter("done").drop("done"))
        todo = state.filter("not done").drop("done")
        now = todo.count()
        if now == left:
            break
        left = now
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    drop_table(spark, base_path)
    out = out.select("node_id", F.col("anc").alias("root_id"), F.col("dist").alias("node_depth"), *([F.concat("path", F.array("node_id")).alias("path")] if paths else []))
    lost = todo.select("node_id", F.lit(CYCLE).alias("root_id"), F.lit(-1).cast("long").alias("node_depth"), *([F.lit(None).cast("array<string>").alias("path")] if paths else []))
    return out.unionByName(lost) if left else out


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): a row for each descendant of each node, from the paths of ``hierarchy``.

    Rows, not lists, so that a root over a third of all nodes is no oversized value. Nodes on cycles have none.
    """
    x = tree.filter(F.col("path").isNotNull()).select("node_id", "node_depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "ancestor_id"))
    return x.select("ancestor_id", "node_id", (F.col("node_depth") - F.col("pos")).cast("long").alias("distance"))


def descendant_counts(links_tree: DataFrame) -> DataFrame:
    """Number of descendants and height of each node that has any."""
    return descendants(links_tree).groupBy("ancestor_id").agg(F.count("*").alias("n_descendants"), F.max("distance").alias("height"))
