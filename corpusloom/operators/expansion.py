"""Bounded graph expansion around seeds, with provenance, admission policies and distances.

Edges are (src, dst, kind, edge_ord); edge_ord is the stored order, by which the first of several ways wins.
Seeds are (query_id, node_id). Hops are unrolled joins: each level joins the frontier with the edges and drops what is known.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import carry_last, write_table

WALKED = ["CROSS_REFERENCES", "AMENDS"]


def _kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    return edges.filter(F.col("kind").isin(kinds)) if kinds else edges


def expand(seeds: DataFrame, edges: DataFrame, max_hops: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """(query_id, node_id, hop, kinds): nodes reached from the seeds along directed edges, with their least hop.

    ``kinds`` are those of the edges that reach a node at that hop. Seeds themselves are no result.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    e = _kinds(edges, kinds or WALKED).select("src", "dst", "kind").distinct()
    known = seeds.select("query_id", "node_id").distinct()
    front, out = known, None
    for hop in range(1, max_hops + 1):
        step = front.join(e, front["node_id"] == e["src"]).select("query_id", F.col("dst").alias("node_id"), "kind")
        step = step.join(known, ["query_id", "node_id"], "left_anti").groupBy("query_id", "node_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
        level = step.select("query_id", "node_id", F.lit(hop).alias("hop"), "kinds")
        out = level if out is None else out.unionByName(level)
        front = level.select("query_id", "node_id")
        known = known.unionByName(front)
    return out


def two_hop_paths(seeds: DataFrame, edges: DataFrame, real: DataFrame, kinds: list[str] | None = None, keep: int | None = None, max_hops: int = 2) -> DataFrame:
    """(query_id, node_id, hop, ord, path, relations): real nodes within two hops, each by its first way.

    Ways are ordered by hop, seed, order of the first edge, order of the second. A middle node need not be real. Seeds
    are never results. ``ord`` ranks the results of a query from 1; ``keep`` cuts there.
    """
    # of parallel edges, and of the seeds before a middle node, only the first can be part of a first way, so hubs are reduced before they meet
    e = _kinds(edges, kinds).groupBy("src", "dst").agg(F.min(F.struct("edge_ord", "kind")).alias("m")).select("src", "dst", "m.edge_ord", "m.kind")
    s = seeds.select("query_id", "node_id").distinct()
    there = real.select("node_id").distinct()
    one = s.join(e, s["node_id"] == e["src"]).select("query_id", F.col("node_id").alias("seed"), F.col("dst").alias("n1"), F.col("kind").alias("k1"), F.col("edge_ord").alias("o1"))
    one = one.groupBy("query_id", "n1").agg(F.min(F.struct("seed", "o1", "k1")).alias("m")).select("query_id", "n1", "m.*")
    none = F.lit(None).cast("string")
    ways = one.join(there, one["n1"] == there["node_id"], "left_semi").select("query_id", F.col("n1").alias("node_id"), F.lit(1).alias("hop"), "seed", "o1", F.lit(-1).cast("long").alias("o2"), "k1", none.alias("n1"), none.alias("k2"))
    if max_hops > 1:
        to = e.join(there, e["dst"] == there["node_id"], "left_semi")
        two = one.join(to, one["n1"] == to["src"]).select("query_id", F.col("dst").alias("node_id"), F.lit(2).alias("hop"), "seed", "o1", F.col("edge_ord").alias("o2"), "k1", "n1", F.col("kind").alias("k2"))
        ways = ways.unionByName(two)
    ways = ways.join(s, ["query_id", "node_id"], "left_anti")
    best = ways.groupBy("query_id", "node_id").agg(F.min(F.struct("hop", "seed", "o1", "o2", "k1", "n1", "k2")).alias("m")).select("query_id", "node_id", "m.*")
    best = best.withColumn("path", F.when(F.col("hop") == 1, F.array("seed", "k1", "node_id")).otherwise(F.array("seed", "k1", "n1", "k2", "node_id"))).withColumn("relations", F.array_distinct(F.array_compact(F.array("k1", "k2"))))
    w = Window.partitionBy("query_id").orderBy("hop", "seed", "o1", "o2", "node_id")
    best = best.withColumn("ord", F.row_number().over(w))
    if keep is not None:
        best = best.filter(F.col("ord") <= keep)
    return best.select("query_id", "node_id", "hop", "ord", "path", "relations")


def admit(paths: DataFrame, policy: str, keep: int) -> DataFrame:
    """Admission of expanded nodes under a budget: 'first', '2hop_first', or 'split_N_M' (first N of one hop, first M of two). ``ord`` is renewed."""
    m = re.fullmatch(r"split_(\d+)_(\d+)", policy)
    if policy not in ("first", "2hop_first") and not m:
        raise ValueError(f"unknown admission policy {policy!r}")
    x = paths
    order = ["ord"]
    if policy == "2hop_first":
        order = [F.col("hop").desc(), "ord"]
    elif m:
        x = x.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "hop").orderBy("ord")))
        x = x.filter(((F.col("hop") == 1) & (F.col("_n") <= int(m[1]))) | ((F.col("hop") == 2) & (F.col("_n") <= int(m[2])))).drop("_n")
    x = x.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return x.filter(F.col("ord") <= keep)


def two_hop_only(seeds: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(query_id, node_id) reached in two hops but not in one."""
    return expand(seeds, edges, 2, kinds).filter("hop = 2").select("query_id", "node_id")


def undirected_search(seeds: DataFrame, edges: DataFrame, targets: DataFrame, kinds: list[str], max_hops: int = 2, cap: int = 60) -> DataFrame:
    """(query_id, node_id, hop, score, seeds, kinds, rank): trails of one or two different edges in either direction.

    ``seeds``: (query_id, node_id, score); ``targets``: node_id that may be results. A target has its least hop, all
    seeds it hangs on, the kinds of all its trails and the best seed score; seeds that are targets join at hop 0.
    """
    if max_hops not in (1, 2):
        raise ValueError("max_hops must be 1 or 2")
    e = _kinds(edges, kinds).select("src", "dst", "kind")
    both = e.toDF("a", "b", "kind").unionByName(e.toDF("b", "a", "kind"))
    adj = both.groupBy("a", "b").agg(F.collect_set("kind").alias("ks"))
    real = targets.select("node_id").distinct()
    s = seeds.groupBy("query_id", F.col("node_id").alias("seed")).agg(F.max("score").alias("score"))
    near = s.join(adj, s["seed"] == adj["a"]).select("query_id", "seed", "score", F.col("b").alias("node_id"), "ks")

    def gathered(x: DataFrame) -> DataFrame:
        return x.groupBy("query_id", "node_id").agg(F.min("hop").alias("hop"), F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("seeds")))).alias("seeds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"))

    trails = near.filter("node_id != seed").join(real, "node_id", "left_semi").select("query_id", "node_id", F.lit(1).alias("hop"), "score", F.array("seed").alias("seeds"), F.col("ks").alias("kinds"))
    if max_hops == 1:
        got = gathered(trails)
    else:
        # all seeds next to a middle node stand in one row; the same edge twice would lead back to its seed, so leaving the seed out is enough
        mids, _ = write_table(near.groupBy("query_id", F.col("node_id").alias("mid")).agg(F.collect_list(F.struct("seed", "score", "ks")).alias("by")), "middles")
        to = adj.select(F.col("a").alias("mid"), F.col("b").alias("node_id"), F.col("ks").alias("k2")).join(real, "node_id", "left_semi")

        def over(x: DataFrame) -> DataFrame:
            x = x.withColumn("by", F.filter("by", lambda y: y["seed"] != F.col("node_id"))).filter(F.size("by") > 0)
            return x.select("query_id", "node_id", F.lit(2).alias("hop"), F.array_max(F.col("by.score")).alias("score"), F.col("by.seed").alias("seeds"), F.array_distinct(F.concat(F.flatten(F.col("by.ks")), F.col("k2"))).alias("kinds"))

        # Behind a middle node, more than cap targets come before the one at place cap + 3 by key, with no lower score (but for
        # one that is itself the best seed) and no more hops. So a hub's later targets can be among the first only if other
        # trails lead to them or they are seeds, and the hub's trails are looked up for these alone.
        wide = to.groupBy("mid").agg(F.count("*").alias("n")).filter(F.col("n") > cap + 2).select("mid")
        hubs, _ = write_table(to.join(wide, "mid", "left_semi"), "hubs")
        part, _ = write_table(gathered(trails.unionByName(over(mids.join(to.join(wide, "mid", "left_anti"), "mid")))), "trails")
        heads = hubs.withColumn("n", F.row_number().over(Window.partitionBy("mid").orderBy("node_id"))).filter(F.col("n") <= cap + 2).drop("n")
        likely = part.select("query_id", "node_id").unionByName(mids.select("query_id", "mid").join(heads.select("mid", "node_id"), "mid").select("query_id", "node_id")).unionByName(s.select("query_id", F.col("seed").alias("node_id"))).distinct()
        got = gathered(part.unionByName(over(likely.join(hubs, "node_id").join(mids, ["query_id", "mid"]))))
    zero = s.join(targets.select(F.col("node_id").alias("seed")).distinct(), "seed", "left_semi").groupBy("query_id", "seed").agg(F.max("score").alias("score"))
    zero = zero.select("query_id", F.col("seed").alias("node_id"), F.lit(0).alias("hop"), "score", F.array("seed").alias("seeds"), F.array().cast("array<string>").alias("kinds")).join(got.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "hop", "node_id")
    return got.unionByName(zero).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def distances(seeds: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """(query_id, node_id, hop): least undirected distance from the seeds over all kinds, seeds at 0, up to ``max_hops``."""
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    pairs, _ = write_table(pairs, "pairs")
    known = seeds.select("query_id", "node_id").distinct().withColumn("hop", F.lit(0))
    front = known
    for hop in range(1, max_hops + 1):
        step = front.join(pairs, front["node_id"] == pairs["a"]).select("query_id", F.col("b").alias("node_id")).distinct().join(known, ["query_id", "node_id"], "left_anti")
        front, _ = write_table(step.withColumn("hop", F.lit(hop)), "front")
        known = known.unionByName(front)
    return known


def target_distances(targets: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node_id, hop): least undirected distance of targets from the seeds over all kinds, where it is at most two.

    The same as ``distances`` to two hops, looked up from both ends: seeds and targets meet at a node that is at most one
    step from either, so the nodes around a hub between them are never formed.
    """
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()

    def around(x: DataFrame, step: str) -> DataFrame:
        x = x.select("query_id", "node_id").distinct()
        near = x.join(pairs, x["node_id"] == pairs["a"]).select("query_id", "node_id", F.col("b").alias("mid"), F.lit(1).alias(step))
        return x.select("query_id", "node_id", F.col("node_id").alias("mid"), F.lit(0).alias(step)).unionByName(near)

    from_seeds = around(seeds, "s").groupBy("query_id", "mid").agg(F.min("s").alias("s"))
    return around(targets, "t").join(from_seeds, ["query_id", "mid"]).groupBy("query_id", "node_id").agg(F.min(F.col("s") + F.col("t")).alias("hop"))


def admission_mechanism(targets: DataFrame, dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id, hop, mechanism): why a target was not admitted: OUT_OF_CORPUS, SEED_PRESENT (within two hops) or SEED_MISS."""
    x = targets.join(nodes.select("node_id", F.lit(True).alias("there")).distinct(), "node_id", "left").join(dist, ["query_id", "node_id"], "left")
    m = F.when(F.col("there").isNull(), "OUT_OF_CORPUS").when(F.col("hop") <= 2, "SEED_PRESENT").otherwise("SEED_MISS")
    return x.select("query_id", "node_id", "hop", m.alias("mechanism"))


def nearest_interval(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """(point_id, interval_id, inside, distance): for each point (point_id, key, at) the interval (interval_id, key, a, b) of its key that holds it, else the nearest.

    Intervals are half open and do not overlap within a key, so the nearest is the last that starts before the point or
    the first after it; of equally near ones the earlier. Points and starts are sorted together, so no pairs are formed.
    Keys without intervals, and null positions, give no row.
    """
    none = F.lit(None)
    iv = F.struct("a", "b", "interval_id")
    p = points.filter(F.col("at").isNotNull()).select(key, F.col("at").cast("long").alias("pos"), F.lit(1).alias("tag"), F.col("point_id").cast("string").alias("point_id"))
    i = intervals.filter("a is not null and b is not null").select(key, F.col("a").cast("long").alias("pos"), F.lit(0).alias("tag"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "interval_id")
    x = p.withColumn("iv", none.cast(f"struct<a:bigint,b:bigint,interval_id:{dict(intervals.dtypes)['interval_id']}>")).unionByName(i.select(key, "pos", "tag", none.cast("string").alias("point_id"), iv.alias("iv")))
    x = carry_last(x, [key], ["pos", "tag"], "iv", "before")
    x = x.withColumn("_r", -F.col("pos")).withColumn("_t", -F.col("tag"))
    x = carry_last(x, [key], ["_r", "_t"], "iv", "after").filter("tag = 1")
    far = lambda c: F.least(F.abs(F.col("pos") - F.col(f"{c}.a")), F.abs(F.col("pos") - F.col(f"{c}.b")))
    inside = F.coalesce(F.col("pos") < F.col("before.b"), F.lit(False))
    left = inside | F.col("after").isNull() | F.coalesce(far("before") <= far("after"), F.lit(False))
    x = x.filter("before is not null or after is not null")
    return x.select("point_id", F.when(left, F.col("before.interval_id")).otherwise(F.col("after.interval_id")).alias("interval_id"), inside.alias("inside"), F.when(inside, 0).when(left, far("before")).otherwise(far("after")).cast("long").alias("distance"))


def eligibility(targets: DataFrame, pool: DataFrame, seeds: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(query_id, node_id, status) of targets: 'in_pool', or what expansion could rescue them: 'one_hop', 'two_hop_only', 'unreachable'."""
    reach = expand(seeds, edges, 2, kinds).select("query_id", "node_id", "hop")
    x = targets.select("query_id", "node_id").distinct().join(pool.select("query_id", "node_id", F.lit(True).alias("held")).distinct(), ["query_id", "node_id"], "left").join(reach, ["query_id", "node_id"], "left")
    return x.select("query_id", "node_id", F.when(F.col("held"), "in_pool").when(F.col("hop") == 1, "one_hop").when(F.col("hop") == 2, "two_hop_only").otherwise("unreachable").alias("status"))


def strong_seeds(seeds: DataFrame, least: float, most: int = 15) -> DataFrame:
    """The best score of each seed of a query, those of at least ``least``, at most ``most`` per query."""
    best = seeds.groupBy("query_id", "node_id").agg(F.max("score").alias("score")).filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    return best.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
