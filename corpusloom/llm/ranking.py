"""One ranking from several differently scaled scores, through percentiles and the inverse normal distribution."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..keys import norm_key, norm_label
from ..scale import write_table

# fixed values: the published rational approximation of the normal quantile (Wichura, algorithm AS 241), coefficients from the highest power down
CENTRE = ([2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0],
          [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0])
SIDES = ([7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0],
         [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0])
TAILS = ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0],
         [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0])


def probit(p: Column) -> Column:
    """The inverse normal distribution of a probability between 0 and 1, both excluded."""

    def ratio(of: tuple[list[float], list[float]], r: Column) -> Column:
        top, low = F.lit(of[0][0]), F.lit(of[1][0])
        for a, b in zip(of[0][1:], of[1][1:]):
            top, low = top * r + a, low * r + b
        return top / low

    q = p - 0.5
    far = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    outer = F.when(far <= 5.0, ratio(SIDES, far - 1.6)).otherwise(ratio(TAILS, far - 5.0))
    return F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, 0.180625 - q * q)).otherwise(F.when(q < 0, -outer).otherwise(outer))


def probit_or_0(p: Column) -> Column:
    return F.when(p > 0, probit(p)).otherwise(0.0)


def list_name(methods: Column) -> Column:
    """One list for each set of methods: order, case and repeats do not matter; null and empty sets are one list of their own."""
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(methods, lambda x: x.isNotNull()), norm_label))), "+"), F.lit(""))


def tied_percentiles(scored: DataFrame, group: list[str], sizes: DataFrame) -> DataFrame:
    """Percentile of each distinct score of a group, ties averaged, the absent tied below all.

    ``scored``: group columns and ``score`` (no null, no NaN). ``sizes``: group columns and ``n_all``, the number of
    items that are ranked in the group, present or not. Out: group columns, score, p.

    The rank is a running count, made in two steps so that no group has to fit one task: scores, counted first, are
    range partitioned, counted within each partition, and lifted by what lies in the partitions before.
    """
    counts = scored.groupBy(*group, "score").agg(F.count("*").alias("n"))
    ranged, _ = write_table(counts.repartitionByRange(*group, "score").withColumn("part", F.spark_partition_id()), "scores")
    w = Window.partitionBy(*group, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    parts = ranged.groupBy(*group, "part").agg(F.sum("n").alias("n_part"))
    v = Window.partitionBy(*group)
    parts = parts.withColumn("before", F.coalesce(F.sum("n_part").over(v.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n_scored", F.sum("n_part").over(v))
    x = local.join(parts, [*group, "part"]).join(sizes, group)
    absent = F.col("n_all") - F.col("n_scored")
    return x.select(*group, "score", ((absent + F.col("before") + F.col("below") + F.col("n") / 2.0) / F.col("n_all")).alias("p"), (absent / 2.0 / F.col("n_all")).alias("p_absent"))


def fused_ranking(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, lineage_id, fused, n_lists): a combined score of each item of each query; order by it, then by lineage_id.

    In each list of a query every score becomes its percentile among all items of the query, ties averaged; items that
    are absent from the list, or whose score is null or NaN, are tied below all others. Percentiles go through the
    inverse normal distribution; ``fused`` is their weighted mean over the lists (all equal without ``weights``, by
    list name). Rows sent again, and keys that differ in case or outer blanks, count once with their best score. Null
    query or item keys are left out; an empty table gives an empty result.

    Rows are shuffled once, by query. Queries with more than a quarter of a partition's share of all rows (at most four
    per partition) are taken out and ranked over range partitions instead, with the same result.
    """
    spark = results.sparkSession
    base = results.select("query_id", norm_key(F.col("lineage_id")).alias("lineage_id"), list_name(F.col("source_methods")).alias("list"),
                          F.when(F.isnan("score"), None).otherwise(F.col("score")).alias("score")).filter("query_id is not null and lineage_id is not null")
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("list") == name, float(w)).otherwise(weight)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(results.count() // (4 * parts), LEAST_HOT)
    hot = [r[0] for r in results.filter("query_id is not null").groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("query_id").collect()]
    if not hot:
        return _by_query(base, weight)
    return _by_query(base.filter(~F.col("query_id").isin(hot)), weight).unionByName(_over_ranges(base.filter(F.col("query_id").isin(hot)), weight))


#: Rows of a query, at least, before it is split over several tasks.
LEAST_HOT = 1000


def _by_query(base: DataFrame, weight: Column) -> DataFrame:
    """``fused_ranking`` of queries that each fit one task; all steps keep the partitioning by query."""
    query, in_list = Window.partitionBy("query_id"), Window.partitionBy("query_id", "list")
    x = base.repartition("query_id").groupBy("query_id", "list", "lineage_id").agg(F.max("score").alias("score"))
    x = x.withColumn("item", F.dense_rank().over(query.orderBy("lineage_id"))).withColumn("n_all", F.max("item").over(query)).drop("item")
    x = x.withColumn("place", F.rank().over(in_list.orderBy("score"))).withColumn("nth", F.row_number().over(in_list.orderBy("score"))).withColumn("n", F.count("*").over(Window.partitionBy("query_id", "list", "score")))
    x = x.withColumn("n_rows", F.count("*").over(in_list)).withColumn("n_scored", F.count("score").over(in_list))
    absent, nulls = F.col("n_all") - F.col("n_scored"), F.col("n_rows") - F.col("n_scored")
    x = x.withColumn("z0", probit_or_0(absent / 2.0 / F.col("n_all"))).withColumn("z", probit((absent + F.col("place") - 1 - nulls + F.col("n") / 2.0) / F.col("n_all")))
    once = (F.col("nth") == 1) & (F.col("n_scored") > 0)
    x = x.groupBy("query_id", "lineage_id").agg(F.sum(F.when(F.col("score").isNotNull(), weight * (F.col("z") - F.col("z0"))).otherwise(0.0)).alias("gain"), F.count("score").alias("n_lists"),
                                                F.sum(F.when(once, F.col("z0") * weight).otherwise(0.0)).alias("z_floor"), F.sum(F.when(once, weight)).alias("w_all"))
    fused = (F.sum("z_floor").over(query) + F.col("gain")) / F.sum("w_all").over(query)
    return x.select("query_id", "lineage_id", fused.alias("fused"), "n_lists")


def _over_ranges(base: DataFrame, weight: Column) -> DataFrame:
    """``fused_ranking`` of a few queries of any size: ranks are running counts over range partitions of distinct scores."""
    base, _ = write_table(base.groupBy("query_id", "list", "lineage_id").agg(F.max("score").alias("score")), "results")
    items = base.groupBy("query_id", "lineage_id").agg(F.count("*").alias("n_rows"))
    n_items = items.groupBy("query_id").agg(F.count("*").alias("n_all"))
    scored = base.filter("score is not null")
    pct = tied_percentiles(scored, ["query_id", "list"], scored.select("query_id", "list").distinct().join(n_items, "query_id"))
    pct = pct.select("query_id", "list", "score", probit(F.col("p")).alias("z"), probit_or_0(F.col("p_absent")).alias("z0"))
    pct, _ = write_table(pct, "percentiles")
    # every item starts from the floor of all lists and gains where it is present
    floors = pct.groupBy("query_id", "list").agg(F.max("z0").alias("z0")).groupBy("query_id").agg(F.sum(F.col("z0") * weight).alias("z_floor"), F.sum(weight).alias("w_all"))
    gain = scored.join(pct, ["query_id", "list", "score"]).groupBy("query_id", "lineage_id").agg(F.sum(weight * (F.col("z") - F.col("z0"))).alias("gain"), F.count("*").alias("n_lists"))
    x = items.join(gain, ["query_id", "lineage_id"], "left").join(floors, "query_id", "left")
    fused = (F.col("z_floor") + F.coalesce("gain", F.lit(0.0))) / F.col("w_all")
    return x.select("query_id", "lineage_id", fused.alias("fused"), F.coalesce("n_lists", F.lit(0)).alias("n_lists"))


def first_items(ranking: DataFrame) -> DataFrame:
    """The first item of each query; equal scores fall to the smaller key. A query without any score has none."""
    first = F.min_by("lineage_id", F.struct((-F.round("fused", 9)).alias("f"), "lineage_id"))
    return ranking.filter("fused is not null").groupBy("query_id").agg(first.alias("lineage_id"))
