"""Evaluation of ranked lists and answers.

Runs are (system, query_id, rank, lineage_id), gold is (query_id, lineage_id). Metrics come as a long table, so that
one group-by serves every system, metric and cut-off. An undefined metric is null, which means leave out.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20)


def first_places(runs: DataFrame, most: int = 20) -> DataFrame:
    """Runs without repeated items (the better rank stays), ranks closed up, cut to ``most``."""
    x = runs.groupBy("system", "query_id", "lineage_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("system", "query_id").orderBy("rank", "lineage_id")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def metrics_at_k(runs: DataFrame, gold: DataFrame, queries: DataFrame | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """(system, query_id, k, metric, value) of recall, precision, hit, rr and ndcg at each k.

    recall is null without relevant items, precision also without results; its divisor is min(k, results). ndcg's ideal
    list is as long as min(relevant, results within k, at least 1). hit, rr and ndcg are 0 without relevant items. With
    ``queries`` (query_id), those a system gave nothing for count too.
    """
    top = first_places(runs, max(ks))
    rel = gold.select("query_id", "lineage_id").distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = top.join(rel.withColumn("good", F.lit(1)), ["query_id", "lineage_id"], "left")
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    base = hits.select("system", "query_id", "rank", "good", k).groupBy("system", "query_id", "k").agg(
        F.sum(F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).alias("n_got"),
        F.sum(F.when((F.col("rank") <= F.col("k")) & F.col("good").isNotNull(), 1).otherwise(0)).alias("n_hit"),
        F.min(F.when((F.col("rank") <= F.col("k")) & F.col("good").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("rank") <= F.col("k")) & F.col("good").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    if queries is not None:
        grid = queries.select("query_id").distinct().join(F.broadcast(runs.select("system").distinct())).select("system", "query_id", k)  # systems are few
        base = grid.join(base, ["system", "query_id", "k"], "left").na.fill(0, ["n_got", "n_hit", "dcg"])
    x = base.join(n_rel, "query_id", "left").na.fill(0, ["n_rel"])
    ideal_n = F.least(F.col("n_rel"), F.greatest(F.col("n_got"), F.lit(1)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(ideal_n, F.lit(max(ks))), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    values = {
        "recall": F.when(F.col("n_rel") > 0, F.col("n_hit") / F.col("n_rel")),
        "precision": F.when((F.col("n_rel") > 0) & (F.col("n_got") > 0), F.col("n_hit") / F.least(F.col("k"), F.col("n_got"))),
        "hit": (F.col("n_hit") > 0).cast("double"), "rr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "ndcg": F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(v, 9).alias("value")) for n, v in values.items()])).alias("m")
    return x.select("system", "query_id", "k", pairs).select("system", "query_id", "k", "m.metric", "m.value")


def aggregate(metrics: DataFrame, *also: str) -> DataFrame:
    """Mean and number of the defined values by system, metric and k, and by the columns ``also``."""
    return metrics.groupBy("system", *also, "metric", "k").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def family_breakdown(metrics: DataFrame, families: DataFrame) -> DataFrame:
    """``aggregate`` by family and, as family 'ALL', over all: one rollup. families: (query_id, family)."""
    x = metrics.join(families, "query_id").rollup("system", "metric", "k", "family").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.grouping_id().alias("g"))
    return x.filter("g in (0, 1)").select("system", F.when(F.col("g") == 1, "ALL").otherwise(F.col("family")).alias("family"), "metric", "k", F.round("mean", 6).alias("mean"), "n")


def gold_ranks(runs: DataFrame, gold: DataFrame, most: int = 1 << 30) -> DataFrame:
    """(system, query_id, rank): best rank of a relevant item, for queries that have one."""
    return runs.join(gold.select("query_id", "lineage_id").distinct(), ["query_id", "lineage_id"], "left_semi").filter(F.col("rank") <= most).groupBy("system", "query_id").agg(F.min("rank").alias("rank"))


def candidate_recall(runs: DataFrame, gold: DataFrame, families: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 30)) -> DataFrame:
    """(system, family, k, n, recalled): queries whose target is among the first k, per family and over ALL."""
    systems = F.broadcast(runs.select("system").distinct())
    x = families.join(gold.select("query_id").distinct(), "query_id", "left_semi").join(systems).join(gold_ranks(runs, gold), ["system", "query_id"], "left")
    x = x.select("system", "family", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    y = x.rollup("system", "k", "family").agg(F.count("*").alias("n"), F.sum((F.coalesce("rank", F.lit(1 << 30)) <= F.col("k")).cast("int")).alias("recalled"), F.grouping_id().alias("g")).filter("g in (0, 1)")
    return y.select("system", F.when(F.col("g") == 1, "ALL").otherwise(F.col("family")).alias("family"), "k", "n", "recalled")


def overlap_matrix(runs: DataFrame, k: int = 10) -> DataFrame:
    """(system_a, system_b, jaccard): mean Jaccard of the first k of two systems over the queries that both have results for."""
    top = runs.filter(F.col("rank") <= k).select("system", "query_id", "lineage_id").distinct()
    size = top.groupBy("system", "query_id").agg(F.count("*").alias("n"))
    a, b = (size.select(F.col("system").alias(f"system_{x}"), "query_id", F.col("n").alias(f"n_{x}")) for x in "ab")
    both = top.select(F.col("system").alias("system_a"), "query_id", "lineage_id").join(top.select(F.col("system").alias("system_b"), "query_id", "lineage_id"), ["query_id", "lineage_id"]).filter("system_a < system_b").groupBy("system_a", "system_b", "query_id").agg(F.count("*").alias("n_ab"))
    x = a.join(b, "query_id").filter("system_a < system_b").join(both, ["system_a", "system_b", "query_id"], "left").na.fill(0, ["n_ab"])
    return x.groupBy("system_a", "system_b").agg(F.round(F.avg(F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))), 4).alias("jaccard"))


def complementarity(runs: DataFrame, gold: DataFrame, base: list[str], fused: str, k: int = 10) -> DataFrame:
    """One row of counts over the gold queries: hits only one of ``base`` has, hits only ``fused`` has, and queries without any hit."""
    hit = gold_ranks(runs, gold, k).select("query_id", "system")
    x = gold.select("query_id").distinct().join(hit.groupBy("query_id").agg(F.collect_set("system").alias("who")), "query_id", "left")
    who = F.coalesce("who", F.array().cast("array<string>"))
    among = F.array_intersect(who, F.array(*[F.lit(b) for b in base]))
    cols = [F.sum(((F.size(among) == 1) & F.array_contains(among, b)).cast("int")).alias(f"only_{b}") for b in base]
    return x.agg(*cols, F.sum(((F.size(among) == 0) & F.array_contains(who, fused)).cast("int")).alias("fusion_only"), F.sum((F.size(who) == 0).cast("int")).alias("no_hit"), F.count("*").alias("n_queries"))


def triage(ranks: DataFrame, window: int = 5) -> DataFrame:
    """Adds context: 'in_context' (rank within the window), 'retrieved' (further down) or 'missed' (no rank)."""
    return ranks.withColumn("context", F.when(F.col("rank").isNull(), "missed").when(F.col("rank") <= window, "in_context").otherwise("retrieved"))


def error_class(rank: Column, k: int, answer: Column, f1: Column, cites: Column, faithful: Column) -> Column:
    """RETRIEVAL_FAILURE (no rank), PARTIAL_RETRIEVAL (beyond k), CORRECT, CORRECT_RETRIEVAL_WRONG_ANSWER or GENERATION_FAILURE.

    An answer is right if it meets the reference answer (f1 of 0.5) or cites the target, and is judged faithful (3 of 5);
    a missing judgement, f1 or citation counts as 0. A target in place without any answer is CORRECT.
    """
    f1, cites = F.coalesce(f1, F.lit(0.0)), F.coalesce(cites, F.lit(False))
    return (F.when(rank.isNull(), "RETRIEVAL_FAILURE").when(rank > k, "PARTIAL_RETRIEVAL").when(answer.isNull(), "CORRECT")
            .when(((f1 >= 0.5) | cites) & (F.coalesce(faithful, F.lit(0)) >= 3), "CORRECT").when((f1 > 0.1) | cites, "CORRECT_RETRIEVAL_WRONG_ANSWER").otherwise("GENERATION_FAILURE"))


def failure_class(in_pool: Column, rank: Column, correct: Column, k: int = 10) -> Column:
    """A (target not in the pool), B (in the pool but not within k), C (within k, answer wrong), D (answer right), S (within k, not judged)."""
    return F.when(~F.coalesce(in_pool, F.lit(False)), "A").when(rank.isNull() | (rank > k), "B").when(correct.isNull(), "S").when(~correct, "C").otherwise("D")


def paired(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Ranks of two systems (query_id, rank) side by side, with outcome: recovery, regression, promotion, demotion, tie, both_miss; delta as below.

    delta: ranks beyond k count k + 1; both missed 0, only ``a`` missed -1, only ``b`` missed +1, else b - a.
    """
    x = a.select("query_id", F.col("rank").alias("rank_a")).join(b.select("query_id", F.col("rank").alias("rank_b")), "query_id")
    ina, inb = F.coalesce(F.col("rank_a") <= k, F.lit(False)), F.coalesce(F.col("rank_b") <= k, F.lit(False))
    cap = lambda c: F.when(F.col(c) > k, k + 1).otherwise(F.col(c))
    outcome = F.when(~ina & ~inb, "both_miss").when(~ina, "recovery").when(~inb, "regression").when(F.col("rank_b") < F.col("rank_a"), "promotion").when(F.col("rank_b") > F.col("rank_a"), "demotion").otherwise("tie")
    delta = F.when(F.col("rank_a").isNull() & F.col("rank_b").isNull(), 0).when(F.col("rank_a").isNull(), -1).when(F.col("rank_b").isNull(), 1).otherwise(cap("rank_b") - cap("rank_a"))
    return x.withColumn("outcome", outcome).withColumn("delta", delta.cast("long"))


def pair_compare(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, k, n, mean_a, mean_b, mean_diff, improved, degraded, unchanged) of two systems over queries both have; null counts as 0."""
    x = metrics.filter(F.col("system").isin(a, b)).groupBy("query_id", "metric", "k").agg(
        F.max(F.when(F.col("system") == a, F.coalesce("value", F.lit(0.0)))).alias("va"), F.max(F.when(F.col("system") == b, F.coalesce("value", F.lit(0.0)))).alias("vb")).filter("va is not null and vb is not null")
    d = F.round(F.col("vb") - F.col("va"), 9)
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return x.groupBy("metric", "k").agg(F.count("*").alias("n"), F.round(F.avg("va"), 6).alias("mean_a"), F.round(F.avg("vb"), 6).alias("mean_b"), F.round(F.avg(d), 6).alias("mean_diff"), rate(d > 0).alias("improved"), rate(d < 0).alias("degraded"), rate(d == 0).alias("unchanged"))


def table_by_k(means: DataFrame, metrics: list[str]) -> DataFrame:
    """Report table: a row per (system, k), a column per metric, three decimals, 'n/a' where undefined."""
    x = means.groupBy("system", "k").pivot("metric", metrics).agg(F.first("mean"))
    return x.select("system", "k", *[F.when(F.col(m).isNotNull(), F.format_string("%.3f", F.col(m))).otherwise("n/a").alias(m) for m in metrics])


def deltas(means: DataFrame, base: str) -> DataFrame:
    """Absolute and relative difference of each mean to that of system ``base``; relative is null where the base is 0."""
    b = means.filter(F.col("system") == base).select("metric", "k", F.col("mean").alias("base_mean"))
    x = means.filter(F.col("system") != base).join(F.broadcast(b), ["metric", "k"])
    return x.select("system", "metric", "k", F.round(F.col("mean") - F.col("base_mean"), 6).alias("delta"), F.round(F.try_divide(F.col("mean") - F.col("base_mean"), F.col("base_mean")), 6).alias("relative"))


def judge_summary(scored: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, mean, n) of judged columns; rows with an error are left out, booleans count as 0 and 1."""
    ok = scored.filter("error is null") if "error" in scored.columns else scored
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])).alias("m")
    return ok.select(*by, m).select(*by, "m.*").groupBy(*by, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def scenario_summary(audits: DataFrame) -> DataFrame:
    """(baseline, n, hit_rate, mean_rank, top3, detection_accuracy) of scenario audits (baseline, rank, compliant, called_compliant).

    The mean rank is over hits; accuracy over audits that made a call.
    """
    hit = F.col("rank").isNotNull()
    return audits.groupBy("baseline").agg(
        F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg((hit & (F.col("rank") <= 3)).cast("double")), 6).alias("top3"),
        F.round(F.avg((F.col("compliant") == F.col("called_compliant")).cast("double")), 6).alias("detection_accuracy"))


def correction_resolved(kind: Column, clause: Column, original: Column, correction: Column) -> Column:
    """Whether a proposed correction undoes the known deviation of ``clause``; null without a deviation.

    It must have text and differ from the clause. A changed value ('numeric_value') must be back in it as in ``original``;
    a changed duty ('obligation_strength') must say 'shall' if the original did, else 'must'.
    """
    cor = F.trim(F.coalesce(correction, F.lit("")))
    value = F.coalesce(original, F.lit(""))
    word = F.when(original == "shall", F.lit("shall")).otherwise(F.lit("must"))
    back = F.when(kind == "numeric_value", (value == "") | F.contains(cor, value)).when(kind == "obligation_strength", F.contains(cor, word)).otherwise(F.lit(True))
    return F.when(kind.isNotNull(), (cor != "") & (cor != F.coalesce(clause, F.lit(""))) & back)


def judge_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, unsupported_claim_rate, graph_reasoning_correct, escalation_rate): means over judged answers, 6 decimals.

    ``rows``: unsupported_claim_rate (a number), graph_reasoning_correct and escalated (booleans), null where not judged.
    The first two are means over the rows that have them, null without any; escalation is a share of all rows.
    """
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("unsupported_claim_rate")).alias("unsupported_claim_rate"), share(F.col("graph_reasoning_correct")).alias("graph_reasoning_correct"), share(F.coalesce("escalated", F.lit(False))).alias("escalation_rate"))


def attribution(reachable: Column, in_pool: Column) -> Column:
    """What became of a target: 'recovered', or why it is not in the pool: 'candidate budget' if it was within reach, else 'not reachable'."""
    return F.when(F.coalesce(in_pool, F.lit(False)), "recovered").when(F.coalesce(reachable, F.lit(False)), "candidate budget").otherwise("not reachable")


def attribution_class(in_pool: Column, rank: Column, correct: Column, k: int = 8) -> Column:
    """H1 (not in the pool), H2+H3 (in the pool, without a final rank), H4 (within k and answered rightly), H3 (anything else in the pool)."""
    there = F.coalesce(in_pool, F.lit(False))
    return F.when(~there, "H1").when(rank.isNull(), "H2+H3").when((rank <= k) & F.coalesce(correct, F.lit(False)), "H4").otherwise("H3")


def rank_class(in_pool: Column, before: Column, after: Column) -> Column:
    """G1 (target not in the pool), G3 (among the first ten before reranking and moved down by ten or more), G2 (all others)."""
    return F.when(~F.coalesce(in_pool, F.lit(False)), "G1").when((before <= 10) & (after - before >= 10), "G3").otherwise("G2")


def natural_order(query_id: Column) -> list[Column]:
    """Sort keys that put q2 before q10: length, then text."""
    return [F.length(query_id), query_id]


def recovery_matrix(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(found_a, found_b, n): queries by whether each of two systems (query_id, rank) has the target within k."""
    x = a.select("query_id", F.col("rank").alias("ra")).join(b.select("query_id", F.col("rank").alias("rb")), "query_id")
    inside = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    return x.groupBy(inside("ra").alias("found_a"), inside("rb").alias("found_b")).agg(F.count("*").alias("n"))
