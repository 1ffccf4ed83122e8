"""Queries over ranked lists: fusion, metrics, comparison, statistics, failure analysis."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import retrieval as rt
from ..operators import stats as st
from ..session import table
from . import common as c

SYSTEMS = ["dense", "sparse", "graph", "neo4j", "dense+sparse"]


def _families(s, d):
    g = c.gold(s, d).filter("rank = 1").select("query_id", "lineage_id")
    return g.join(c.nodes(s, d).select(F.col("node_id").alias("lineage_id"), "kind"), "lineage_id", "left").select("query_id", F.coalesce("kind", F.lit("none")).alias("family"))


def _metrics(s, d):
    return ev.metrics_at_k(c.runs(s, d), c.gold(s, d))


def _ranks(s, d, system):
    r = ev.gold_ranks(c.runs(s, d), c.gold(s, d)).filter(F.col("system") == system).select("query_id", "rank")
    return c.gold(s, d).select("query_id").distinct().join(r, "query_id", "left")


def _pairs(s, d):
    m = _metrics(s, d).filter("metric in ('ndcg', 'rr') and k = 10 and system in ('dense', 'sparse')")
    p = m.groupBy("query_id", "metric").agg(F.max(F.when(F.col("system") == "dense", F.col("value"))).alias("a"), F.max(F.when(F.col("system") == "sparse", F.col("value"))).alias("b"))
    return p.filter("a is not null and b is not null")


def ranked_lists(s, d):
    return c.lists(s, d).withColumn("score", F.round("score", 6))


def rrf_fusion(s, d):
    x = rt.rrf(c.lists(s, d).filter("method in ('dense', 'sparse')"))
    return x.select("query_id", "lineage_id", F.round("score", 6).alias("score"), F.array_join("methods", "|").alias("methods"))


def hybrid_pool(s, d):
    return rt.hybrid(c.lists(s, d).filter("method in ('dense', 'sparse')"), 10).select("query_id", "rank", "lineage_id", F.round("score", 6).alias("score"))


def mode_sparse(s, d):
    return rt.hybrid(c.lists(s, d).filter("method = 'sparse'"), 10).select("query_id", "rank", "lineage_id", F.round("score", 6).alias("score"))


def hybrid_graph(s, d):
    return rt.hybrid(c.lists(s, d).filter("method in ('dense', 'sparse', 'graph')"), 10).select("query_id", "rank", "lineage_id", F.round("score", 6).alias("score"))


def hybrid_boost(s, d):
    pool = rt.hybrid(c.lists(s, d).filter("method in ('dense', 'sparse')"), 10)
    edge = table(s, d, "retrieved_chunks").filter("graph_edge_type is not null").select("query_id", c.norm_key(F.col("lineage_id")).alias("lineage_id"), F.regexp_extract("graph_edge_type", r"@(\d)hop", 1).cast("int").alias("hop"))
    hops = edge.groupBy("query_id", "lineage_id").agg(F.min("hop").alias("hop"))
    return rt.boosted(pool, hops).select("query_id", "rank", "lineage_id", "score")


def best_dense_variant(s, d):
    return rt.best_variant(c.lists(s, d).filter("method in ('dense', 'dense+sparse')")).select("query_id", "method", F.round("top_score", 6).alias("top_score"))


def mean_rank_baseline(s, d):
    return rt.mean_rank_fusion(c.lists(s, d).filter("method in ('dense', 'sparse', 'graph')")).filter("rank <= 10").withColumn("mean_rank", F.round("mean_rank", 6))


def metrics_at_k(s, d):
    return _metrics(s, d).withColumn("value", F.round("value", 6))


def metrics_aggregate(s, d):
    return ev.aggregate(_metrics(s, d))


def family_breakdown(s, d):
    return ev.family_breakdown(_metrics(s, d).filter("k = 10"), _families(s, d))


def candidate_recall(s, d):
    return ev.candidate_recall(c.runs(s, d), c.gold(s, d), _families(s, d))


def overlap_jaccard(s, d):
    return ev.overlap_matrix(c.runs(s, d), 10)


def complementarity(s, d):
    return ev.complementarity(c.runs(s, d), c.gold(s, d), ["dense", "sparse", "graph"], "dense+sparse", 10)


def triage(s, d):
    return ev.triage(_ranks(s, d, "dense"))


def failure_classes(s, d):
    r = _ranks(s, d, "dense").join(_ranks(s, d, "graph").select("query_id", (F.col("rank") <= 10).alias("correct")), "query_id")
    return r.select("query_id", ev.failure_class(F.col("rank").isNotNull(), F.col("rank"), F.col("correct"), 5).alias("failure_class")).groupBy("failure_class").agg(F.count("*").alias("n"))


def pair_compare(s, d):
    return ev.pair_compare(_metrics(s, d), "dense", "sparse")


def paired_outcomes(s, d):
    return ev.paired(_ranks(s, d, "dense"), _ranks(s, d, "sparse"), 10)


def table_pivot(s, d):
    return ev.table_by_k(ev.aggregate(_metrics(s, d)), ["recall", "precision", "rr", "ndcg"])


def hybrid_deltas(s, d):
    return ev.deltas(ev.aggregate(_metrics(s, d)).filter("k = 10"), "dense")


def cohen_d(s, d):
    return st.cohen_d(_pairs(s, d), ["metric"])


def wilcoxon_ranks(s, d):
    return st.signed_ranks(_pairs(s, d), ["metric"]).select("metric", "n", "w_plus", "w_minus")


def wilcoxon_test(s, d):
    return st.wilcoxon(_pairs(s, d), ["metric"])


def mcnemar_counts(s, d):
    a, b = (_metrics(s, d).filter(f"metric = 'hit' and k = 10 and system = '{x}'").select("query_id", (F.col("value") > 0).alias(y)) for x, y in (("dense", "a"), ("sparse", "b")))
    return st.mcnemar(a.join(b, "query_id").withColumn("pair", F.lit("dense|sparse")), ["pair"]).select("pair", "only_a", "only_b")


def bootstrap_intervals(s, d):
    return st.bootstrap_ci(_metrics(s, d).filter("k = 10"), ["system", "metric"], "query_id")


def paired_bootstrap(s, d):
    return st.paired_bootstrap(_pairs(s, d), ["metric"], "query_id")


def judge_aggregate(s, d):
    x = table(s, d, "retrieved_chunks").select(F.coalesce("model_variant", F.lit("none")).alias("variant"), "score", (F.col("score") > 0).alias("positive"), F.when(F.isnan("score"), F.lit("nan")).alias("error"), "result_id").dropDuplicates(["result_id"])
    return ev.judge_summary(x, ["variant"], ["positive"])


def judge_rates(s, d):
    """No table holds judgements, so results stand for answers: the score's distance from 1 for unsupported claims, a graph edge for graph reasoning, a missing variant for escalation."""
    x = table(s, d, "retrieved_chunks").select("result_id", F.array_join(F.array_sort(F.transform("source_methods", c.norm_label)), "+").alias("system"), F.when(F.col("score").isNotNull() & ~F.isnan("score"), F.greatest(F.least(1 - F.col("score"), F.lit(1.0)), F.lit(0.0))).alias("unsupported_claim_rate"),
                                                   F.when(F.col("graph_edge_type").isNotNull(), F.col("graph_edge_type").contains("@1hop")).alias("graph_reasoning_correct"), F.col("model_variant").isNull().alias("escalated")).dropDuplicates(["result_id"]).drop("result_id")
    return ev.judge_rates(x, ["system"])


def attribution_classes(s, d):
    """Targets of the graph list: in the pool if it has them, right if the dense list has them within ten."""
    r = _ranks(s, d, "graph").select("query_id", F.col("rank").alias("r")).join(_ranks(s, d, "dense"), "query_id").join(_ranks(s, d, "neo4j").select("query_id", F.col("rank").isNotNull().alias("reach")), "query_id")
    x = r.select(ev.attribution(F.col("reach"), F.col("r").isNotNull()).alias("cause"), ev.attribution_class(F.col("r").isNotNull(), F.col("r"), F.col("rank") <= 10).alias("class"), ev.rank_class(F.col("r").isNotNull(), F.col("r"), F.col("rank")).alias("rank_class"))
    return x.groupBy("cause", "class", "rank_class").agg(F.count("*").alias("n"))


def recovery_matrix(s, d):
    return ev.recovery_matrix(_ranks(s, d, "dense"), _ranks(s, d, "sparse"))


def error_classes(s, d):
    """Labels of the dense list; the sparse list's score stands for the answer's f1, the graph list for its citation, the rank for its judgement."""
    x = _ranks(s, d, "dense").join(_ranks(s, d, "sparse").select("query_id", F.when(F.col("rank").isNotNull(), 1.0 / F.col("rank")).alias("f1")), "query_id").join(_ranks(s, d, "graph").select("query_id", F.col("rank").isNotNull().alias("cites"), (6 - F.col("rank")).alias("faithful")), "query_id")
    return x.groupBy(ev.error_class(F.col("rank"), 5, F.col("f1"), F.col("f1"), F.col("cites"), F.col("faithful")).alias("label")).agg(F.count("*").alias("n"))


def natural_ids(s, d):
    """Place of each article number of a document in natural order (2 before 10)."""
    x = c.nodes(s, d).filter("art_number is not null and doc_id is not null").select("doc_id", "art_number").distinct()
    return x.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*ev.natural_order(F.col("art_number")))).cast("long"))


QUERIES = {f.__name__: f for f in (ranked_lists, rrf_fusion, hybrid_pool, mode_sparse, hybrid_graph, hybrid_boost, best_dense_variant, mean_rank_baseline, metrics_at_k, metrics_aggregate, family_breakdown, candidate_recall, overlap_jaccard, complementarity, triage, failure_classes, pair_compare, paired_outcomes, table_pivot, hybrid_deltas, cohen_d, wilcoxon_ranks, wilcoxon_test, mcnemar_counts, bootstrap_intervals, paired_bootstrap, judge_aggregate, judge_rates, attribution_classes, recovery_matrix, error_classes, natural_ids)}

_L = f"WITH {c.LISTS}"
_M = f"WITH {c.LISTS}, {c.METRICS}"
_FAM = f"{c.NODES}, fam AS (SELECT query_id, coalesce(n.kind, 'none') AS family FROM gold LEFT JOIN n ON n.node_id = gold.lineage_id WHERE rank = 1)"
_RANKS = "gr AS (SELECT system, query_id, min(r.rank) AS rank FROM runs r SEMI JOIN gold g USING (query_id, lineage_id) GROUP BY 1, 2), gq AS (SELECT DISTINCT query_id FROM gold)"
_FUSED = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, lineage_id) AS rank, lineage_id, round(s, 6) AS score FROM (SELECT query_id, lineage_id, round(sum(1 / (60 + rank)), 9) AS s FROM l WHERE method IN ({}) GROUP BY 1, 2) QUALIFY rank <= 10"
_PAIRS = "p AS (SELECT a.query_id, a.metric, round(a.value, 9) AS a, round(b.value, 9) AS b FROM m a JOIN m b USING (query_id, metric, k) WHERE k = 10 AND a.system = 'dense' AND b.system = 'sparse' AND a.metric IN ('ndcg', 'rr'))"
_AGG = "agg AS (SELECT system, metric, k, round(avg(round(value, 9)), 6) AS mean, count(value) AS n FROM m GROUP BY ALL)"

ORACLE = {
    "ranked_lists": _L + " SELECT query_id, method, rank, lineage_id, round(score, 6) AS score FROM l",
    "rrf_fusion": _L + " SELECT query_id, lineage_id, round(sum(1 / (60 + rank)), 6) AS score, string_agg(method, '|' ORDER BY method) AS methods FROM l WHERE method IN ('dense', 'sparse') GROUP BY 1, 2",
    "hybrid_pool": _L + " " + _FUSED.format("'dense', 'sparse'"),
    "mode_sparse": _L + " " + _FUSED.format("'sparse'"),
    "hybrid_graph": _L + " " + _FUSED.format("'dense', 'sparse', 'graph'"),
    "hybrid_boost": _L + f", f AS ({_FUSED.format(chr(39) + 'dense' + chr(39) + ', ' + chr(39) + 'sparse' + chr(39)).replace('round(s, 6) AS score', 's')}), h AS (SELECT query_id, lower(trim(lineage_id, {c.B})) AS lineage_id, min(CAST(regexp_extract(graph_edge_type, '@([0-9])hop', 1) AS INT)) AS hop FROM retrieved_chunks WHERE graph_edge_type IS NOT NULL GROUP BY 1, 2) SELECT f.query_id, f.rank, f.lineage_id, round(s + CASE hop WHEN 1 THEN 0.05 WHEN 2 THEN 0.025 ELSE 0 END, 6) AS score FROM f LEFT JOIN h USING (query_id, lineage_id)",
    "best_dense_variant": _L + " SELECT query_id, method, round(score, 6) AS top_score FROM l WHERE rank = 1 AND method IN ('dense', 'dense+sparse') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, method) = 1",
    "mean_rank_baseline": _L + ", x AS (SELECT query_id, lineage_id, avg(rank) AS mean_rank, count(*) AS n_lists FROM l WHERE method IN ('dense', 'sparse', 'graph') GROUP BY 1, 2) SELECT query_id, lineage_id, round(mean_rank, 6) AS mean_rank, n_lists, row_number() OVER (PARTITION BY query_id ORDER BY mean_rank, lineage_id) AS rank FROM x QUALIFY rank <= 10",
    "metrics_at_k": _M + " SELECT system, query_id, k, metric, round(value, 6) AS value FROM m",
    "metrics_aggregate": _M + f", {_AGG} SELECT * FROM agg",
    "family_breakdown": _M + f", {_FAM}, x AS (SELECT m.system, m.metric, m.k, fam.family, round(value, 9) AS value FROM m JOIN fam USING (query_id) WHERE k = 10) SELECT system, coalesce(family, 'ALL') AS family, metric, k, round(avg(value), 6) AS mean, count(value) AS n FROM x GROUP BY GROUPING SETS ((system, metric, k, family), (system, metric, k))",
    "candidate_recall": _L + f", {_FAM}, {_RANKS}, x AS (SELECT s.system, fam.family, k, rank FROM fam CROSS JOIN (SELECT DISTINCT system FROM runs) s CROSS JOIN (SELECT unnest([5, 10, 20, 30]) AS k) LEFT JOIN gr ON gr.system = s.system AND gr.query_id = fam.query_id) SELECT system, coalesce(family, 'ALL') AS family, k, count(*) AS n, CAST(sum(CASE WHEN rank <= k THEN 1 ELSE 0 END) AS BIGINT) AS recalled FROM x GROUP BY GROUPING SETS ((system, family, k), (system, k))",
    "overlap_jaccard": _L + ", t AS (SELECT system, query_id, list(DISTINCT lineage_id) AS ids FROM runs WHERE rank <= 10 GROUP BY 1, 2) SELECT a.system AS system_a, b.system AS system_b, round(avg(len(list_intersect(a.ids, b.ids)) / len(list_distinct(a.ids || b.ids))), 4) AS jaccard FROM t a JOIN t b USING (query_id) WHERE a.system < b.system GROUP BY 1, 2",
    "complementarity": _L + f", {_RANKS}, w AS (SELECT query_id, max(CASE WHEN system = 'dense' THEN 1 ELSE 0 END) AS de, max(CASE WHEN system = 'sparse' THEN 1 ELSE 0 END) AS sp, max(CASE WHEN system = 'graph' THEN 1 ELSE 0 END) AS gp, max(CASE WHEN system = 'dense+sparse' THEN 1 ELSE 0 END) AS fu, count(*) AS n FROM gr WHERE rank <= 10 GROUP BY 1), y AS (SELECT gq.query_id, coalesce(de, 0) AS de, coalesce(sp, 0) AS sp, coalesce(gp, 0) AS gp, coalesce(fu, 0) AS fu, coalesce(n, 0) AS n FROM gq LEFT JOIN w USING (query_id)) SELECT count(*) FILTER (de = 1 AND sp + gp = 0) AS only_dense, count(*) FILTER (sp = 1 AND de + gp = 0) AS only_sparse, count(*) FILTER (gp = 1 AND de + sp = 0) AS only_graph, count(*) FILTER (de + sp + gp = 0 AND fu = 1) AS fusion_only, count(*) FILTER (n = 0) AS no_hit, count(*) AS n_queries FROM y",
    "triage": _L + f", {_RANKS} SELECT gq.query_id, rank, CASE WHEN rank IS NULL THEN 'missed' WHEN rank <= 5 THEN 'in_context' ELSE 'retrieved' END AS context FROM gq LEFT JOIN (SELECT * FROM gr WHERE system = 'dense') g USING (query_id)",
    "failure_classes": _L + f", {_RANKS}, x AS (SELECT gq.query_id, a.rank, b.rank <= 10 AS correct FROM gq LEFT JOIN (SELECT * FROM gr WHERE system = 'dense') a USING (query_id) LEFT JOIN (SELECT * FROM gr WHERE system = 'graph') b ON b.query_id = gq.query_id) SELECT CASE WHEN rank IS NULL THEN 'A' WHEN rank > 5 THEN 'B' WHEN correct IS NULL THEN 'S' WHEN NOT correct THEN 'C' ELSE 'D' END AS failure_class, count(*) AS n FROM x GROUP BY 1",
    "pair_compare": _M + ", x AS (SELECT query_id, metric, k, max(CASE WHEN system = 'dense' THEN coalesce(round(value, 9), 0) END) AS va, max(CASE WHEN system = 'sparse' THEN coalesce(round(value, 9), 0) END) AS vb FROM m WHERE system IN ('dense', 'sparse') GROUP BY 1, 2, 3) SELECT metric, k, count(*) AS n, round(avg(va), 6) AS mean_a, round(avg(vb), 6) AS mean_b, round(avg(round(vb - va, 9)), 6) AS mean_diff, round(avg(CASE WHEN round(vb - va, 9) > 0 THEN 1.0 ELSE 0 END), 6) AS improved, round(avg(CASE WHEN round(vb - va, 9) < 0 THEN 1.0 ELSE 0 END), 6) AS degraded, round(avg(CASE WHEN round(vb - va, 9) = 0 THEN 1.0 ELSE 0 END), 6) AS unchanged FROM x WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY 1, 2",
    "paired_outcomes": _L + f", {_RANKS}, x AS (SELECT gq.query_id, a.rank AS rank_a, b.rank AS rank_b FROM gq LEFT JOIN (SELECT * FROM gr WHERE system = 'dense') a USING (query_id) LEFT JOIN (SELECT * FROM gr WHERE system = 'sparse') b ON b.query_id = gq.query_id) SELECT *, CASE WHEN coalesce(rank_a > 10, true) AND coalesce(rank_b > 10, true) THEN 'both_miss' WHEN coalesce(rank_a > 10, true) THEN 'recovery' WHEN coalesce(rank_b > 10, true) THEN 'regression' WHEN rank_b < rank_a THEN 'promotion' WHEN rank_b > rank_a THEN 'demotion' ELSE 'tie' END AS outcome, CAST(CASE WHEN rank_a IS NULL AND rank_b IS NULL THEN 0 WHEN rank_a IS NULL THEN -1 WHEN rank_b IS NULL THEN 1 ELSE least(rank_b, 11) - least(rank_a, 11) END AS BIGINT) AS delta FROM x",
    "table_pivot": _M + f", {_AGG} SELECT system, k, coalesce(printf('%.3f', max(CASE WHEN metric = 'recall' THEN mean END)), 'n/a') AS recall, coalesce(printf('%.3f', max(CASE WHEN metric = 'precision' THEN mean END)), 'n/a') AS precision, coalesce(printf('%.3f', max(CASE WHEN metric = 'rr' THEN mean END)), 'n/a') AS rr, coalesce(printf('%.3f', max(CASE WHEN metric = 'ndcg' THEN mean END)), 'n/a') AS ndcg FROM agg GROUP BY 1, 2",
    "hybrid_deltas": _M + f", {_AGG} SELECT a.system, metric, k, round(a.mean - b.mean, 6) AS delta, CASE WHEN b.mean <> 0 THEN round((a.mean - b.mean) / b.mean, 6) END AS relative FROM agg a JOIN agg b USING (metric, k) WHERE k = 10 AND a.system <> 'dense' AND b.system = 'dense'",
    "cohen_d": _M + f", {_PAIRS} SELECT metric, count(*) AS n, round(avg(b - a), 6) AS mean_diff, round(avg(b - a) / stddev_samp(b - a), 6) AS cohen_d FROM p GROUP BY 1",
    "wilcoxon_ranks": _M + f", {_PAIRS}, dd AS (SELECT metric, round(b - a, 9) AS d FROM p WHERE round(b - a, 9) <> 0), r AS (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2 AS rk FROM dd) SELECT metric, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_minus FROM r GROUP BY 1",
    "mcnemar_counts": _M + " SELECT 'dense|sparse' AS pair, count(*) FILTER (a.value > 0 AND b.value = 0) AS only_a, count(*) FILTER (a.value = 0 AND b.value > 0) AS only_b FROM m a JOIN m b USING (query_id, metric, k) WHERE metric = 'hit' AND k = 10 AND a.system = 'dense' AND b.system = 'sparse'",
    "judge_aggregate": "WITH x AS (SELECT DISTINCT result_id, coalesce(model_variant, 'none') AS variant, score FROM retrieved_chunks) SELECT variant, 'positive' AS metric, round(avg(CASE WHEN score > 0 THEN 1.0 WHEN score IS NOT NULL THEN 0 END), 6) AS mean, count(score) AS n FROM x WHERE score IS NULL OR NOT isnan(score) GROUP BY 1",
    "judge_rates": f"WITH x AS (SELECT DISTINCT result_id, array_to_string(list_sort(list_transform(source_methods, lambda x: translate(lower(trim(x, {c.B})), ' -', '__'))), '+') AS system, score, graph_edge_type, model_variant FROM retrieved_chunks) SELECT system, count(*) AS n, round(avg(CASE WHEN score IS NOT NULL AND NOT isnan(score) THEN greatest(least(1 - score, 1), 0) END), 6) AS unsupported_claim_rate, round(avg(CASE WHEN graph_edge_type IS NOT NULL THEN CASE WHEN contains(graph_edge_type, '@1hop') THEN 1.0 ELSE 0 END END), 6) AS graph_reasoning_correct, round(avg(CASE WHEN model_variant IS NULL THEN 1.0 ELSE 0 END), 6) AS escalation_rate FROM x GROUP BY 1",
    "attribution_classes": _L + f", {_RANKS}, x AS (SELECT gq.query_id, g.rank AS r, de.rank, ne.rank IS NOT NULL AS reach FROM gq LEFT JOIN (SELECT * FROM gr WHERE system = 'graph') g USING (query_id) LEFT JOIN (SELECT * FROM gr WHERE system = 'dense') de USING (query_id) LEFT JOIN (SELECT * FROM gr WHERE system = 'neo4j') ne USING (query_id)) SELECT CASE WHEN r IS NOT NULL THEN 'recovered' WHEN reach THEN 'candidate budget' ELSE 'not reachable' END AS cause, CASE WHEN r IS NULL THEN 'H1' WHEN r <= 8 AND coalesce(rank <= 10, false) THEN 'H4' ELSE 'H3' END AS class, CASE WHEN r IS NULL THEN 'G1' WHEN r <= 10 AND rank - r >= 10 THEN 'G3' ELSE 'G2' END AS rank_class, count(*) AS n FROM x GROUP BY 1, 2, 3",
    "recovery_matrix": _L + f", {_RANKS} SELECT coalesce(a.rank <= 10, false) AS found_a, coalesce(b.rank <= 10, false) AS found_b, count(*) AS n FROM gq LEFT JOIN (SELECT * FROM gr WHERE system = 'dense') a USING (query_id) LEFT JOIN (SELECT * FROM gr WHERE system = 'sparse') b USING (query_id) GROUP BY 1, 2",
    "error_classes": _L + f", {_RANKS}, x AS (SELECT de.rank, 1.0 / sp.rank AS f1, g.rank IS NOT NULL AS cites, coalesce(6 - g.rank, 0) AS faith FROM gq LEFT JOIN (SELECT * FROM gr WHERE system = 'dense') de USING (query_id) LEFT JOIN (SELECT * FROM gr WHERE system = 'sparse') sp USING (query_id) LEFT JOIN (SELECT * FROM gr WHERE system = 'graph') g USING (query_id)) SELECT CASE WHEN rank IS NULL THEN 'RETRIEVAL_FAILURE' WHEN rank > 5 THEN 'PARTIAL_RETRIEVAL' WHEN f1 IS NULL THEN 'CORRECT' WHEN (f1 >= 0.5 OR cites) AND faith >= 3 THEN 'CORRECT' WHEN f1 > 0.1 OR cites THEN 'CORRECT_RETRIEVAL_WRONG_ANSWER' ELSE 'GENERATION_FAILURE' END AS label, count(*) AS n FROM x GROUP BY 1",
    "natural_ids": f"WITH {c.NODES}, x AS (SELECT DISTINCT doc_id, art_number FROM n WHERE art_number IS NOT NULL AND doc_id IS NOT NULL) SELECT doc_id, art_number, row_number() OVER (PARTITION BY doc_id ORDER BY length(art_number), art_number) AS place FROM x",
}
