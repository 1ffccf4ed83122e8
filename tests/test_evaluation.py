import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as ev
from corpusloom.operators import stats as st


def run(spark, rows):
    return spark.createDataFrame(rows, "system string, query_id int, rank int, lineage_id string")


def gold(spark, rows):
    return spark.createDataFrame(rows, "query_id int, lineage_id string")


def value(df, **w):
    for k, v in w.items():
        df = df.filter(F.col(k) == v)
    return df.first().value


def test_metrics(spark):
    r = run(spark, [("s", 1, 1, "x"), ("s", 1, 2, "a"), ("s", 1, 3, "y"), ("s", 1, 4, "x"), ("s", 2, 1, "z")])
    m = ev.metrics_at_k(r, gold(spark, [(1, "a"), (1, "b"), (3, "q")]), gold(spark, [(1, ""), (2, ""), (3, "")]), (3,))
    assert value(m, query_id=1, metric="recall") == 0.5 and value(m, query_id=1, metric="precision") == pytest.approx(1 / 3)
    assert value(m, query_id=1, metric="rr") == 0.5 and value(m, query_id=1, metric="ndcg") == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert value(m, query_id=2, metric="recall") is None and value(m, query_id=2, metric="hit") == 0.0
    assert value(m, query_id=3, metric="recall") == 0.0 and value(m, query_id=3, metric="precision") is None
    one = ev.metrics_at_k(run(spark, [("s", 1, 1, "x"), ("s", 1, 2, "a"), ("s", 1, 3, "y")]), gold(spark, [(1, "a")]), None, (3,))
    assert value(one, metric="ndcg") == pytest.approx(1 / math.log2(3))
    two = ev.metrics_at_k(run(spark, [("s", 1, 1, "a"), ("s", 1, 2, "y")]), gold(spark, [(1, "a")]), None, (10,))
    assert value(two, metric="precision") == 0.5
    agg = {(x.metric, x.k): (x.mean, x.n) for x in ev.aggregate(m).collect()}
    assert agg["recall", 3] == (0.25, 2)


def test_overlap_and_complementarity(spark):
    r = run(spark, [("dense", 1, 1, "a"), ("dense", 1, 2, "b"), ("dense", 1, 3, "c"), ("sparse", 1, 1, "b"), ("sparse", 1, 2, "c"), ("sparse", 1, 3, "d"), ("fused", 2, 1, "q")])
    j = {(x.system_a, x.system_b): x.jaccard for x in ev.overlap_matrix(r).collect()}
    assert j == {("dense", "sparse"): 0.5}  # both have query 1 only; no query in common, no row
    c = ev.complementarity(r, gold(spark, [(1, "a"), (2, "q"), (3, "n")]), ["dense", "sparse"], "fused").first()
    assert (c.only_dense, c.only_sparse, c.fusion_only, c.no_hit) == (1, 0, 1, 1)


def test_classes_and_pairs(spark):
    d = spark.createDataFrame([(None, None), (3, True), (30, True), (3, False), (3, None)], "rank int, ok boolean")
    got = [x[0] for x in d.select(ev.failure_class(F.lit(True) & F.col("rank").isNotNull(), F.col("rank"), F.col("ok"))).collect()]
    assert got == ["A", "D", "B", "C", "S"]
    a = spark.createDataFrame([(1, 3), (2, None), (3, 1), (4, None), (5, 2)], "query_id int, rank int")
    b = spark.createDataFrame([(1, 1), (2, 5), (3, 30), (4, None), (5, 2)], "query_id int, rank int")
    p = {x.query_id: (x.outcome, x.delta) for x in ev.paired(a, b).collect()}
    assert p == {1: ("promotion", -2), 2: ("recovery", -1), 3: ("regression", 10), 4: ("both_miss", 0), 5: ("tie", 0)}
    assert [x.context for x in ev.triage(a).orderBy("query_id").collect()] == ["in_context", "missed", "in_context", "missed", "in_context"]
    rows = [(None, "a", 0.1, False, 5), (12, "a", 0.9, True, 5), (2, None, None, None, None), (2, "a", 0.6, False, 3), (2, "a", 0.6, False, None), (2, "a", 0.0, True, 1), (2, "a", 0.1, None, 5)]
    e = spark.createDataFrame(rows, "rank int, answer string, f1 double, cites boolean, faithful int").select(ev.error_class(F.col("rank"), 10, F.col("answer"), F.col("f1"), F.col("cites"), F.col("faithful")))
    assert [x[0] for x in e.collect()] == ["RETRIEVAL_FAILURE", "PARTIAL_RETRIEVAL", "CORRECT", "CORRECT", "CORRECT_RETRIEVAL_WRONG_ANSWER", "CORRECT_RETRIEVAL_WRONG_ANSWER", "GENERATION_FAILURE"]


def test_judge_rates(spark):
    d = spark.createDataFrame([("a", 0.5, True, True), ("a", 0.0, None, None), ("a", None, False, False), ("b", None, None, None)], "s string, unsupported_claim_rate double, graph_reasoning_correct boolean, escalated boolean")
    assert {tuple(r) for r in ev.judge_rates(d, ["s"]).collect()} == {("a", 3, 0.25, 0.5, 0.333333), ("b", 1, None, None, 0.0)}


def test_attribution_and_order(spark):
    d = spark.createDataFrame([("q10", None, True, None, None), ("q9", True, True, None, None), ("q2", True, False, 3, True), ("q1", True, True, 9, True), ("q11", None, None, 2, False)], "q string, pool boolean, reach boolean, rank int, ok boolean")
    x = d.orderBy(*ev.natural_order(F.col("q"))).select("q", ev.attribution(F.col("reach"), F.col("pool")), ev.attribution_class(F.col("pool"), F.col("rank"), F.col("ok"))).collect()
    assert [tuple(r) for r in x] == [("q1", "recovered", "H3"), ("q2", "recovered", "H4"), ("q9", "recovered", "H2+H3"), ("q10", "candidate budget", "H1"), ("q11", "not reachable", "H1")]
    a, b = (spark.createDataFrame([(1, r), (2, s)], "query_id int, rank int") for r, s in ((3, None), (11, 1)))
    assert {tuple(r) for r in ev.recovery_matrix(a, b).collect()} == {(True, False, 1), (False, True, 1)}


def test_tables(spark):
    m = spark.createDataFrame([("s", "recall", 1, 0.5555, 3), ("s", "rr", 1, None, 0), ("b", "recall", 1, 0.0, 3)], "system string, metric string, k int, mean double, n long")
    t = {x.system: x for x in ev.table_by_k(m, ["recall", "rr"]).collect()}
    assert (t["s"].recall, t["s"].rr) == ("0.556", "n/a")
    d = ev.deltas(m.filter("metric = 'recall'"), "b").first()
    assert d.delta == 0.5555 and d.relative is None


def pairs(spark, rows):
    return spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "g string, key int, a double, b double")


def test_wilcoxon(spark):
    w = st.wilcoxon(pairs(spark, [(0, 1)] * 8), ["g"]).first()
    assert w.n == 8 and w.p < 0.05
    assert st.wilcoxon(pairs(spark, [(1, 1)] * 5), ["g"]).count() == 0
    assert st.wilcoxon(pairs(spark, [(1, 1), (0, 1)]), ["g"]).first().p is None
    rng = random.Random(4)
    rows = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(80)]
    d = [b - a for a, b in rows if a != b]
    size = sorted(map(abs, d))
    rank = lambda x: size.index(abs(x)) + (size.count(abs(x)) + 1) / 2
    r = st.signed_ranks(pairs(spark, rows), ["g"]).first()
    assert r.w_plus == sum(rank(x) for x in d if x > 0) and r.w_minus == sum(rank(x) for x in d if x < 0)
    assert st._signed_rank_p(5, 0, 0) == 2 / 32


def test_cohen_mcnemar(spark):
    assert st.cohen_d(pairs(spark, [(0, 1), (0, 1)]), ["g"]).first().cohen_d is None
    assert st.cohen_d(pairs(spark, [(0, 1), (0, 3)]), ["g"]).first().cohen_d == pytest.approx(2 / math.sqrt(2), abs=1e-6)
    m = spark.createDataFrame([("g", True, False)] * 30 + [("g", False, True)] * 10 + [("h", True, False)] * 3, "g string, a boolean, b boolean")
    got = {x.g: x for x in st.mcnemar(m, ["g"]).collect()}
    assert got["g"].p == pytest.approx(st.chi2_sf(400 / 40)) and got["g"].p_halved == got["g"].p / 2 and got["h"].p == 0.25


def test_bootstrap(spark):
    rng = random.Random(5)
    rows = [("g", i, rng.random()) for i in range(300)] + [("one", 1, 0.5), ("g", -1, None)]
    d = spark.createDataFrame(rows, "g string, key int, value double")
    got = {x.g: x for x in st.bootstrap_ci(d, ["g"], "key").collect()}
    again = {x.g: x for x in st.bootstrap_ci(d.repartition(7), ["g"], "key").collect()}
    v = [x for g, _, x in rows if g == "g" and x is not None]
    mean, low, high = st.small_bootstrap(v)
    assert got["g"].mean == pytest.approx(mean) and abs(got["g"].low - low) < 0.01 and abs(got["g"].high - high) < 0.01
    assert got["g"].low == pytest.approx(again["g"].low) and (got["one"].low, got["one"].high) == (0.5, 0.5)
    with pytest.raises(ValueError):
        st.small_bootstrap([])
    assert st.bootstrap_ci(d.limit(0), ["g"], "key").count() == 0


def test_list_bootstrap_and_index_percentiles(spark):
    assert st.list_bootstrap([]) is None and st.list_bootstrap([2.0])["ci95_low"] == 2.0
    one = st.list_bootstrap([0.0, 1.0] * 40)
    assert one == st.list_bootstrap([0.0, 1.0] * 40) and one["ci95_low"] < 0.5 < one["ci95_high"] and one["n"] == 80
    d = spark.createDataFrame([("g", i, float(i % 2)) for i in range(80)], "g string, key int, value double").repartition(5)
    r = st.bootstrap_ci(d, ["g"], "key", interpolate=False).first()
    assert r.mean == 0.5 and abs(r.low - one["ci95_low"]) < 0.05 and abs(r.high - one["ci95_high"]) < 0.05


def test_scenarios(spark):
    a = spark.createDataFrame([("b", 1, True, True), ("b", 5, True, False), ("b", None, False, None)], "baseline string, rank int, compliant boolean, called_compliant boolean")
    r = ev.scenario_summary(a).first()
    assert (r.n, r.hit_rate, r.mean_rank, r.top3, r.detection_accuracy) == (3, 0.666667, 3.0, 0.333333, 0.5)
    rows = [("obligation_strength", "It may do", "shall", "It shall do"), ("obligation_strength", "It may do", "shall", "It must do"), ("obligation_strength", "x", "must", "x must"), ("numeric_value", "in 6 days", "5", "in 5 days"), ("numeric_value", "in 6 days", "5", "in 7 days"),
            ("numeric_value", "in 6 days", None, "in 6 days"), ("numeric_value", "in 6 days", "5", " "), ("obligation_strength", "a", "shall", None), ("other", "a", None, "b"), (None, "a", None, "b")]
    d = spark.createDataFrame(rows, "k string, clause string, o string, c string")
    assert [x[0] for x in d.select(ev.correction_resolved(*[F.col(x) for x in ("k", "clause", "o", "c")])).collect()] == [True, False, True, True, False, False, False, False, True, None]
