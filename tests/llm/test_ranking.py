import math
import random
from collections import defaultdict
from statistics import NormalDist

from corpusloom.llm import ranking as rk

S = "result_id long, query_id long, lineage_id string, source_methods array<string>, score double, list string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], S)


def brute(rows):
    lists, items = defaultdict(dict), defaultdict(set)
    for q, l, m, s in rows:
        items[q].add(l)
        d = lists[q, tuple(sorted(set(m)))]
        if s is not None and not math.isnan(s):
            d[l] = max(s, d.get(l, -math.inf))
    out = {}
    for q, all_ in items.items():
        ls = [d for (k, _), d in lists.items() if k == q and d]
        for l in all_:
            z = 0.0
            for d in ls:
                absent = len(all_) - len(d)
                p = (absent / 2 if l not in d else absent + sum(v < d[l] for v in d.values()) + sum(v == d[l] for v in d.values()) / 2) / len(all_)
                z += NormalDist().inv_cdf(p)
            out[q, l] = z / len(ls) if ls else None
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for q in range(5):
        for m, scale in ((["dense"], 1), (["sparse"], 90), (["dense", "sparse"], 0.01), (["graph"], -5)):
            for l in rng.sample(range(30), 12):
                rows.append((q, f"d:{l}", m, rng.choice([None, float("nan"), float(rng.randint(0, 6) * scale), rng.random() * scale])))
    got = {(r.query_id, r.lineage_id): r.fused for r in rk.fused_ranking(frame(spark, rows + rows[:20])).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (v is None and got[k] is None) or abs(got[k] - v) < 1e-9


def test_scale_does_not_matter_and_ties(spark):
    rows = [(1, "a", ["dense"], 0.9), (1, "b", ["dense"], 0.8), (1, "c", ["dense"], 0.1), (1, " B ", ["Sparse", "DENSE"], 1e9), (1, "c", ["dense", "sparse"], 5.0), (1, "a", ["graph"], None), (1, "b", ["graph"], -3.0)]
    assert [tuple(r) for r in rk.first_items(rk.fused_ranking(frame(spark, rows))).collect()] == [(1, "b")]
    tie = [(2, "x", ["dense"], 1.0), (2, "w", ["dense"], 1.0)]
    assert [tuple(r) for r in rk.first_items(rk.fused_ranking(frame(spark, tie))).collect()] == [(2, "w")]
    w = rk.fused_ranking(frame(spark, rows), {"dense": 0.0, "dense+sparse": 0.0})
    assert rk.first_items(w).first().lineage_id == "b"


def test_nulls_and_empty(spark):
    rows = [(None, "a", ["d"], 1.0), (1, None, ["d"], 1.0), (2, "a", None, 1.0), (2, "b", [], 2.0), (3, "a", ["d"], None)]
    out = rk.fused_ranking(frame(spark, rows))
    assert {(r.query_id, r.lineage_id) for r in out.collect()} == {(2, "a"), (2, "b"), (3, "a")}
    assert [tuple(r) for r in rk.first_items(out).collect()] == [(2, "b")]
    assert rk.fused_ranking(frame(spark, rows).limit(0)).count() == 0


def test_quantiles(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.075, 0.3, 0.5, 0.6, 0.925, 0.9251, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-12 * max(1, abs(r.z)) for r in df.select("p", rk.probit(df["p"]).alias("z")).collect())


def test_hot_queries_have_the_same_result(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(q, f"d:{l}", [m], rng.choice([None, float(rng.randint(0, 9)), rng.random()])) for q, n in ((1, 40), (2, 5), (3, 60)) for m in ("dense", "sparse", "graph") for l in rng.sample(range(80), n)]
    cold = {(r.query_id, r.lineage_id): (r.fused, r.n_lists) for r in rk.fused_ranking(frame(spark, rows)).collect()}
    monkeypatch.setattr(rk, "LEAST_HOT", 30)
    hot = {(r.query_id, r.lineage_id): (r.fused, r.n_lists) for r in rk.fused_ranking(frame(spark, rows)).collect()}
    assert cold.keys() == hot.keys() and all(abs(a - b) < 1e-9 and n == m for (a, n), (b, m) in ((cold[k], hot[k]) for k in cold))


def test_one_shuffle_by_query(spark):
    df = spark.createDataFrame([(i, i % 9, f"d{i}", ["dense"], float(i), "x", 1) for i in range(50)], S)
    plan = rk.first_items(rk.fused_ranking(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_hot_query_is_split(spark):
    rows = [(1, f"d{i}", ["dense"], float(i % 7)) for i in range(3000)]
    out = {r.lineage_id: r.fused for r in rk.fused_ranking(frame(spark, rows)).collect()}
    assert len(out) == 3000 and len({round(v, 9) for v in out.values()}) == 7
