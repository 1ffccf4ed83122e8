import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import expansion as ex
from corpusloom.operators import retrieval as rt


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id int, method string, rank long, lineage_id string, score double")


def test_rrf(spark):
    out = {r.lineage_id: r for r in rt.rrf(lists(spark, [(1, "dense", 1, "a", 0.9), (1, "dense", 2, "b", 0.8), (1, "sparse", 1, "b", 1.0), (1, "sparse", 2, "c", 0.5)])).collect()}
    assert max(out, key=lambda k: out[k].score) == "b" and out["b"].methods == ["dense", "sparse"]
    assert [(x.method, x.rank) for x in out["b"].ranks] == [("dense", 2), ("sparse", 1)]
    assert out["a"].score == pytest.approx(1 / 61)


def test_bm25_against_brute_force(spark):
    rng = random.Random(2)
    words = ["market", "operator", "capacity", "grid", "tariff", "notice", "regulator"]
    docs = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [("null", None)]
    queries = [(1, "market operator regulator market"), (2, "absent"), (3, "")]
    got = {(r.query_id, r.rank): (r.lineage_id, r.score) for r in rt.InvertedIndex(spark.createDataFrame(docs, "lineage_id string, text string")).search(spark.createDataFrame(queries, "query_id int, text string"), 5).collect()}
    toks = {k: (t or "").split() for k, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    s = {k: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in queries[0][1].split()) for k, t in toks.items()}
    best = sorted(((round(v, 9), k) for k, v in s.items() if v > 0), key=lambda x: (-x[0], x[1]))[:5]
    assert [got[1, i + 1][0] for i in range(5)] == [k for _, k in best]
    assert got[1, 1][1] == pytest.approx(best[0][0])
    assert not any(q in (2, 3) for q, _ in got)


def test_search_forms_no_pairs_outside_the_workers(spark):
    rng = random.Random(5)
    docs = [(f"d{i:03}", " ".join(rng.choice(["market", "grid", "tariff", "EU", "2016/679"]) for _ in range(8))) for i in range(200)] + [(f"e{i:03}", "other words") for i in range(600)]
    queries = [(i, ["market grid", "grid market", "EU tariff", "2016/679"][i % 4]) for i in range(40)]
    index = rt.InvertedIndex(spark.createDataFrame(docs, "lineage_id string, text string").repartition(3))
    assert {r.lineage_id: r.dl for r in index.postings.collect()} == {k: len(t.split()) for k, t in docs}  # a row for each document
    q = spark.createDataFrame(queries, "query_id int, text string")
    got, by = {}, {}
    for block in (4096, 1):
        got[block] = sorted((r.query_id, r.rank, r.lineage_id, r.score) for r in index.search(q, 3, block).collect())
    assert got[4096] == got[1] and len(got[1]) == 120
    for i, rank, key, score in got[1]:
        by.setdefault(i % 4 or 1, set()).add((rank, key, score))
    assert [len(by[k]) for k in (1, 2, 3)] == [3, 3, 3]  # the same terms give the same list


def test_terms_of_workers_are_those_of_the_plan(spark):
    from corpusloom.functions import text as T

    texts = ["The EU-wide TSO shall apply 2016/679/EU and 5 A b X2 notices of Member States, (EU) 2019/943.", "Directive é market\u0001x\u0002 no 7", "", None, "A1 AA a1 1a 12/34 2020/12"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.raw_tokens(F.col("t")).alias("raw"), T.tokenize(F.col("t")).alias("terms")).collect():
        assert [t for w in r.raw if (t := T.search_term(w)) is not None] == r.terms


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    m[7] = m[3]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(99, None)], "lineage_id int, embedding array<float>")
    q = v.filter("lineage_id % 20 = 0 or lineage_id = 99").selectExpr("lineage_id as query_id", "embedding")
    got = {}
    for r in rt.dense_search(q, v, 4, block=2).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.lineage_id
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in (0, 20, 40):
        s = np.round(u @ u[i], 9)
        assert [got[i][k] for k in (1, 2, 3, 4)] == sorted(range(60), key=lambda j: (-s[j], j))[:4]
    assert 99 not in got


def test_embedder(spark):
    x = spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(rt.embed("t").alias("e")).collect()
    assert len(x[0].e) == 64 and abs(sum(a * a for a in x[0].e) - 1) < 1e-5 and x[1].e is None and x[2].e is None


E = "src string, dst string, kind string, edge_ord long"


def graph(spark, rows, kind="CROSS_REFERENCES"):
    return spark.createDataFrame([(a, b, kind, i) for i, (a, b) in enumerate(rows)], E)


def seeds(spark, *ids):
    return spark.createDataFrame([(1, i) for i in ids], "query_id int, node_id string")


def real(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def test_two_hops(spark):
    e = graph(spark, [("A", "B"), ("B", "C"), ("C", "D")])
    p = {r.node_id: r for r in ex.two_hop_paths(seeds(spark, "A"), e, real(spark, "ABCD")).collect()}
    assert {k: r.hop for k, r in p.items()} == {"B": 1, "C": 2} and p["C"].path == ["A", "CROSS_REFERENCES", "B", "CROSS_REFERENCES", "C"]
    got = {(r.node_id, r.hop) for r in ex.expand(seeds(spark, "A"), e).collect()}
    assert got == {("B", 1), ("C", 2)}
    assert [r.node_id for r in ex.two_hop_only(seeds(spark, "A"), e).collect()] == ["C"]
    mixed = spark.createDataFrame([("A", "B", "AMENDS", 0), ("B", "C", "CROSS_REFERENCES", 1)], E)
    assert [r.relations for r in ex.two_hop_paths(seeds(spark, "A"), mixed, real(spark, "C")).collect()] == [["AMENDS", "CROSS_REFERENCES"]]
    with pytest.raises(ValueError):
        ex.expand(seeds(spark, "A"), e, 0)


def test_admission(spark):
    e = graph(spark, [("S", "M"), ("S", "T"), ("S", "W"), ("M", "U"), ("T", "V")])
    p = ex.two_hop_paths(seeds(spark, "S"), e, real(spark, "SMTWUV"))
    order = lambda d: [r.node_id for r in d.orderBy("ord").collect()]
    assert order(p) == list("MTWUV") and order(ex.admit(p, "first", 3)) == list("MTW")
    assert set(order(ex.admit(p, "2hop_first", 3))) > {"U", "V"}
    assert order(ex.admit(p, "split_2_1", 3)) == list("MTU") and order(ex.admit(p, "split_1_2", 3)) == list("MUV")
    for bad in ("nope", "split_bad"):
        with pytest.raises(ValueError):
            ex.admit(p, bad, 3)


def test_undirected_and_distances(spark):
    e = spark.createDataFrame([("t", "a1", "DEFINED_IN", 0), ("a1", "a2", "CROSS_REFERENCES", 1), ("a2", "e", "APPLIES_TO", 2)], E)
    s = spark.createDataFrame([(1, "t", 0.9), (1, "a1", 0.5)], "query_id int, node_id string, score double")
    got = {r.node_id: r for r in ex.undirected_search(s, e, real(spark, ["a1", "a2"]), ["DEFINED_IN", "CROSS_REFERENCES"]).collect()}
    assert got["a2"].hop == 1 and got["a2"].seeds == ["a1", "t"] and got["a2"].kinds == ["CROSS_REFERENCES", "DEFINED_IN"] and got["a2"].score == 0.9
    assert got["a1"].hop == 1
    assert not ex.undirected_search(s, e, real(spark, ["a2"]), ["APPLIES_TO"], 1).collect()
    d = {r.node_id: r.hop for r in ex.distances(seeds(spark, "t"), e, 3).collect()}
    assert d == {"t": 0, "a1": 1, "a2": 2, "e": 3}


def test_expansion_starts_from_ten_seeds(spark, monkeypatch):
    from corpusloom.plans import graph_queries as gq

    edges = graph(spark, [(f"s{i:02}", f"t{i:02}") for i in range(12)])
    nodes = real(spark, [f"{x}{i:02}" for x in "st" for i in range(12)])
    ranked = spark.createDataFrame([(1, "sparse", i + 1, f"s{i:02}", 0.9 - i / 100) for i in range(12)] + [(1, "rerank", 1, "t09", 0.9), (1, "rerank", 2, "t10", 0.8)], "query_id int, method string, rank long, lineage_id string, score double")
    chunks = nodes.selectExpr("node_id as lineage_id")
    for name, df in (("edges", edges), ("nodes", nodes), ("lists", ranked), ("clean_chunks", chunks)):
        monkeypatch.setattr(gq.c, name, lambda s, d, df=df: df)
    want = {f"t{i:02}" for i in range(10)}
    for q in (gq.graph_expand_2hop, gq.two_hop_provenance, gq.one_hop_candidates, gq.admission_split_12_9):
        assert {r.node_id for r in q(spark, "").filter("hop = 1" if q is gq.graph_expand_2hop else "true").collect()} == want
    assert {r.budget: r.targets_admitted for r in gq.budget_sweep(spark, "").collect()} == {20: 1, 30: 1, 40: 1}


@pytest.mark.parametrize("cap", [3, 60])
def test_undirected_search_against_brute_force(spark, cap):
    rng = random.Random(cap)
    kinds = ["CROSS_REFERENCES", "AMENDS", "DEFINED_IN", "APPLIES_TO"]
    rows = [(f"n{rng.randint(0, 80):02}", f"n{rng.randint(0, 80):02}", rng.choice(kinds), i) for i in range(110)] + [(f"n{i:02}", f"hub{i % 2}", "APPLIES_TO", 200 + i) for i in range(80)]
    s = [(q, f"n{n:02}", rng.choice([0.2, 0.5, 0.9])) for q in range(8) for n in rng.sample(range(81), rng.randint(1, 5))]
    real_ = [f"n{i:02}" for i in range(81) if i % 7]
    both = [(i, *x) for a, b, k, i in rows for x in {(a, b, k), (b, a, k)}]
    want = {}
    for q, seed, score in s:
        for i, a, b, k in both:
            if a == seed:
                for hop, t, ks in [(1, b, {k})] + [(2, y, {k, k2}) for j, x, y, k2 in both if x == b and j != i]:
                    if t != seed and t in real_:
                        w = want.setdefault((q, t), [9, 0.0, set(), set()])
                        want[q, t] = [min(w[0], hop), max(w[1], score), w[2] | {seed}, w[3] | ks]
    for q, seed, score in s:
        if seed in real_:
            want.setdefault((q, seed), [0, score, {seed}, set()])
    got = ex.undirected_search(spark.createDataFrame(s, "query_id int, node_id string, score double"), spark.createDataFrame(rows, E), real(spark, real_), kinds, cap=cap).collect()
    for q in range(8):
        best = sorted((-w[1], w[0], t, sorted(w[2]), sorted(w[3])) for (p, t), w in want.items() if p == q)[:cap]
        assert [(-r.score, r.hop, r.node_id, r.seeds, r.kinds) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == best


def test_undirected_query_walks_four_kinds_from_fifteen_seeds(spark, monkeypatch):
    from corpusloom.plans import graph_queries as gq

    edges = spark.createDataFrame([("s02", "e", "APPLIES_TO", 0), ("t", "e", "APPLIES_TO", 1)] + [(f"s{i:02}", f"t{i:02}", "AMENDS", 2 + i) for i in range(17)], E)
    nodes = real(spark, ["t", *[f"t{i:02}" for i in range(17)]]).selectExpr("node_id", "'article' as kind")
    ranked = spark.createDataFrame([(1, "dense", i + 1, f"s{i:02}", 0.9 - i / 100) for i in range(17)], "query_id int, method string, rank long, lineage_id string, score double")
    for name, df in (("edges", edges), ("nodes", nodes), ("lists", ranked)):
        monkeypatch.setattr(gq.c, name, lambda s, d, df=df: df)
    assert {r.node_id: r.hop for r in gq.undirected_traversal(spark, "").collect()} == {"t": 2, **{f"t{i:02}": 1 for i in range(15)}}


def test_distances_over_all_kinds_from_all_seeds(spark, monkeypatch):
    from corpusloom.plans import graph_queries as gq

    edges = spark.createDataFrame([("s1", "doc", "PART_OF", 0), ("t1", "doc", "PART_OF", 1), ("s2", "e", "APPLIES_TO", 2), ("t2", "e", "APPLIES_TO", 3), ("t2", "far", "IMPLEMENTS", 4), ("far", "beyond", "AMENDS", 5)], E)
    nodes = real(spark, ["s1", "s2", "doc", "e", "t1", "t2", "far", "beyond"])
    ranked = spark.createDataFrame([(1, "sparse", 1, "s1", 0.9), (1, "sparse", 2, "s2", 0.5), *[(1, "rerank", i, x, 0.5) for i, x in enumerate(["t1", "t2", "far", "no_node"])]], "query_id int, method string, rank long, lineage_id string, score double")
    for name, df in (("edges", edges), ("nodes", nodes), ("lists", ranked), ("gold", ranked.filter("method = 'rerank'").select("query_id", "lineage_id", "rank"))):
        monkeypatch.setattr(gq.c, name, lambda s, d, df=df: df)
    assert {r.node_id: r.hop for r in gq.bfs_distance(spark, "").collect()} == {"s1": 0, "s2": 0, "doc": 1, "e": 1, "t1": 2, "t2": 2, "far": 3}
    assert {r.mechanism: r.n for r in gq.admission_mechanism(spark, "").collect()} == {"SEED_PRESENT": 2, "SEED_MISS": 1, "OUT_OF_CORPUS": 1}


def test_target_distances_against_distances(spark):
    rng = random.Random(4)
    e = spark.createDataFrame([(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}", rng.choice(["PART_OF", "AMENDS"]), i) for i in range(70)] + [(f"n{i}", "hub", "APPLIES_TO", 100 + i) for i in range(0, 60, 4)], E)
    s = spark.createDataFrame([(q, f"n{rng.randint(0, 60)}") for q in (1, 2, 3) for _ in range(3)], "query_id int, node_id string")
    t = spark.createDataFrame([(q, f"n{i}") for q in (1, 2, 3) for i in range(0, 61, 2)], "query_id int, node_id string")
    want = {tuple(r) for r in ex.distances(s, e, 2).join(t, ["query_id", "node_id"], "left_semi").collect()}
    assert {tuple(r) for r in ex.target_distances(t, s, e).collect()} == want and len(want) > 20


def test_eligibility_and_strong_seeds(spark):
    e = graph(spark, [("A", "B"), ("B", "C")])
    t = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C"), (1, "Z")], "query_id int, node_id string")
    got = {r.node_id: r.status for r in ex.eligibility(t, seeds(spark, "A"), seeds(spark, "A"), e).collect()}
    assert got == {"A": "in_pool", "B": "one_hop", "C": "two_hop_only", "Z": "unreachable"}
    s = spark.createDataFrame([(1, "a", 0.2), (1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.1)], "query_id int, node_id string, score double")
    assert [(r.node_id, r.score) for r in ex.strong_seeds(s, 0.3).orderBy("node_id").collect()] == [("a", 0.9), ("b", 0.5)]


def test_nearest_interval_against_brute_force(spark):
    rng = random.Random(3)
    iv = [("k", i, 10 * i + 2, 10 * i + rng.randint(3, 9)) for i in range(30)]
    pts = [("k", f"p{i}", rng.randint(-5, 320)) for i in range(200)] + [("other", "x", 1), ("k", "null", None)]
    got = {r.point_id: r for r in ex.nearest_interval(spark.createDataFrame(pts, "key string, point_id string, at int"), spark.createDataFrame(iv, "key string, interval_id int, a int, b int"), "key").collect()}
    assert "x" not in got and "null" not in got and len(got) == 200
    for k, p, at in pts[:200]:
        d = min((0 if a <= at < b else min(abs(at - a), abs(at - b)), a, i) for _, i, a, b in iv)
        assert (got[p].distance, got[p].interval_id) == (d[0], d[2])


def test_modes(spark):
    from corpusloom.operators.modes import MODES, Retriever

    texts = {"a": "capacity market notice", "b": "tariff notice of the operator", "c": "unrelated words entirely", "d": "penalty calendar"}
    chunks = spark.createDataFrame([(f"x:article:{i}", "x", texts[k], 10 * i, 10 * i + 9) for i, k in enumerate("abcd")], "lineage_id string, doc_id string, text string, span_start int, span_end int")
    nodes = spark.createDataFrame([(f"x:article:{i}", "article", "x", str(i), f"T{i}", None) for i in range(4)], "node_id string, kind string, doc_id string, art_number string, title string, term string")
    edges = graph(spark, [("x:article:0", "x:article:2"), ("x:article:2", "x:article:3")])
    r = Retriever(chunks, nodes, edges)
    q = spark.createDataFrame([(1, "capacity market"), (2, "zzz"), (3, None)], "query_id int, text string")
    got = {m: [(x.lineage_id, x.graph_edge_type) for x in r.retrieve(q, m, 5).filter("query_id = 1").orderBy("rank").collect()] for m in ("sparse", "graph", "hybrid", "hybrid_graph", "hybrid_gr_expand")}
    assert got["sparse"] == [("x:article:0", None)]
    assert got["graph"] == [("x:article:0", "seed"), ("x:article:2", "CROSS_REFERENCES@1hop"), ("x:article:3", "CROSS_REFERENCES@2hop")]
    assert got["hybrid"][0][0] == "x:article:0" and ("x:article:3", "CROSS_REFERENCES@2hop") in got["hybrid_graph"]
    assert set(got) < set(MODES)
    assert len({x for x, _ in got["hybrid_gr_expand"]}) >= len(got["hybrid_graph"])
    und = [(x.lineage_id, x.graph_edge_type) for x in r.retrieve(q.filter("query_id = 1"), "neo4j_graph", 5).orderBy("rank").collect()]
    assert {"x:article:0", "x:article:2"} <= {x for x, _ in und} and all(e is None or "@" in e or e == "seed" for _, e in und)
    # reranking never changes which chunks a mode finds, and no chunk of the graph alone gets in
    pools = {m: {x.lineage_id for x in r.retrieve(q.filter("query_id = 1"), m, 5).collect()} for m in ("hybrid", "hybrid_rerank", "hybrid_graph_rerank", "hybrid_gr_1hop", "hybrid_gr_relations")}
    assert len({frozenset(x) for x in pools.values()}) == 1
    b0, g1 = (r.frozen(q.filter("query_id = 1"), s).collect() for s in ("b0", "g1"))
    assert {x.lineage_id for x in b0} <= {x.lineage_id for x in g1} and sorted(x.rank for x in g1) == list(range(1, len(g1) + 1)) and {x.source for x in b0} == {"hybrid"}
    with pytest.raises(ValueError):
        r.retrieve(q, "no_such")
    c = {x.query_id: x.refused for x in r.answer_contexts(q.filter("query_id != 3"), "sparse").collect()}
    assert c == {1: False, 2: True}


def test_queries_of_the_same_text_are_one_search(spark):
    from corpusloom.operators import context as cx
    from corpusloom.operators.modes import Retriever

    texts = ["capacity market notice", "tariff notice of the operator", "unrelated words entirely", "penalty calendar"]
    chunks = spark.createDataFrame([(f"x:article:{i}", "x", t, 10 * i, 10 * i + 9) for i, t in enumerate(texts)], "lineage_id string, doc_id string, text string, span_start int, span_end int")
    nodes = spark.createDataFrame([(f"x:article:{i}", "article", "x", str(i), f"T{i}", None) for i in range(4)], "node_id string, kind string, doc_id string, art_number string, title string, term string")
    shown = []

    def reranker(pool):
        shown.append({r.query_id for r in pool.collect()})
        return cx.lexical_order(pool)

    r = Retriever(chunks, nodes, graph(spark, [("x:article:0", "x:article:2"), ("x:article:2", "x:article:3")]), reranker=reranker)
    q = spark.createDataFrame([(i, ["capacity market", "penalty", None][i % 3]) for i in range(9)], "query_id int, text string")
    for run in (lambda: r.retrieve(q, "hybrid_gr_1hop", 5), lambda: r.frozen(q, "g2")):
        lists = {}
        for x in run().orderBy("query_id", "rank").collect():
            lists.setdefault(x.query_id, []).append(tuple(x)[1:])
        assert lists[0] == lists[3] == lists[6] != lists[1] == lists[4] == lists[7] and set(lists) == {0, 1, 3, 4, 6, 7}
    assert shown == [{0, 1}, {0, 1}]
    assert {x.query_id: x.refused for x in r.answer_contexts(q).collect()} == {i: i % 3 == 2 for i in range(9)}


def test_expanded_pool_takes_two_hops_and_chooses_in_order(spark):
    from corpusloom.operators.modes import Retriever

    keys = ["a", "b", "c", "n1", "n2", "n3", "n4", "n5", "z"]
    chunks = spark.createDataFrame([(k, "x", k, 0, 1) for k in keys], "lineage_id string, doc_id string, text string, span_start int, span_end int")
    nodes = real(spark, keys)
    # n3 is near a, which has no room for it, and near b; c has one chunk at one hop and one at two
    edges = graph(spark, [("a", "n1"), ("a", "n2"), ("a", "n3"), ("b", "n1"), ("b", "n3"), ("c", "n4"), ("n4", "n5"), ("c", "a"), ("c", "no_chunk")])
    pool = spark.createDataFrame([(1, i + 1, k, 0.5, ["sparse"], None) for i, k in enumerate("abc")] + [(2, 1, "c", 0.5, ["sparse"], None)], "query_id int, rank long, lineage_id string, score double, source_methods array<string>, graph_edge_type string")
    got = {}
    for r in Retriever(chunks, nodes, edges).expanded(pool).filter("source_methods[0] = 'graph:expand'").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.lineage_id, r.graph_edge_type))
    assert got[1] == [(4, "n1", "CROSS_REFERENCES@1hop"), (5, "n2", "CROSS_REFERENCES@1hop"), (6, "n3", "CROSS_REFERENCES@1hop"), (7, "n4", "CROSS_REFERENCES@1hop"), (8, "n5", "CROSS_REFERENCES@2hop")]
    assert got[2] == [(2, "a", "CROSS_REFERENCES@1hop"), (3, "n4", "CROSS_REFERENCES@1hop")]
