import datetime as dt

from corpusloom.operators.hierarchy import descendant_counts, descendants, hierarchy, parent_links
from corpusloom.operators.orphans import orphan_references, orphan_report

E = "src string, dst string, kind string, node_id string, n int"


def edges(spark, pairs, kind="PART_OF"):
    return spark.createDataFrame([(a, b, kind, "clash", 1) for a, b in pairs], E)


def tree(spark, pairs, **kw):
    return {r.node_id: r for r in hierarchy(parent_links(edges(spark, pairs)), **kw).collect()}


def test_paths_depths_and_cycles(spark):
    t = tree(spark, [("a", "r"), (" B ", "A"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("c", "b")])
    assert (t["c"].root_id, t["c"].node_depth, t["c"].path) == ("r", 3, ["r", "a", "b", "c"])
    assert t["a"].node_depth == 1 and t["b"].root_id == "r"
    for k in "xyzs":
        assert (t[k].root_id, t[k].node_depth, t[k].path) == ("cycle", -1, None)
    assert len(t) == 7


def test_long_chain_and_cycle_below_it(spark):
    t = tree(spark, [(f"n{i}", f"n{i + 1}") for i in range(100)] + [("p", "q"), ("q", "p")])
    assert t["n0"].node_depth == 100 and t["n0"].root_id == "n100" and len(t["n0"].path) == 101
    assert t["p"].root_id == "cycle"


def test_hot_parent(spark):
    t = tree(spark, [(f"c{i}", "hub") for i in range(3000)] + [("hub", "top"), ("top", "root")], paths=False)
    assert {(r.root_id, r.node_depth) for k, r in t.items() if k.startswith("c")} == {("root", 3)}


def test_nulls_blanks_kinds_and_empty_tables(spark):
    e = spark.createDataFrame([(None, "a", "PART_OF", None, None), ("a", None, "part of", None, None), ("b", " ", "PART_OF", None, None), ("c", "d", " Part-Of ", None, None), ("e", "f", None, None, None), ("g", "h", "AMENDS", None, None)], E)
    assert [(r.node_id, r.root_id) for r in hierarchy(parent_links(e)).collect()] == [("c", "d")]
    assert hierarchy(parent_links(e.limit(0))).count() == 0
    # several parents: the smallest key
    assert tree(spark, [("a", "y"), ("a", "x")])["a"].root_id == "x"


def test_descendants(spark):
    t = hierarchy(parent_links(edges(spark, [("a", "r"), ("b", "a"), ("x", "x")])))
    assert {tuple(r) for r in descendants(t).collect()} == {("r", "a", 1), ("r", "b", 2), ("a", "b", 1)}
    assert {tuple(r) for r in descendant_counts(t).collect()} == {("r", 2, 2), ("a", 1, 1)}


T = lambda d: dt.datetime(2023, 1, d)
ES = "edge_id long, dst string, doc_id string, ref_number string, recorded_at timestamp, ref_key string"
NS = "lineage_id string, created_at timestamp, deleted_at timestamp, kind string"


def orphans(spark, es, ns, rs=()):
    e = spark.createDataFrame([(*x, "clash") for x in es], ES)
    return orphan_references(e, *(spark.createDataFrame([(*x, "k") for x in t], NS) for t in (ns, rs)))


def test_reasons(spark):
    nodes = [("A:article:1", T(1), None), ("gone", T(1), T(2)), ("gone", T(3), T(4)), (" Late ", T(20), None), ("late", T(1), T(5)), (None, T(1), None), ("open", None, None)]
    es = [(1, "a:article:1", "a", None, T(9)), (2, "nowhere", "a", None, T(9)), (3, "GONE", "a", None, T(1)), (4, "late", "a", None, T(9)), (5, "late", "a", None, T(3)),
          (6, None, "A", " 1 ", T(9)), (7, None, "a", "2", T(9)), (8, None, "a", None, T(9)), (9, "late", "a", None, None), (10, "ext:x", "a", None, T(9)), (11, "late", "a", None, T(20)),
          (2, "NOWHERE", "a", None, T(9)), (12, "open", "a", None, T(1)), (13, "late", "a", None, T(5))]
    out = orphans(spark, es, nodes, [("ext:y", T(1), None)])
    assert {(r.edge_id, r.reason) for r in out.collect()} == {(2, "missing"), (3, "deleted"), (4, "late"), (7, "missing"), (10, "missing"), (13, "late")}
    assert out.count() == 6
    rep = {(r.ref_table, r.period, r.reason): r.n_edges for r in orphan_report(out).collect()}
    assert rep[("reference_nodes", "2023-01", "missing")] == 1 and rep[("graph_nodes", "2023-01", "missing")] == 2


def test_hot_missing_key_and_empty_tables(spark):
    out = orphans(spark, [(i, "hot", "a", None, T(2)) for i in range(5000)], [("a", T(1), None)])
    assert out.count() == 5000
    assert orphans(spark, [], [("a", T(1), None)]).count() == 0
    assert {r.reason for r in orphans(spark, [(1, "a", "d", None, T(1))], [], []).collect()} == {"missing"}
