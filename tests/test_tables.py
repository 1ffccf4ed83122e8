import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import benchmark as bm
from corpusloom.operators import context as cx
from corpusloom.operators import graphs as g
from corpusloom.operators import models
from corpusloom.sources import readers, sinks
from corpusloom.streaming import incremental


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("x", "one", 1), ("y", None, 2)], "id string, name string, n int")
    sinks.upsert(path, a, ["id"])
    b = spark.createDataFrame([("x", None, 9), ("z", "three", 3)], "id string, name string, n int")
    for _ in range(2):
        sinks.upsert(path, b, ["id"])
    import os

    os.rename(path, path + ".prev")  # as a crash between the two renames leaves it
    sinks.upsert(path, b, ["id"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("x", "one", 9), ("y", None, 2), ("z", "three", 3)}
    with pytest.raises(ValueError):
        sinks.upsert(path, spark.createDataFrame([(None, "a", 1)], "id string, name string, n int"), ["id"])
    with pytest.raises(ValueError):
        sinks.reject_malformed(spark.createDataFrame([("a", "NO_SUCH")], "src string, kind string"), ["src"], sinks.KINDS)
    assert sinks.duplicate_keys(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), ["k"]).collect() == [("a", 2)]


def test_stream(spark, tmp_path):
    src, dst = tmp_path / "in", str(tmp_path / "out")
    schema = "id long, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(str(src))
    incremental.upsert_stream(spark, str(src), dst, ["id"], str(tmp_path / "cp"), schema).awaitTermination(120)
    spark.createDataFrame([(2, "c"), (3, "d")], schema).coalesce(1).write.mode("append").parquet(str(src))
    incremental.upsert_stream(spark, str(src), dst, ["id"], str(tmp_path / "cp"), schema).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(dst).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    ev = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value, 1 user_id union all select timestamp'2024-01-01 00:50:00', 'a', 2.0D, 1")
    assert [(r.n, r.total) for r in incremental.windowed_counts(ev).collect()] == [(2, 3.0)]
    assert incremental.sessions(ev).count() == 2 and incremental.deduplicated(ev, "user_id", "ts").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "raw/en/eu").mkdir(parents=True)
    (tmp_path / "raw/de/eu").mkdir(parents=True)
    for lang in ("en", "de"):
        (tmp_path / f"raw/{lang}/eu/dora_act.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Type /Page >>\n2 0 obj << /Type /Pages >>")
    (tmp_path / "raw/en/eu/bad.pdf").write_bytes(b"nothing")
    f = {r.doc_id: r for r in readers.pdf_files(spark, str(tmp_path / "raw")).collect()}
    assert f["dora_act"].language == "en" and f["dora_act"].page_count == 1 and f["dora_act"].errors == ["too small"] and f["bad"].errors == ["not a pdf", "too small"]
    tags = spark.createDataFrame([("dora*", ["ict"], 1), ("d*", ["other"], 2)], "prefix string, tags array<string>, prio int")
    m = {r.doc_id: r for r in readers.manifest(readers.pdf_files(spark, str(tmp_path / "raw")), tags).collect()}
    assert m["dora_act"].tags == ["ict"] and m["dora_act"].risk == "high" and m["bad"].tags == []
    assert readers.parse_pdfs(readers.pdf_files(spark, str(tmp_path / "raw")), "no_such").filter("error is null").count() == 0
    (tmp_path / "a.md").write_text("# T\n\nx")
    assert [(r.doc_id, r.text) for r in readers.markdown_documents(spark, str(tmp_path)).collect()] == [("a", "# T\n\nx")]
    (tmp_path / "q.jsonl").write_text(json.dumps({"query_id": "1", "v": 2}) + "\n\n" + json.dumps({"query_id": "2", "v": 3}) + "\n")
    allow = spark.createDataFrame([("2",)], "query_id string")
    assert readers.json_lines(spark, str(tmp_path / "q.jsonl"), "query_id string, v int", allow).collect() == [("2", 3)]
    c = readers.completeness(spark.createDataFrame([("a", " ", None, [])], "a string, b string, c string, d array<string>"), ["a", "b", "c", "d"]).first()
    assert (c.n_missing, c.n_empty, c.ok) == (1, 2, False)
    x = readers.cross_check(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string"), "k")
    assert {tuple(r) for r in x.collect()} == {("a", "missing"), ("c", "untracked")}


def test_writers(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "article")], "node_id string, kind string")
    edges = spark.createDataFrame([("a", "b", "AMENDS", "d", True), ("a", "c", "AMENDS", "d", False)], "src string, dst string, kind string, doc_id string, unresolved boolean")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/edges")).filter("kind = 'AMENDS'").count() == 2
    assert readers.csv_table(spark, str(tmp_path / "g/graph_summary"), "doc_id string, a int, amends int").first().amends == 2
    s = {(r.doc_id, r.kind): (r.n_edges, r.n_unresolved) for r in g.edge_summary(edges).collect()}
    assert s["ALL", "ALL"] == (2, 1) and s["d", "AMENDS"] == (2, 1)
    assert "| a | article |" in sinks.markdown_table(nodes)
    f = sinks.fingerprint(edges).first()
    assert f == sinks.fingerprint(edges.repartition(5)).first() and f.sha256 != sinks.fingerprint(edges.limit(1)).first().sha256


def test_model_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    p = spark.createDataFrame([("1", "hello"), ("2", "hello"), ("3", "boom")], "id string, prompt string")

    def client(x):
        if x == "boom":
            raise RuntimeError("no")
        return x.upper()

    for _ in range(2):
        got = {r.id: r for r in models.ask_cached(p, path, "m", client, waits=()).collect()}
        assert got["1"].answer == got["2"].answer == "HELLO" and got["3"].answer is None and "no" in got["3"].error
    assert spark.read.parquet(path).count() == 1
    pr = models.structure_prompts(spark.createDataFrame([(1, "x" * 9000), (2, None)], "doc_id int, text string")).collect()
    assert len(pr) == 1 and "[...]" in pr[0].prompt
    rv = models.reviewed(spark.createDataFrame([("1", "old", "2020")], "id string, title string, date string"), spark.createDataFrame([("1", '{"title": "new", "date": " "}')], "id string, answer string"), ["title", "date"]).first()
    assert (rv.title, rv.date) == ("new", "2020")
    first = spark.createDataFrame([("a", True, 0.9), ("b", True, 0.2), ("c", None, None)], "id string, correct boolean, confidence double")
    second = spark.createDataFrame([("b", False, 0.8)], "id string, correct boolean, confidence double")
    assert {r.id: (r.correct, r.decision) for r in models.escalate(first, second).collect()} == {"a": (True, "first"), "b": (False, "second"), "c": (None, "none")}
    drafts = spark.createDataFrame([("s", "x", "t" * 50), ("s", "y", "t" * 60), ("r", "x", "short")], "scenario_id string, drafter string, text string")
    votes = spark.createDataFrame([("s", "x", 3), ("s", "y", 5), ("r", "x", 5)], "scenario_id string, drafter string, score int")
    assert {r.scenario_id: (r.drafter, r.decision) for r in models.voted_scenarios(drafts, votes).collect()} == {"s": ("y", "both"), "r": (None, "escalate")}


def test_rerank_and_context(spark):
    pool = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 2)], "query_id int, lineage_id string, rank long")
    order = spark.createDataFrame([(1, [2, 1]), (2, [1, 1])], "query_id int, order array<int>")
    got = {(r.query_id, r.lineage_id): (r.rank, r.status) for r in cx.rerank(pool, order).collect()}
    assert got[1, "b"] == (1, "reranked") and got[2, "c"] == (1, "fallback")
    x = spark.createDataFrame([("so [2, 1, 2] it is", ["d:article:1"]), ("none", None)], "a string, p array<string>")
    assert [r[0] for r in x.select(cx.parse_order(F.col("a"))).collect()] == [[2, 1], None]
    y = spark.createDataFrame([("see d:article:1 and e:article:2", ["d:article:1"])], "a string, p array<string>")
    assert y.select(cx.invented_citations(F.col("a"), F.col("p")).alias("x")).first().x == ["e:article:2"]
    q = spark.createDataFrame([(1, "a1", "capacity rules")], "query_id int, lineage_id string, question string")
    e = spark.createDataFrame([("a1", "a2", "CROSS_REFERENCES", 1), ("a4", "a1", "AMENDS", 2)], "src string, dst string, kind string, edge_ord long")
    N = "node_id string, kind string, title string, term string, art_number string"
    n = spark.createDataFrame([("a1", "article", None, None, "1"), ("a2", "article", "Capacity", None, "2")], N)
    c = cx.context_lines(q, e, n).first()
    assert c.context.startswith("CITES Article 2 Capacity\nAMENDED_BY ") and c.n_lines == 2
    assert cx.context_lines(q, e, n, directions=("in",)).first().context.startswith("AMENDED_BY ")
    assert cx.context_lines(q, e, n.filter("node_id = 'a2'")).count() == 0  # a candidate that is no node
    with pytest.raises(ValueError):
        cx.context_lines(q, e, n, directions=("up",))
    rows = spark.createDataFrame([(1, 1, "a1", "d", "text", "AMENDS@1hop")], "query_id int, rank int, lineage_id string, doc_id string, text string, edge string")
    out = {r.query_id: r for r in cx.refuse(spark.createDataFrame([(1,), (2,)], "query_id int"), cx.answer_context(rows)).collect()}
    assert out[2].refused and out[2].context == "[INSUFFICIENT CONTEXT]" and "a1 via AMENDS@1hop" in out[1].context


def test_context_paths_snippets_and_budgets(spark):
    q = spark.createDataFrame([(1, "a1", "storage rules"), (2, "hub", None)], "query_id int, lineage_id string, question string")
    E = "src string, dst string, kind string, snippet string, edge_ord long"
    rows = [("a1", "a2", "CROSS_REFERENCES", "short", 1), ("a1", "a2", "CROSS_REFERENCES", "  the  longer one  ", 2), ("a2", "a3", "CROSS_REFERENCES", None, 3), ("a2", "a1", "CROSS_REFERENCES", "x", 4), ("a4", "a1", "AMENDS", "y" * 200, 5),
            ("a1", "a5", "SUPERSEDES", None, 6), ("a5", "a6", "AMENDS", "of storage", 7), ("t", "a1", "DEFINED_IN", None, 8), ("a1", "a1", "AMENDS", None, 9)] + [("hub", f"n{i:02d}", "CROSS_REFERENCES", None, 100 + i) for i in range(30)] + [(f"m{i}", "hub", "AMENDS", None, 200 + i) for i in range(5)]
    e = spark.createDataFrame(rows, E)
    names = spark.createDataFrame([(k, "chapter", k.upper(), None, None) for k in {x for r in rows for x in r[:2]}], "node_id string, kind string, title string, term string, art_number string")
    got = {r.query_id: r for r in cx.context_lines(q, e, names).collect()}
    # by shared words, then by key; a2 is named both ways; a path ends in what no line names
    assert got[1].context.split("\n") == ['CITES A2 — "the longer one"', "SUPERSEDES A5", 'CITED_BY A2 — "x"', 'AMENDED_BY A4 — "' + "y" * 119 + '…"', "DEFINES T", 'VIA A5 → A6 — "of storage"', "VIA A2 → A3"]
    assert got[2].context.split("\n") == [f"CITES N{i:02d}" for i in range(8)] + ["AMENDED_BY M0"]
    plain = {r.query_id: r.context for r in cx.context_lines(q, e, names, snippets=False, paths=False, definitions=False).collect()}
    assert plain[1].split("\n") == ["CITES A2", "SUPERSEDES A5", "CITED_BY A2", "AMENDED_BY A4"]
    short = {r.query_id: r.context for r in cx.context_lines(q, e, names, chars=40).collect()}
    assert short[1].split("\n") == ['CITES A2 — "the longer one"', "DEFINES T"]  # a line that does not fit is left out, a shorter one may follow
    assert cx.context_lines(q.limit(0), e, names).count() == 0 == cx.context_lines(q, e.limit(0), names).count()


def test_paths_leave_a_middle_node_pruned(spark):
    # each middle node hands on three ends, among them the best whatever other ways lead to them
    q = spark.createDataFrame([(1, "a", "x3 storage")], "query_id int, lineage_id string, question string")
    rows = [("a", f"m{i}", "AMENDS", None, i) for i in range(3)] + [(f"m{i}", f"e{j:02d}", "AMENDS", "storage" if j == 7 - i else None, 10 + 10 * i + j) for i in range(3) for j in range(9)]
    e = spark.createDataFrame(rows, "src string, dst string, kind string, snippet string, edge_ord long")
    names = spark.createDataFrame([(k, "chapter", k.upper(), None, None) for k in {x for r in rows for x in r[:2]}], "node_id string, kind string, title string, term string, art_number string")
    assert [x for x in cx.context_lines(q, e, names).first().context.split("\n") if x.startswith("VIA")] == [f'VIA M{i} → E0{7 - i} — "storage"' for i in range(3)]


def test_benchmark(spark):
    H = "array<struct<src:string,kind:string,dst:string>>"
    cands = spark.createDataFrame([("f1", "1", "q1", "t1", []), ("f1", "2", "q2", "t2", []), ("f2", "1", "q3", "t1", []), ("f2", "2", "q4", "t3", [("a", "K", "t3")])], f"family string, order_key string, question string, target string, path {H}")
    items = bm.allocate(cands, {"f1": 1, "f2": 1})
    assert [(r.family, r.target) for r in items.collect()] == [("f1", "t1"), ("f2", "t3")]
    with pytest.raises(ValueError):
        bm.allocate(cands, {"f1": 3})
    assert [r.target for r in bm.allocate(cands, {"f1": 1}, ["t1"]).collect()] == ["t2"]
    edges = spark.createDataFrame([("x", "K", "y")], "src string, kind string, dst string")
    known = spark.createDataFrame([("t1",), ("t3",)], "lineage_id string")
    assert {tuple(r) for r in bm.item_problems(items, edges, known).collect()} == {("q2", "missing_edge")}
    assert {r["check"]: r.n_shared for r in bm.leakage(items, items).collect()} == {"question": 2, "target": 2, "fact": 1}
    c = spark.createDataFrame([("d:article:5a",), ("d:preamble",), ("e:table:1",)], "lineage_id string")
    w = spark.createDataFrame([("d:article:5a",), ("d:article:5",), ("d:article:9",), ("e:article:1",), ("f:article:1",)], "want string")
    assert {r.want: (r.lineage_id, r.step) for r in bm.priority_match(w, c).collect()} == {"d:article:5a": ("d:article:5a", 1), "d:article:5": ("d:article:5a", 2), "d:article:9": ("d:article:5a", 3), "e:article:1": ("e:table:1", 5), "f:article:1": (None, None)}
    other = items.withColumn("target", F.lit("t9"))
    assert {r.change for r in bm.rebuild_diff(items, other).collect()} == {"retargeted"} and bm.rebuild_diff(items, items).count() == 0
    flags = bm.legacy_flags(spark.createDataFrame([("1", "single_document", "What about it?"), ("2", "one_hop", "Which act does Article None amend?")], "item_id string, family string, question string"))
    assert {tuple(r) for r in flags.collect()} == {("1", "no_article"), ("2", "null_name")}
    s = bm.scenarios(spark.createDataFrame([(1, "x" * 61 + " shall act. Short must. " + "y" * 70 + " must go."), (2, None)], "doc_id int, text string"), 1)
    assert s.count() == 2 and s.filter("compliant").count() == 1


def test_registry():
    import __spark_entry__ as entry

    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 90
    for n in ("p4_found", "p5_found"):
        assert n in qs and n in sql


def test_core_stands_without_the_optional_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpusloom.llm'] = None\nimport __spark_entry__ as e\nassert 'p4_found' in e.queries() and 'p6_ids' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
