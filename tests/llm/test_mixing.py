import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import mixing as mx


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0.0, 3.0), st.integers(1, 5)), min_size=1, max_size=12), st.floats(0, 500))
def test_filling_reaches_the_target_or_the_cap(cells, target):
    t, w, c = (np.array([x[i] for x in cells], float) for i in range(3))
    out = mx.fill(t, np.minimum(w, c), c, target)
    assert (out <= c + 1e-9).all() and (out >= 0).all()
    got, most = float((t * out).sum()), float((t * c).sum())
    assert abs(got - min(target, most)) < 1e-6 * max(1, most)


def test_raking_meets_sources_and_keeps_languages():
    cells = pd.DataFrame([(s, l, "t", n, r) for s, r in (("a", 2), ("b", 3)) for l, n in (("en", 100), ("de", 50))], columns=["source", "lang", "topic", "tokens", "max_repeats"])
    w = mx.rake(cells, {"a": 200.0, "b": 100.0})
    got = (cells["tokens"] * w).groupby(cells["source"]).sum()
    assert abs(got["a"] - 200) < 1e-6 and abs(got["b"] - 100) < 1e-6
    lang = (cells["tokens"] * w).groupby(cells["lang"]).sum()
    assert abs(lang["en"] / lang["de"] - 2) < 1e-3
    w = mx.rake(cells, {"a": 1000.0, "b": 100.0})
    assert (w[cells["source"] == "a"] == 2).all()


D = "doc_id long, text string, source string, lang string, doc_kind string, n_tokens int, weight double"
T = "source_name string, target_weight double, max_repeats int"


def test_plan(spark):
    docs = [(i, "word " * 20, s, lang, "k", 0, 0.0) for i, (s, lang) in enumerate([(" News Wire ", "en")] * 30 + [("news-wire", "de")] * 10 + [("small", None)] * 3 + [("OTHER", "en")] * 5 + [(None, "en")])] + [(900, None, "small", "en", None, 0, 0.0), (901, "", "small", "fr", "k", 0, 0.0)]
    tg = [("news_wire", 5.0, 1), ("small", 5.0, 2), ("absent", 1.0, 4), (None, 9.0, 1), ("zero", 0.0, None), ("neg", -3.0, 2)]
    m = mx.Mix(spark.createDataFrame(docs, D), spark.createDataFrame(tg, T))
    rep = {r.source_name: r for r in m.report.collect()}
    assert {k for k, r in rep.items() if not r.reachable} == {"small", "absent"}
    assert rep["news_wire"].n_docs == 40 and rep["small"].n_docs == 5 and rep["absent"].tokens == 0
    recs = m.records.collect()
    assert all(r.repeats <= {"news_wire": 1, "small": 2}[r.source] for r in recs) and {r.source for r in recs} == {"news_wire", "small"}
    assert all(r.repeats == 2 for r in recs if r.source == "small")
    sh = {r.source_name: r.actual_share for r in m.shares.collect()}
    assert abs(sum(sh.values()) - 1) < 1e-9 and sh["zero"] == 0


def test_empty(spark):
    d, t = spark.createDataFrame([], D), spark.createDataFrame([("a", 1.0, 2)], T)
    m = mx.Mix(d, t)
    assert m.records.count() == 0 and m.report.first().reachable is True  # a mix of nothing lacks nothing
    m = mx.Mix(spark.createDataFrame([(1, "x", "a", "en", "k", 0, 0.0)], D), t.limit(0))
    assert m.report.count() == 0 and m.records.count() == 0 and m.shares.count() == 0


def test_draw_is_calibrated_and_the_same_in_any_partitioning(spark):
    import random

    rng = random.Random(4)
    docs = [(i, "word " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b"]), rng.choice(["en", "en-GB", "fil", "fi", "und", None, "EN us"]), rng.choice("kl"), 0, 0.0) for i in range(400)] + [(7, "word " * 9, "a", "en", "k", 0, 0.0)] * 3
    tg = spark.createDataFrame([("a", 1.0, 3), ("b", 1.0, 3)], T)
    m = mx.Mix(spark.createDataFrame(docs, D), tg)
    assert set(m.cells["lang"]) == {"en", "fil", "fi", "und", "(none)"}
    drawn = {r.source: r.t for r in m.records.selectExpr("source", "n_tokens * repeats as t").groupBy("source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "t").collect()}
    slack = 61 / 2 * len(m.cells)
    goal = m.goal.set_index("source")["target_tokens"]
    assert all(abs(drawn[s] - goal[s]) <= slack for s in ("a", "b"))
    key = lambda m: sorted((r.doc_id, r.repeats) for r in m.records.collect())
    assert key(m) == key(mx.Mix(spark.createDataFrame(docs[::-1], D).repartition(7), tg))
    assert {r.margin for r in m.margins.collect()} == {"lang", "topic", "source"} and all(r.met for r in m.margins.filter("margin = 'source'").collect())


def test_small_labels_share_a_cell(spark, monkeypatch):
    monkeypatch.setattr(mx, "MAX_CELLS", 18)
    docs = [(i, "word " * (50 if i < 40 else 1), "a", f"l{i}" if i >= 40 else ("en", "de")[i % 2], f"t{i % 9}", 0, 0.0) for i in range(80)]
    m = mx.Mix(spark.createDataFrame(docs, D), spark.createDataFrame([("a", 1.0, 2)], T))
    assert set(m.cells["lang"]) == {"en", "de", mx.OTHER} and set(m.cells["topic"]) == {mx.OTHER}
    assert m.records.count() == 80 and m.report.first().n_docs == 80


def test_raking_a_table_gives_the_weights_of_the_driver(spark):
    import random

    rng = random.Random(8)
    cap = {"a": 1, "b": 2, "c": 5, "d": 0}
    rows = [(s, f"l{i}", f"t{j}", rng.choice([0, 1, 5, rng.randint(1, 900)]), 1, cap[s]) for s in cap for i in range(5) for j in range(30) if rng.random() < 0.4]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, n_docs long, max_repeats int")
    total = sum(r[3] for r in rows)
    aim = {"a": 0.2 * total, "b": 0.1 * total, "c": 0.7 * total, "d": 0.0}
    got = mx.rake_table(cells, spark.createDataFrame(list(aim.items()), "source string, target_tokens double"), rounds=3).toPandas()
    assert len(got) == len(rows)
    assert np.abs(got["weight"] - mx.rake(got, aim, rounds=3)).max() < 1e-9


def test_rare_labels_are_raked_by_themselves(spark, monkeypatch):
    docs = [(i, "word " * (40 if i < 40 else 1 + i % 3), "ab"[i % 2 if i < 40 else i % 5 // 4], f"l{i // 8}" if i >= 40 else ("en", "de")[i // 2 % 2], "k", 0, 0.0) for i in range(80)]
    docs, tg = spark.createDataFrame(docs, D), spark.createDataFrame([("a", 3.0, 9), ("b", 2.0, 9)], T)
    full = mx.Mix(docs, tg)
    monkeypatch.setattr(mx, "MAX_CELLS", 8)
    m = mx.Mix(docs, tg)
    assert mx.OTHER in set(m.cells["lang"])  # the driver's view only
    rows = lambda m: {(r.margin, r.label): (round(r.wanted_tokens, 5), round(r.raked_tokens, 5), r.met) for r in m.margins.collect()}
    assert rows(m) == rows(full) and {k for n, k in rows(m) if n == "lang"} == {"en", "de", "l5", "l6", "l7", "l8", "l9"}
    assert sorted(m.records.collect()) == sorted(full.records.collect()) and sorted(m.report.collect()) == sorted(full.report.collect())


def test_a_source_of_many_small_cells_is_drawn_whole(spark):
    docs = [(i, "word " * (1 + i % 4), "ab"[i % 3 == 0], "en", f"t{i}", 0, 0.0) for i in range(300)]
    docs, tg = spark.createDataFrame(docs, D), spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 3)], T)
    m = mx.Mix(docs, tg)
    drawn = {r.source: r.t for r in m.records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()}
    longest = m.sizes.agg(F.max("n_tokens")).first()[0]
    goal = m.goal.set_index("source")["raked_tokens"]
    assert all(abs(drawn[s] - goal[s]) <= longest for s in "ab")
    assert sorted(m.records.collect()) == sorted(mx.Mix(docs.repartition(5), tg).records.collect())
