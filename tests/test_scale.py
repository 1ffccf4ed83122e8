import random

from pyspark.sql import functions as F

from corpusloom.scale import carry_last, heavy_keys, likely, lookup, running_totals, write_table


def test_lookup_keeps_all_rows_with_hot_keys(spark):
    probe = spark.createDataFrame([("hot", i) for i in range(4000)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, i int")
    table = spark.createDataFrame([("hot", "h"), ("k1", "x")], "k string, v string")
    heavy = heavy_keys(probe.groupBy("k").agg(F.count("*").alias("n")), "k", "n", 4051, 4)
    assert [r.k for r in heavy.collect()] == ["hot"]
    got = lookup(probe, table, "k", heavy)
    assert got.count() == 4051 and got.filter("v = 'h'").count() == 4000 and got.filter("v = 'x'").count() == 1
    assert lookup(probe, table, "k", heavy, "inner").count() == 4001


def test_running_totals_and_carry_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randint(0, 5), rng.choice([None, "x", "y", "z"])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, n int, v string").repartition(5)
    got = {(r.g, r.o): r.t for r in running_totals(df, ["g"], ["o"], "n", "t").collect()}
    carried = {(r.g, r.o): r.c for r in carry_last(df, ["g"], ["o"], "v", "c").collect()}
    for g in "ab":
        total, last = 0, None
        for _, o, n, v in sorted(r for r in rows if r[0] == g):
            last = v or last
            assert got[g, o] == total and carried[g, o] == last
            total += n


def test_written_tables_are_read_back(spark):
    t, path = write_table(spark.range(10), "test")
    assert t.count() == 10 and "corpusloom/test-" in path


def test_likely_rows_hold_all_of_the_keys(spark):
    rows = spark.createDataFrame([(f"k{i % 50}", i) for i in range(500)] + [(None, 1)], "k string, i int")
    keys = spark.createDataFrame([("k1",), ("k2",), ("absent",), (None,)], "key string")
    assert {r.k for r in likely(rows, "k", keys).collect()} - {None} == {"k1", "k2"}
    assert likely(rows, "k", keys.limit(1)).filter("k = 'k1'").count() == 10
    assert likely(rows, "k", keys, most=1).count() == 501
