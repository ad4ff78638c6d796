import random

import pytest
from pyspark.sql import functions as F

from cartolake.operators.gridjoin import grid_join
from cartolake.operators.mih import mih_pairs
from cartolake.operators.relational import both_ways, keyset_after, latest_per_key, ledger_conflicts, merge_latest, top_per_key, without
from cartolake.sources import lake
from cartolake.streaming import state


def test_grid_join_equals_the_plain_join(spark):
    r = random.Random(1)
    a = spark.createDataFrame([(i, r.uniform(0, 0.02), r.uniform(0, 0.02)) for i in range(150)], "a int, y double, x double")
    b = spark.createDataFrame([(i, r.uniform(0, 0.02), r.uniform(0, 0.02)) for i in range(150)], "b int, v double, u double")
    near = (F.abs(F.col("y") - F.col("v")) <= 0.0009) & (F.abs(F.col("x") - F.col("u")) <= 0.0009)
    got = {(x.a, x.b) for x in grid_join(a, b, ("y", "x"), ("v", "u"), 1000.0, near).collect()}
    want = {(x.a, x.b) for x in a.crossJoin(b).where(near).collect()}
    assert got == want and want


def test_grid_keeps_its_reach(spark):
    """0.0012 degrees apart can be two cells apart, and is then no pair."""
    a = spark.createDataFrame([(1, 0.0009, 0.0)], "a int, y double, x double")
    b = spark.createDataFrame([(1, 0.0021, 0.0)], "b int, v double, u double")
    assert grid_join(a, b, ("y", "x"), ("v", "u"), 1000.0, F.abs(F.col("y") - F.col("v")) <= 0.0015).count() == 0


def test_mih_equals_all_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 7))) for b in base]
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(prints)]
    df = spark.createDataFrame(rows, "i int, f long")
    got = {(x.a, x.b) for x in mih_pairs(df, df, "i", "f").where("a < b").collect()}
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if (prints[i] ^ prints[j]).bit_count() <= 5}
    assert got == want
    with pytest.raises(ValueError):
        mih_pairs(df, df, "i", "f", 6)


def test_latest_top_keyset(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", None, 1), ("b", 0, 2)], "k string, t int, v int")
    assert {tuple(x) for x in latest_per_key(df, ["k"], ["t"]).collect()} == {("a", 2, 4), ("b", 0, 2)}
    assert {x.v for x in top_per_key(df, ["k"], [F.col("t").asc_nulls_last()]).collect()} == {5, 2}
    page = keyset_after(df, [("v", True)], [4], 2)
    assert [x.v for x in page.collect()] == [2, 1]


def test_merge_without_edges_ledger(spark):
    old = spark.createDataFrame([(1, 1)], "k int, t int")
    new = spark.createDataFrame([(1, 2, "x"), (2, 1, "y")], "k int, t int, extra string")
    assert {tuple(x) for x in merge_latest(old, new, ["k"], ["t"]).collect()} == {(1, 2, "x"), (2, 1, "y")}
    assert [x.k for x in without(new, old, "k").collect()] == [2]
    assert {tuple(x) for x in both_ways(old, "k", "t").collect()} == {(1, 1)}
    rows = spark.createDataFrame([("p", "s1"), ("p", "s1"), ("q", "s1"), ("q", "s2")], "k string, s string")
    assert {tuple(x) for x in ledger_conflicts(rows, "k", "s").collect()} == {("p", 2, 1), ("q", 2, 2)}


def test_lake_reads_and_rewrites(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, c string")
    lake.write_partitioned(df, path, "c")
    assert lake.columns_of(spark, path) == {"id", "v", "c"} and lake.columns_of(spark, str(tmp_path / "none")) == set()
    assert {x.p for x in lake.read_lake(spark, path).select(lake.partition_value("c").alias("p")).collect()} == {"x", "y"}
    picked = lake.pick(df, {"id": ("id", "long"), "name": ("names.primary", "string"), "n": ("v", "int")}, ["id"])
    assert picked.dtypes == [("id", "bigint"), ("name", "string"), ("n", "int")] and picked.where("n IS NULL").count() == 2
    with pytest.raises(ValueError):
        lake.pick(df, {}, ["nothing"])
    assert lake.or_empty(spark, path, "id int, other string").count() == 0
    flat = str(tmp_path / "flat")
    df.write.parquet(flat)
    lake.rewrite(spark, flat, lambda t: t.where("id = 1"))
    lake.append_part(df.where("id = 2"), flat)
    assert spark.read.parquet(flat).count() == 2


def test_json_sequence(spark, tmp_path):
    (tmp_path / "s.geojsons").write_text('\x1e{"a": 1}\n\n﻿\x1e{"a": 2}\n', encoding="utf-8")
    assert sorted(x.a for x in lake.json_sequence(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_stream_counts_once_and_drains(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00"), (3, "2024-01-01 05:00:00")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "id int, at string").selectExpr("id", "timestamp(at) AS ts").write.parquet(src)
    stream = spark.readStream.schema("id int, ts timestamp").parquet(src)
    state.drain(state.once(stream, "ts", ["id"]), str(tmp_path / "cp"), lambda df, n: df.write.mode("append").parquet(out))
    assert spark.read.parquet(out).count() == 3
    query = state.tumbling_counts(stream, "ts", [], "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(x.n for x in spark.sql("SELECT n FROM windows").collect()) == [1, 3]


def test_counters_and_latest(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1), ("b", 1)], "k string, d int")
    assert {tuple(x) for x in state.counters(df, ["k"], "d").collect()} == {("b", 1)}
