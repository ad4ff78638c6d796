"""Operators of the catalogue and sinks of the lake against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cartolake.functions import text
from cartolake.operators import catalogue as op
from cartolake.sources import lake


def test_merged_takes_the_first_sides_values(spark):
    a = spark.createDataFrame([("1", "x", None), ("2", None, None)], "id string, name string, kind string")
    b = spark.createDataFrame([("1", "y", "k"), ("3", "z", "l")], "id string, name string, kind string")
    assert {tuple(r) for r in op.merged(a, b, "id", ["name", "kind"]).collect()} == {("1", "x", "k", "a,b"), ("2", None, None, "a"), ("3", "z", "l", "b")}


def test_aliases_follow_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 900) if k % 100] + [(5, 5)]
    last = {}
    for k, _ in links:
        if k % 100:
            last[k] = (k // 100 + 1) * 100
    got = {r.old: r.new for r in op.aliases(spark.createDataFrame(sorted(set(links)), "old long, new long").where("old <> new"), "old", "new", 128).collect()}
    assert got == last


@pytest.mark.parametrize("values", [[3.5, None, 1.0, 1.0, 7.25, None, -2.0], [1.0] * 20, []])
def test_global_position(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    got = {r.id: r.position for r in op.global_position(df, "v", F.col("id").asc(), buckets=4).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_pages_follow_cursors(spark):
    r = random.Random(2)
    rows = [(i, float(r.randint(0, 20))) for i in range(95)]
    df, cursor, seen = spark.createDataFrame(rows, "id long, v double"), None, []
    while True:
        page = op.page(df, [("v", True), ("id", False)], 30, cursor)
        seen += [x.id for x in page.rows.limit(page.size).collect()]
        if not (cursor := page.cursor(["v", "id"])):
            break
    assert seen == [i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))]


def test_clamp():
    assert [op.clamp(x, 1, 100, 40) for x in (None, "7", "x", 0, 1000)] == [40, 7, 40, 1, 100]


def test_folding_captions_and_intents(spark):
    df = spark.createDataFrame([("Éà ñŠ́ ßœ",)], "t string")
    assert df.select(text.fold_marks(F.col("t"))).first()[0] == "Ea nS ßœ"
    assert df.select(text.strip_html(F.lit("<b>A&nbsp;&amp; B</b>\n C"))).first()[0] == "A & B C"
    flags = [F.lit(x) for x in (True, True)]
    ask = lambda q, c: df.select(text.intent_bucket(F.lit(q), F.lit(c), *flags)).first()[0]
    assert [ask("Tea", ""), ask("", "Pet Shop"), ask("", "")] == ["coffee", "pet_shop", "open_now"]


def test_bucketed_documents_are_found_in_one_folder(spark, tmp_path):
    path = str(tmp_path / "docs")
    lake.write_bucketed(spark.createDataFrame([(f"loc-{k}", k) for k in range(50)] + [("cn-tower", 99)], "id string, n long"), path, "id")
    assert (tmp_path / "docs" / "bucket=60c").is_dir() and (tmp_path / "docs" / "bucket=e79").is_dir()
    found = lake.look_up(spark, path, "id", "loc-1")
    assert [tuple(r) for r in found.collect()] == [("loc-1", 1)] and "bucket=60c" in str(found.inputFiles()) and lake.look_up(spark, path, "id", "loc-99").count() == 0


def test_ledger_builds_and_export(spark, tmp_path):
    made = []

    def part(k):
        def make():
            made.append(k)
            return spark.range(k)

        return make

    parts = {f"p{k}": part(k) for k in (1, 2, 3)}
    path = str(tmp_path / "build")
    assert lake.build_parts(spark, path, {"p1": parts["p1"]}) == ["p1"] and lake.build_parts(spark, path, parts) == ["p2", "p3"] and made == [1, 2, 3]
    files = {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in (tmp_path / "build").rglob("*.parquet")}
    now = lake.ledger(spark, path)
    assert {r.name: r.sha256 for r in now.collect()} == files
    one = sorted(files)[0]
    before = now.withColumn("sha256", F.when(F.col("name") == one, "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("old", 1, "1")], "name string, size long, sha256 string"))
    assert {tuple(r) for r in lake.changed(now, before).collect()} == {(one, "changed"), ("old", "gone")}
    lake.bulk_export(spark.range(250), str(tmp_path / "index"), "v1", 10)
    assert spark.read.json(str(tmp_path / "index" / "current")).first().asDict() == {"version": "v1", "records": 250}
    assert all(sum(1 for _ in f.open()) <= 100 for f in (tmp_path / "index" / "v1").glob("*.json"))


def test_leases_and_conflicts(spark):
    log = spark.createDataFrame([(1, "2024-01-01 10:00:00", "claim"), (1, "2024-01-01 10:05:00", "live"), (2, "2024-01-01 10:00:00", "claim"), (3, "2024-01-01 10:50:00", "claim"), (2, "2024-01-01 10:20:00", "live")], "k long, ts string, kind string")
    log = log.withColumn("at", F.to_timestamp("ts"))
    got = {r.k: r.state for r in op.leases(log, "k", "at", "kind", F.to_timestamp(F.lit("2024-01-01 11:00:00"))).collect()}
    assert got == {1: "live", 2: "expired", 3: "pending"}
    rows = [(1, "p", "x", 0, 0), (2, "p", "x", 1 << 40, 0), (3, "q", "x", 7 << 50, 1), (4, "r", "y", 0b11111, 0b11), (5, "s", "z", 0b11, (1 << 11) - 1), (6, None, None, 0x0F0F0F0F, 0)]
    claims = spark.createDataFrame(rows, "id long, place string, bytes string, fp long, fc long")
    assert {tuple(r) for r in op.conflicts(claims, "id", "id", ["place", "bytes"], "fp", "fc").collect()} == {(2, 0, 1), (3, 1, 1), (4, 2, 1), (5, 2, 3)}
