"""Queries over whole tables against SQL and plain Python."""

import datetime
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from cartolake import plans
from cartolake.operators.catalogue import tile_neighbours
from cartolake.operators.relational import common_counts, ranged_common_counts
from cartolake.operators.topk import cosine_topk


def rows(spark, folder, name, **tables):
    """The query's rows over small tables, columns by name."""
    for t, (schema, values) in tables.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{t}.parquet")
    df = plans.QUERIES[name](spark, str(folder))
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def duck(folder, sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(sql).fetchall())


CO_LIKE = """WITH l AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT a.o_custkey AS a, b.o_custkey AS b, count(*) AS common FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.o_custkey < b.o_custkey GROUP BY 1, 2 HAVING count(*) >= 2"""


def test_co_like_matches_of_all_customers_and_whole_parts(spark, tmp_path):
    """Customers 200 and 300 share 25 parts; 1 and 2 share none, though their parts agree modulo 40."""
    likes = {1: range(1, 31), 2: range(41, 71), 200: range(100, 130), 300: range(105, 140)}
    orders = [(c, c) for c in likes]
    lines = [(c, p) for c, parts in likes.items() for p in parts]
    got = rows(spark, tmp_path, "co_like_matches", orders=("o_orderkey long, o_custkey long", orders), lineitem=("l_orderkey long, l_partkey long", lines + lines[:5]))
    assert got == [(200, 300, 25)] == duck(tmp_path, CO_LIKE, "orders", "lineitem")


def test_common_counts_in_blocks(spark):
    df = spark.createDataFrame([(i, k) for k in range(3) for i in range(0, 40, k + 1)], "i long, k long")
    have = {i: {k for k in range(3) if i % (k + 1) == 0} for i in range(40)}
    want = {(a, b, len(have[a] & have[b])) for a in have for b in have if a < b}
    assert {tuple(r) for r in common_counts(df, "i", "k", 1, 7).collect()} == want


TOPK = """WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_sum(list_transform(range(1, 65), lambda i: e[i]::DOUBLE * embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)))) AS c FROM q, embeddings WHERE q <> vec_id)
SELECT round(c, 6) AS cosine, q, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, vec_id) AS rn FROM s) WHERE rn <= 10"""


def test_vector_topk_takes_every_fiftieth_as_query(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = {(r.q, r.vec_id): r.cosine for r in plans.QUERIES["vector_topk"](spark, "/root/testdata/sf0.001").collect()}
    want = {(q, v): c for c, q, v in con.execute(TOPK).fetchall()}
    assert {q for q, _ in got} == set(range(0, 500, 50)) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_cosine_topk_in_blocks_with_ties_and_zeros(spark):
    r = np.random.default_rng(1)
    vectors = [[float(x) for x in r.integers(-2, 3, 4)] for _ in range(60)] + [[0.0] * 4] * 2
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {(r.q, r.vec_id) for r in cosine_topk(df.where("vec_id % 5 = 0"), df, 4, 3, 9).collect()}

    def cosine(a, b):
        size = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
        return np.dot(a, b) / size if size else -np.inf

    assert got == {(q, v) for q in range(0, 62, 5) for v in sorted((v for v in range(62) if v != q), key=lambda v: (-cosine(vectors[q], vectors[v]), v))[:4]}


MUTUAL = """WITH e AS (SELECT DISTINCT 2 * o_custkey AS a, 2 * l_partkey + 1 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), f AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e)
SELECT l.x AS a, r.x AS b, count(*) AS mutual FROM f l JOIN f r ON l.y = r.y AND l.x < r.x GROUP BY 1, 2"""


def test_mutual_counts_of_whole_ids(spark, tmp_path):
    """Customers 1 and 201 share parts 7 and 8, which share both of them; customer 401 and part 207 share nothing."""
    orders, lines = [(10, 1), (11, 201), (12, 401)], [(10, 7), (10, 8), (11, 7), (11, 8), (11, 8), (12, 207)]
    got = rows(spark, tmp_path, "mutual_counts", orders=("o_orderkey long, o_custkey long", orders), lineitem=("l_orderkey long, l_partkey long", lines))
    assert got == [(2, 402, 2), (15, 17, 2)] == duck(tmp_path, MUTUAL, "orders", "lineitem")


def test_mutual_counts_of_the_smallest_tables(spark):
    got = sorted(tuple(r) for r in plans.QUERIES["mutual_counts"](spark, "/root/testdata/sf0.001").select("a", "b", "mutual").collect())
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert got == sorted(con.execute(MUTUAL).fetchall()) and len(got) > 200


def near_brute_force(texts):
    """Pairs as near_dup_mih gives them, from SimHashes in plain Python."""
    prints = {}
    for k, text in texts.items():
        if text is not None:
            h = [int(hashlib.sha256(w.encode()).hexdigest()[:16], 16) for w in set(re.split("[ \t\r\n]+", text.lower())) if w]
            prints.setdefault(sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)), []).append(k)
    classes = sorted((min(ids), fp, sorted(ids)[1:]) for fp, ids in prints.items())
    equal = {(a, b, 0) for a, _, rest in classes for b in rest}
    return equal | {(a, b, d) for a, x, _ in classes for b, y, _ in classes if a < b and (d := (x ^ y).bit_count()) <= 5}


def test_near_dup_mih_reads_texts(spark, tmp_path):
    """Equal texts are found whatever their ids; 0 and 300 agree modulo 300 only."""
    long = " ".join(f"word{i * i % 97} stone{i}" for i in range(400))
    texts = {0: "grey harbour wall", 5: long, 11: long, 23: long, 46: long.replace("stone7 ", "pier "), 300: "quite another text", 600: None, 601: "", 602: " \n", 9: long + " crane"}
    got = rows(spark, tmp_path, "near_dup_mih", documents=("doc_id long, text string", list(texts.items())))
    assert set(got) == near_brute_force(texts) and len(got) == len(set(got))
    assert {(5, 11, 0), (5, 23, 0), (601, 602, 0)} <= set(got) and not any({0, 300, 600} & {a, b} for a, b, _ in got)
    assert any(46 in x[:2] for x in got)


def test_near_dup_mih_of_the_smallest_table(spark):
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())
    got = [(r.a, r.b, r.distance) for r in plans.QUERIES["near_dup_mih"](spark, "/root/testdata/sf0.001").collect()]
    assert set(got) == near_brute_force(texts) and len(got) == len(set(got))


def test_anomaly_windows_of_all_users(spark, tmp_path):
    """User 10 is no exception; of user 3's hours 1, 2, 3 and 5 the second is covered by the first one's alert."""
    at = lambda h, m: datetime.datetime(2024, 1, 5, h, m)
    hours = {10: [4], 3: [1, 2, 3, 5]}
    events = [(at(h, m), u, "error") for u, hs in hours.items() for h in hs for m in (1, 59)] + [(at(9, 0), 7, "error"), (at(10, 0), 7, "error"), (at(9, 1), 7, "view")]
    spark.createDataFrame(events, "ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = plans.QUERIES["anomaly_windows"](spark, str(tmp_path)).selectExpr("user_id", "hour(hour) AS h", "n").collect()
    assert sorted(map(tuple, got)) == [(3, 1, 2), (3, 3, 2), (3, 5, 2), (10, 4, 2)]


LATERAL = {
    "lateral_top1": "SELECT c_custkey, x.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) x ON true",
    "lateral_topn": "SELECT c_custkey, x.o_orderkey FROM customer CROSS JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 3) x",
}


@pytest.mark.parametrize(("name", "first"), [("lateral_top1", "o_totalprice"), ("lateral_topn", "o_orderdate")])
def test_lateral_order_survives_the_shuffle(spark, tmp_path, name, first):
    """The window's own order holds price or date: a sort before the shuffle by customer is lost on a cluster. Nulls come last, as in SQL."""
    day = lambda d: datetime.datetime(2024, 1, d)
    orders = [(1, 10, 5.0, day(1)), (2, 10, 9.0, day(3)), (None, 10, 9.0, day(3)), (3, 10, None, day(2)), (4, 10, 9.0, None), (5, 11, None, None), (6, None, 1.0, day(1)), (8, 12, 2.0, day(5)), (7, 12, 2.0, day(5)), (9, 14, 2.0, day(5))]
    spark.createDataFrame([(10,), (11,), (12,), (13,), (12,), (None,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    df = plans.QUERIES[name](spark, str(tmp_path))
    key = lambda r: [(v is None, v or 0) for v in r]
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, df.select("c_custkey", "o_orderkey").collect()), key=key) == sorted(con.execute(LATERAL[name]).fetchall(), key=key)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"row_number\(\) windowspecdefinition\(o_custkey#\d+L?, {first}#\d+ DESC", plan), plan


def test_tile_neighbours_in_small_lists(spark):
    """Full tiles in lists of three rows: every pair once, equal keys as often as they occur, none with itself; the pairs are made after the last shuffle."""
    r = random.Random(5)
    t = [(str(k % 70), r.randrange(3), r.randrange(-2, 2)) for k in range(120)] + [("x", None, 0), (None, 0, 0)]
    df = tile_neighbours(spark.createDataFrame(t, "k string, tx long, ty long"), "k", "tx", "ty", 3, 500)
    have = [p for p in t if None not in p]
    want = sorted((a, b) for a, x, y in have for b, u, v in have if a < b and abs(x - u) <= 1 and abs(y - v) <= 1)
    assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() > 4
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(rs") < plan.index("RepartitionByExpression")


def test_tile_neighbours_of_no_rows(spark):
    assert tile_neighbours(spark.createDataFrame([], "k string, tx long, ty long"), "k", "tx", "ty").collect() == []


@pytest.mark.parametrize(("wide", "block"), [(1, 7), (1, 1000), (1 << 28, 7), (1 << 28, 1000)])
def test_ranged_common_counts_shuffle_no_pair(spark, wide, block):
    """Several ranges, keys whole and in blocks, near and far items, rough degrees: the counts of plain Python; after the pairs are made there is no shuffle."""
    df = spark.createDataFrame([((i - 9) * wide, k) for k in range(3) for i in range(0, 40, k + 1)] + [(wide, 8)], "i long, k long")
    have = {i: {k for k in range(3) if i % (k + 1) == 0} for i in range(40)}
    want = sorted(((a - 9) * wide, (b - 9) * wide, len(have[a] & have[b])) for a in have for b in have if a < b)
    degrees = spark.createDataFrame([((i - 9) * wide, 3.0) for i in range(40)] + [(None, 5.0)], "i long, n double")
    got = ranged_common_counts(df, "i", "k", degrees, block, 20)
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(rs") < plan.index("Exchange")


def test_mutual_counts_shuffles_lists(spark):
    plan = plans.QUERIES["mutual_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(rs") < plan.index("Exchange")
