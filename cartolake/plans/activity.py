"""Queries over orders, lines, events, conversations and vectors: relational shapes, recommendation features, social queries, ledgers, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, moments
from ..operators.mih import near_pairs, simhash
from ..operators.relational import common_counts, keyset_after, latest_per_key, ledger_conflicts, ordered_array, ranged_common_counts, top_per_key, without
from ..operators.topk import cosine_topk
from ..streaming import state
from .places import load

NOW = "2024-01-30 00:00:00"
QUERIES, ORACLE_SQL = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def plain(name: str, tables: str, sql: str, duck: str | None = None) -> None:
    """A query whose text runs on both engines, but for the tables' braces."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in tables.split()})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = (duck or sql).replace("{", "").replace("}", "")


@register("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def dedupe_latest(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_totalprice", "o_orderkey"])


@register("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 5")
def topn_per_key(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return top_per_key(li, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc(), F.col("l_partkey").asc()], 5).drop("l_partkey")


@register("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem), t AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_suppkey) AS q FROM d WHERE r = 1)
SELECT l_partkey, l_suppkey, l_extendedprice, q FROM t WHERE q <= 3""")
def two_level_dedupe_topn(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    one = top_per_key(li, ["l_partkey", "l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()])
    from pyspark.sql import Window

    q = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.col("l_extendedprice").desc(), "l_suppkey"))
    return one.withColumn("q", q).where("q <= 3").select("l_partkey", "l_suppkey", "l_extendedprice", "q")


@register("SELECT user_id, to_json(list(event_type ORDER BY ts, event_id)[1:5]) AS first_types, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def ordered_arrays(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.to_json(F.slice(ordered_array(F.col("event_type"), F.col("ts"), F.col("event_id")), 1, 5)).alias("first_types"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000.0 OR (o_totalprice = 300000.0 AND o_orderkey > 100) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return keyset_after(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], [300000.0, 100], 50)


@register("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c.c_custkey) AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_acctbal > 9000)")
def anti_two_keys(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    left = without(c, s.select(F.col("s_suppkey").alias("c_custkey")), "c_custkey")
    return without(left, s.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey").select("c_custkey")


def edges(spark, sf_dir):
    """Customers and the parts they ordered, whole ids: customer k is node 2k, part k is node 2k + 1."""
    o, li = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).dropna().distinct()


@register("""WITH e AS (SELECT DISTINCT 2 * o_custkey AS a, 2 * l_partkey + 1 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
f AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e)
SELECT l.x AS a, r.x AS b, count(*) AS mutual FROM f l JOIN f r ON l.y = r.y AND l.x < r.x GROUP BY 1, 2""")
def mutual_counts(spark, sf_dir):
    """Common friends of each pair of customers and of each pair of parts, from edges in both directions."""
    o, li = load(spark, sf_dir, "orders").groupBy("o_custkey").count(), load(spark, sf_dir, "lineitem").groupBy("l_partkey").count()
    lines = F.lit(load(spark, sf_dir, "lineitem").count() / max(1, load(spark, sf_dir, "orders").count()))
    degrees = o.select((F.col("o_custkey") * 2).alias("i"), (F.col("count") * lines).alias("n")).unionByName(li.select((F.col("l_partkey") * 2 + 1).alias("i"), F.col("count").cast("double").alias("n")))
    ways = edges(spark, sf_dir).select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))  # distinct: a is even, b is odd
    return ranged_common_counts(ways, "x", "y", degrees).withColumnRenamed("common", "mutual")


@register("""WITH l AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT a.o_custkey AS a, b.o_custkey AS b, count(*) AS common FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.o_custkey < b.o_custkey
GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_like_matches(spark, sf_dir):
    """Pairs of customers with two parts or more in common, over all customers and parts."""
    o, li = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    likes = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").dropna().distinct()
    return common_counts(likes, "o_custkey", "l_partkey", 2)


@register("SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, count(*) FILTER (role = 'assistant' AND turn > 1) AS unread FROM conversations GROUP BY 1")
def inbox_latest_unread(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count_if((F.col("role") == "assistant") & (F.col("turn") > 1)).alias("unread"))


_W = "CASE event_type WHEN 'purchase' THEN 4.0 WHEN 'signup' THEN 2.5 WHEN 'click' THEN 1.0 WHEN 'error' THEN -3.0 ELSE 0.3 END"


@register(f"""WITH s AS (SELECT user_id, event_type, ({_W}) * exp(-greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0) / 45.0) AS w,
 CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS dp, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS dt FROM events),
k AS (SELECT user_id, unnest(['global|' || event_type, 'daypart:' || dp || '|' || event_type, 'daytype:' || dt || '|' || event_type]) AS key, w FROM s)
SELECT user_id, key, round(sum(w) / (8.0 + sum(abs(w))), 4) AS affinity FROM k GROUP BY 1, 2""")
def context_decay_shrinkage(spark, sf_dir):
    """Decayed signals under several context keys, shrunk towards zero; the keys are exploded from one scan."""
    e = load(spark, sf_dir, "events")
    weight = F.expr(_W).cast("double")
    kind, dp, dt = F.col("event_type"), moments.daypart(F.col("ts")), moments.daytype(F.col("ts"))
    keys = F.array(F.concat(F.lit("global|"), kind), F.concat(F.lit("daypart:"), dp, F.lit("|"), kind), F.concat(F.lit("daytype:"), dt, F.lit("|"), kind))
    s = e.select("user_id", F.explode(keys).alias("key"), moments.decay(weight, F.col("ts"), NOW).alias("w"))
    return s.groupBy("user_id", "key").agg(F.round(F.sum("w") / (8.0 + F.sum(F.abs("w"))), 4).alias("affinity"))


@register("""WITH t AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice, lines, CASE WHEN lines IS NULL THEN 'missing' WHEN abs(o_totalprice - lines) < 0.01 THEN 'balanced' WHEN lines > o_totalprice THEN 'over' ELSE 'under' END AS state FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""")
def reconcile(spark, sf_dir):
    o, li = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), load(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("lines"))
    st = F.when(F.col("lines").isNull(), "missing").when(F.abs(F.col("o_totalprice") - F.col("lines")) < 0.01, "balanced").when(F.col("lines") > F.col("o_totalprice"), "over").otherwise("under")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_totalprice", "lines", st.alias("state"))


@register(r"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda w: w <> '')) AS ws FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(ws) AS w FROM t)),
n AS (SELECT doc_id, b, sum(((h >> b::UBIGINT) & 1)::INTEGER) * 2 > count(*) AS one FROM h, range(64) AS r(b) GROUP BY 1, 2),
f AS (SELECT t.doc_id, coalesce(bit_or(CASE WHEN one THEN 1::UBIGINT << b::UBIGINT ELSE 0::UBIGINT END), 0::UBIGINT) AS fp FROM t LEFT JOIN n ON t.doc_id = n.doc_id GROUP BY 1),
c AS (SELECT fp, min(doc_id) AS first FROM f GROUP BY 1)
SELECT first AS a, doc_id AS b, 0::INTEGER AS distance FROM f JOIN c USING (fp) WHERE doc_id <> first
UNION ALL SELECT x.first, y.first, CAST(bit_count(xor(x.fp, y.fp)) AS INTEGER) FROM c x JOIN c y ON x.first < y.first AND bit_count(xor(x.fp, y.fp)) <= 5""")
def near_dup_mih(spark, sf_dir):
    """SimHashes of whole texts within 5 bits, found in three keys with one-bit neighbours; classes of equal ones once."""
    return near_pairs(simhash(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id", "fp")


@register("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_sum(list_transform(range(1, 65), lambda i: e[i]::DOUBLE * embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)))) AS c FROM q, embeddings WHERE q <> vec_id)
SELECT q, vec_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, vec_id) AS rn FROM s) WHERE rn <= 10""")
def vector_topk(spark, sf_dir):
    """Exact cosine top 10 among all vectors for each vector whose id is divisible by 50."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cosine_topk(e.where("vec_id % 50 = 0"), e, 10).select("q", "vec_id", F.round("c", 6).alias("cosine"))


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return state.tumbling_counts(load(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour")


@register("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def running_state_latest(spark, sf_dir):
    return state.latest(load(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type")


@register("SELECT user_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)::BIGINT AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1 HAVING sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) > 0")
def incremental_counters(spark, sf_dir):
    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    return state.counters(e.withColumn("d", F.when(F.col("event_type") == "error", -1).otherwise(1)), ["user_id"], "d")


@register("SELECT DISTINCT user_id, event_type FROM events")
def outbox_dedupe(spark, sf_dir):
    return state.once(load(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"]).select("user_id", "event_type")


@register("SELECT o_custkey, count(*) AS n_rows, count(DISTINCT o_orderstatus || o_orderpriority) AS n_contents FROM orders GROUP BY 1")
def ledger_dedupe(spark, sf_dir):
    return ledger_conflicts(load(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


@register("""SELECT c_custkey, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 3) AS bucket, CAST(('0x' || substr(sha256('exp' || CAST(c_custkey AS VARCHAR)), 1, 12))::UBIGINT % 10000 AS BIGINT) AS slot,
 CASE WHEN ('0x' || substr(sha256('exp' || CAST(c_custkey AS VARCHAR)), 1, 12))::UBIGINT % 10000 < 1000 THEN 'holdout' WHEN ('0x' || substr(sha256('exp' || CAST(c_custkey AS VARCHAR)), 1, 12))::UBIGINT % 10000 < 5500 THEN 'a' ELSE 'b' END AS variant FROM customer""")
def experiment_buckets(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    slot = hashing.percent_bucket(k, "exp")
    return load(spark, sf_dir, "customer").select("c_custkey", hashing.hash_bucket(k).alias("bucket"), slot.alias("slot"), F.when(slot < 1000, "holdout").when(slot < 5500, "a").otherwise("b").alias("variant"))


@register("SELECT c_custkey FROM customer ORDER BY sha256(CAST(c_custkey AS VARCHAR)) LIMIT 40")
def sample_hash(spark, sf_dir):
    return load(spark, sf_dir, "customer").orderBy(F.sha2(F.col("c_custkey").cast("string"), 256)).limit(40).select("c_custkey")


@register("""WITH n AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, epoch(hour)::BIGINT // 3600 - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS run FROM n)
SELECT user_id, hour, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY hour) AS place FROM r) WHERE place % 2 = 1""")
def anomaly_windows(spark, sf_dir):
    """Errors of one user within an hour, two or more, unless the hour before gave that user's alert: of hours in a row every other one alerts."""
    e = load(spark, sf_dir, "events").where("event_type = 'error'")
    n = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).where("n >= 2")
    at = F.floor(F.unix_timestamp("hour") / 3600)
    n = n.withColumn("run", at - F.row_number().over(Window.partitionBy("user_id").orderBy("hour")))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "run").orderBy("hour"))).where("place % 2 = 1").select("user_id", "hour", "n")


plain("group_having", "orders", "SELECT o_custkey, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) >= 5")
plain("count_distinct_check", "lineitem", "SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts FROM {lineitem}")
plain("filtered_agg", "lineitem", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n_high, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS qty_f, round(avg(l_tax), 6) AS tax FROM {lineitem} GROUP BY l_returnflag")
plain("percentiles", "orders", "SELECT o_orderpriority, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p95 FROM {orders} GROUP BY o_orderpriority")
plain("weighted_mean", "lineitem", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS mean, round((sum(l_quantity) + 8 * 3.8) / (count(*) + 8), 6) AS shrunk, least(25, count(*)) AS capped FROM {lineitem} GROUP BY l_suppkey")
plain("inner_using", "orders customer", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > 400000")
plain("left_chain", "customer nation region supplier", "SELECT c_custkey, n_name, r_name, s_name FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey LEFT JOIN {region} ON n_regionkey = r_regionkey LEFT JOIN {supplier} ON s_suppkey = c_custkey")
plain("semi_join", "customer orders", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
plain("anti_join", "customer orders", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")


def _first_orders(spark: SparkSession, sf_dir: str, first: str, n: int) -> DataFrame:
    """The first n orders of each customer, the latest or dearest first. Spark's own plan of a lateral ORDER BY LIMIT sorts first and then shuffles, which keeps
    no order on a cluster; the window's order is explicit."""
    o = load(spark, sf_dir, "orders").where(F.col("o_custkey").isNotNull()).select("o_custkey", "o_orderkey", first)
    return top_per_key(o, ["o_custkey"], [F.col(first).desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()], n).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@register("SELECT c_custkey, x.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) x ON true")
def lateral_top1(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey").join(_first_orders(spark, sf_dir, "o_totalprice", 1), "c_custkey", "left")


@register("SELECT c_custkey, x.o_orderkey FROM customer CROSS JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 3) x")
def lateral_topn(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey").join(_first_orders(spark, sf_dir, "o_orderdate", 3), "c_custkey")


plain("scalar_subquery", "customer orders", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n_orders FROM {customer}")
plain("semi_reduction", "lineitem part", "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size = 11 AND p_brand = 'Brand#2')")
plain("union_all_named", "customer supplier", "SELECT 'c' AS kind, c_custkey AS k, c_acctbal AS balance FROM {customer} UNION ALL SELECT 's', s_suppkey, s_acctbal FROM {supplier}")
plain("union_distinct", "customer supplier", "SELECT c_nationkey AS nation FROM {customer} WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9000")
plain("distinct_from", "orders", "SELECT count(*) AS n FROM {orders} WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM nullif(o_orderpriority, '5-LOW')")
plain("null_not_in", "orders", "SELECT o_orderkey FROM {orders} WHERE nullif(o_orderstatus, 'P') NOT IN ('F')")
plain("ranked_like", "part", "SELECT p_partkey, p_name, CASE WHEN p_name = 'red' THEN 0 WHEN p_name LIKE 'red%' THEN 1 ELSE 2 END AS tier FROM {part} WHERE p_name LIKE '%red%'")
plain("sla_breach", "orders", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'F') AS breached FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_orderpriority")
plain("orphans", "orders lineitem", "SELECT o_orderkey FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
plain("json_fields", "events", "SELECT event_id, try_cast(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
plain("string_functions", "customer", "SELECT c_custkey, upper(c_mktsegment) AS up, concat_ws('|', c_name, c_mktsegment) AS joined, substr(c_name, 10, 4) AS part, replace(c_name, '#', '-') AS dashed, levenshtein(c_mktsegment, 'BUILDING') AS distance, length(trim(c_name)) AS n FROM {customer}")
plain("array_functions", "part", "SELECT p_partkey, array_join(slice(split(p_name, ' '), 1, 1), ',') AS first_word, CAST(size(split(p_name, ' ')) AS BIGINT) AS n FROM {part}", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, len(string_split(p_name, ' ')) AS n FROM part")
plain("time_functions", "events", "SELECT event_id, date_trunc('hour', ts) AS hour, CAST(hour(ts) AS BIGINT) AS h, CAST(weekday(ts) + 1 AS BIGINT) AS isodow, timestamp_seconds(floor(unix_timestamp(ts) / 300) * 300) AS five FROM {events}", "SELECT event_id, date_trunc('hour', ts) AS hour, hour(ts) AS h, isodow(ts) AS isodow, time_bucket(INTERVAL 5 MINUTE, ts) AS five FROM events")
plain("retention_sweep", "events", "SELECT user_id, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY user_id")
plain("dashboard", "orders customer", "SELECT 'orders' AS section, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} UNION ALL SELECT 'customers', count(*), round(sum(c_acctbal), 2) FROM {customer}")
plain("catalogue_refresh", "customer supplier", "SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_custkey % 4 + 1 ELSE 0 END AS missed, s_suppkey IS NULL AND c_custkey % 4 + 1 >= 3 AS archived FROM {customer} LEFT JOIN {supplier} ON s_suppkey = c_custkey")
plain("consensus_top5", "lineitem", "SELECT l_partkey, l_suppkey, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, last DESC, l_suppkey) AS rn FROM (SELECT l_partkey, l_suppkey, count(*) AS n, max(l_shipdate) AS last FROM {lineitem} GROUP BY l_partkey, l_suppkey) g) x WHERE rn <= 5")
