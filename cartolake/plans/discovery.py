"""Feeds, candidate ranking, comparison and bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, moments, text
from ..operators.gridjoin import grid_join
from ..operators.relational import top_per_key, without
from ..operators.shards import routing_directory, split_tiles
from .places import _A, _B, load, source_a, source_b

QUERIES, ORACLE_SQL = {}, {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@register(f"""WITH {_A}, g AS (SELECT *, name_key || ':' || CAST(nation AS VARCHAR) AS grp, 12742008.8 * atan2(sqrt(h), sqrt(greatest(1 - h, 0.0))) AS d FROM (SELECT *, pow(sin(radians(latitude - 5.0) / 2), 2) + cos(radians(5.0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 30.0) / 2), 2) AS h FROM a)),
b AS (SELECT source_id, grp FROM g WHERE quality < 0), k AS (SELECT * FROM g WHERE d <= 6000000 AND NOT EXISTS (SELECT 1 FROM b WHERE b.source_id = g.source_id) AND NOT EXISTS (SELECT 1 FROM b WHERE b.grp = g.grp))
SELECT source_id, grp, round(d, 2) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY d, source_id) AS rn FROM k) WHERE rn = 1""")
def discovery_feed(spark, sf_dir):
    """Places within a radius, without seen ones and all of their groups, the nearest of each group."""
    south, north, west, east = geo.radius_box(5.0, 30.0, 6_000_000)
    a = source_a(spark, sf_dir).withColumn("grp", F.concat_ws(":", "name_key", F.col("nation").cast("string")))
    seen = a.where("quality < 0").select("source_id", "grp")
    near = a.where(geo.in_bounds(F.col("latitude"), F.col("longitude"), south, north, west, east)).withColumn("d", geo.haversine_m(F.lit(5.0), F.lit(30.0), F.col("latitude"), F.col("longitude"))).where("d <= 6000000")
    return top_per_key(without(near, seen, "source_id", "grp"), ["grp"], [F.col("d").asc(), F.col("source_id").asc()]).select("source_id", "grp", F.round("d", 2).alias("distance_m"))


@register(f"""WITH {_A}, {_B}, n AS (SELECT source_id, b_id, 6371000 * sqrt(pow(radians(b_lat - latitude), 2) + pow(cos(radians((b_lat + latitude) / 2)) * radians(b_lon - longitude), 2)) AS d, b_quality,
 degrees(atan2(sin(radians(longitude - b_lon)) * cos(radians(latitude)), cos(radians(b_lat)) * sin(radians(latitude)) - sin(radians(b_lat)) * cos(radians(latitude)) * cos(radians(longitude - b_lon)))) AS bearing FROM a JOIN b ON abs(b_lat - latitude) <= 0.005 AND abs(b_lon - longitude) <= 0.007),
s AS (SELECT *, (1 - least(1, d / 500.0)) * 0.55 + (1 - least(1, abs((200.0 - bearing + 540) % 360 - 180) / 180.0)) * 0.25 + 0.5 * 0.20 AS score FROM n WHERE d <= 500)
SELECT source_id, b_id, round(d, 3) AS distance_m, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, d, b_id) AS rn FROM s) WHERE rn <= 3""")
def photo_candidates(spark, sf_dir):
    """Pictures near a place by distance, heading and quality, with fixed weights; the band join runs on grid cells as large as the band."""
    a, b = source_a(spark, sf_dir), source_b(spark, sf_dir)
    band = (F.abs(F.col("b_lat") - F.col("latitude")) <= 0.005) & (F.abs(F.col("b_lon") - F.col("longitude")) <= 0.007)
    pairs = grid_join(b, a, ("b_lat", "b_lon"), ("latitude", "longitude"), 1 / 0.007, band)
    d = 6371000 * F.sqrt(F.pow(F.radians(F.col("b_lat") - F.col("latitude")), 2) + F.pow(F.cos(F.radians((F.col("b_lat") + F.col("latitude")) / 2)) * F.radians(F.col("b_lon") - F.col("longitude")), 2))
    error = geo.angle_between_deg(F.lit(200.0), geo.bearing_deg(F.col("b_lat"), F.col("b_lon"), F.col("latitude"), F.col("longitude")))
    s = pairs.withColumn("d", d).where("d <= 500").withColumn("score", (1 - F.least(F.lit(1.0), F.col("d") / 500.0)) * 0.55 + (1 - F.least(F.lit(1.0), error / 180.0)) * 0.25 + 0.5 * 0.20)
    return top_per_key(s, ["source_id"], [F.col("score").desc(), F.col("d").asc(), F.col("b_id").asc()], 3).select("source_id", "b_id", F.round("d", 3).alias("distance_m"), F.round("score", 6).alias("score"))


@register("""WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40), c AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT o_orderkey, c_name, count(l_partkey) AS n_shown, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY rn) AS parts FROM p LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN c ON o_orderkey = l_orderkey AND rn <= 3 GROUP BY 1, 2""")
def feed_hydration(spark, sf_dir):
    """A page of ids first, then its owners and the first three lines of each: wide columns join only the page."""
    o, c, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select("c_custkey", "c_name"), load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    page = o.select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(40)
    lines = top_per_key(li.join(F.broadcast(page.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi"), ["l_orderkey"], [F.col("l_linenumber").asc(), F.col("l_partkey").asc(), F.col("l_suppkey").asc()], 3)
    shown = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))
    return page.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(shown, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_shown"), "parts")


@register(f"""WITH {_A}, i AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY quality DESC) AS r1 FROM a), g AS (SELECT *, row_number() OVER (PARTITION BY name_key, nation ORDER BY floor(quality / 1000) DESC, source_id) AS r2 FROM i WHERE r1 = 1)
SELECT source_id, name_key, nation FROM g WHERE r2 = 1 ORDER BY floor(quality / 1000) DESC, source_id LIMIT 60""")
def rerank_two_keys(spark, sf_dir):
    """Deduped by id, then by group, then the best 60."""
    a = source_a(spark, sf_dir).withColumn("band", F.floor(F.col("quality") / 1000))
    one = top_per_key(a, ["source_id"], [F.col("quality").desc()])
    two = top_per_key(one, ["name_key", "nation"], [F.col("band").desc(), F.col("source_id").asc()])
    return two.orderBy(F.col("band").desc(), "source_id").limit(60).select("source_id", "name_key", "nation")


@register("""WITH t AS (SELECT l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1 ORDER BY best DESC, l_partkey LIMIT 20), r AS (SELECT l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem)
SELECT l_partkey, l_suppkey, l_extendedprice, rn FROM r JOIN t USING (l_partkey) WHERE rn <= 9""")
def fair_targets(spark, sf_dir):
    """Twenty targets, then up to nine fallbacks of each."""
    li = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    t = li.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("best")).orderBy(F.col("best").desc(), "l_partkey").limit(20).select("l_partkey")
    w = Window.partitionBy("l_partkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return li.join(F.broadcast(t), "l_partkey", "left_semi").withColumn("rn", F.row_number().over(w)).where("rn <= 9").select("l_partkey", "l_suppkey", "l_extendedprice", "rn")


@register(f"""WITH {_A}, z AS (SELECT CAST(floor((longitude + 180.0) / 360.0 * 64) AS BIGINT) AS tx, CAST(greatest(0, least(63, floor((1 - ln(tan(p) + 1 / cos(p)) / pi()) / 2 * 64))) AS BIGINT) AS ty, latitude, longitude FROM (SELECT *, radians(greatest(-85.05112878, least(85.05112878, latitude))) AS p FROM a))
SELECT tx, ty, count(*) AS n, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM z WHERE tx BETWEEN 20 AND 50 AND ty BETWEEN 10 AND 50 GROUP BY 1, 2 ORDER BY n DESC, tx, ty LIMIT 200""")
def save_heatmap(spark, sf_dir):
    """Densest tiles of a view with their centroids."""
    a = source_a(spark, sf_dir)
    x, y = geo.mercator_tile(F.col("latitude"), F.col("longitude"), F.lit(6))
    t = a.select(x.cast("long").alias("tx"), y.cast("long").alias("ty"), "latitude", "longitude").where("tx BETWEEN 20 AND 50 AND ty BETWEEN 10 AND 50")
    return t.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon")).orderBy(F.col("n").desc(), "tx", "ty").limit(200)


@register(f"""WITH {_A}, t AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS level, latitude, longitude FROM a),
c AS MATERIALIZED (SELECT level, CAST(floor((latitude + 90) / (32.0 / (1 << level))) AS BIGINT) AS ty, CAST(floor((longitude + 180) / (32.0 / (1 << level))) AS BIGINT) AS tx, count(*) AS n FROM t GROUP BY ALL),
f AS MATERIALIZED (SELECT level AS fl, ty AS fy, tx AS fx FROM c WHERE n > 12),
k AS (SELECT *, level - 1 AS fl, CAST(floor(ty / 2) AS BIGINT) AS fy, CAST(floor(tx / 2) AS BIGINT) AS fx FROM c WHERE n <= 12 OR level = 6)
SELECT level, ty, tx, n FROM k WHERE level = 0 UNION ALL SELECT level, ty, tx, n FROM k JOIN f USING (fl, fy, fx) WHERE level > 0""")
def adaptive_shards(spark, sf_dir):
    return split_tiles(source_a(spark, sf_dir), "latitude", "longitude", 12)


@register(f"""WITH {_A}, s AS (SELECT nation, min(latitude) / 30 AS s, max(latitude) / 30 AS n, min(longitude) / 30 AS w, max(longitude) / 30 AS e FROM a GROUP BY 1), y AS (SELECT nation, unnest(range(CAST(floor(s + 90) AS BIGINT), CAST(floor(n + 90) AS BIGINT) + 1)) AS tile_y, w, e FROM s),
x AS (SELECT nation, tile_y, unnest(range(CAST(floor(w + 180) AS BIGINT), CAST(floor(e + 180) AS BIGINT) + 1)) AS tile_x FROM y) SELECT tile_y, tile_x, string_agg(CAST(nation AS VARCHAR), ',' ORDER BY nation) AS keys FROM x GROUP BY 1, 2""")
def shard_routing(spark, sf_dir):
    """Which shards a one-degree tile has to read."""
    a = source_a(spark, sf_dir)
    s = a.groupBy("nation").agg((F.min("latitude") / 30).alias("s"), (F.max("latitude") / 30).alias("n"), (F.min("longitude") / 30).alias("w"), (F.max("longitude") / 30).alias("e"))
    return routing_directory(s, "nation", ("s", "n", "w", "e")).select("tile_y", "tile_x", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@register("""WITH x AS (SELECT c_nationkey AS k, list_distinct(list(c_mktsegment || CAST(c_custkey % 4 AS VARCHAR))) AS v FROM customer WHERE c_acctbal > 0 GROUP BY 1), y AS (SELECT c_nationkey AS k, list_distinct(list(c_mktsegment || CAST(c_custkey % 4 AS VARCHAR))) AS v FROM customer WHERE c_acctbal < 5000 GROUP BY 1)
SELECT k, round(len(list_intersect(x.v, y.v)) / greatest(len(x.v), len(y.v)), 6) AS overlap FROM x JOIN y USING (k)""")
def backend_overlap(spark, sf_dir):
    """Shared share of two result sets."""
    c = load(spark, sf_dir, "customer").withColumn("v", F.concat("c_mktsegment", (F.col("c_custkey") % 4).cast("string")))
    x = c.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set("v").alias("x"))
    y = c.where("c_acctbal < 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set("v").alias("y"))
    return x.join(y, "k").select("k", F.round(F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y")), 6).alias("overlap"))


@register("SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_orderdate = f), min(o_orderkey) FILTER (o_orderdate = l)) AS next_order FROM (SELECT *, min(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderdate END) OVER (PARTITION BY o_custkey) AS f, min(o_orderdate) OVER (PARTITION BY o_custkey) AS l FROM orders) GROUP BY 1")
def next_plan(spark, sf_dir):
    """The first to come, else the first of all."""
    o = load(spark, sf_dir, "orders")
    past = F.when(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), 0).otherwise(1)
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(past, "o_orderdate", "o_orderkey")).alias("next_order"))


@register("SELECT event_id, CASE WHEN (event_id * 37) % 1440 >= 540 AND (event_id * 37) % 1440 < 1020 THEN true ELSE event_id % 5 = 2 OR (event_id % 5 = 1 AND ((event_id * 37) % 1440 >= 1200 OR (event_id * 37) % 1440 < 120)) OR event_id % 5 = 4 END AND NOT (event_id % 5 = 3) AND NOT (event_id % 5 = 1 AND (event_id * 37) % 1440 BETWEEN 120 AND 1199) AS is_open FROM events")
def open_now(spark, sf_dir):
    """Opening hours in five spellings at a minute of the day."""
    hours = F.element_at(F.array(*[F.lit(x) for x in ("9:00 am - 5 pm", "8 pm - 2 am", "Open 24 hours", "closed", "by request")]), (F.col("event_id") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", moments.open_at(hours, F.col("event_id") * 37 % 1440).alias("is_open"))


@register("""WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: x <> '')) AS l, list_distinct(string_split(lower(p_name), ' ')) AS r, lower(p_name) AS n FROM part),
g AS (SELECT *, list_distinct(list_transform(range(1, length(n) + 1), lambda i: substr(' ' || n || ' ', i, 3))) AS gn, list_distinct(list_transform(range(1, 11), lambda i: substr(' red widget ', i, 3))) AS gq FROM t)
SELECT p_partkey, round(len(list_intersect(l, r)) / len(l), 6) AS overlap, round(2.0 * len(list_intersect(gn, gq)) / (len(gn) + len(gq)), 6) AS dice FROM g""")
def text_similarity(spark, sf_dir):
    n = text.search_text(F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(text.token_overlap(F.concat_ws(" ", "p_name", "p_type"), F.col("p_name")), 6).alias("overlap"), F.round(text.dice(text.trigrams(n), text.trigrams(F.lit("red widget"))), 6).alias("dice"))


@register("SELECT 'a' AS src, c_custkey AS k, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL BY NAME SELECT 'b' AS src, s_suppkey AS k, s_acctbal AS balance FROM supplier")
def union_by_name(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.lit("a").alias("src"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(load(spark, sf_dir, "supplier").select(F.lit("b").alias("src"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@register("SELECT user_id, least(25, sum(CASE event_type WHEN 'purchase' THEN 4 WHEN 'click' THEN 1 ELSE 0 END))::BIGINT AS capped, least(12, count(*) FILTER (event_type = 'signup') * 2) AS signups, round(sum(value * 1.5) / greatest(1, sqrt(count(*))), 3) AS affinity FROM events GROUP BY 1")
def behaviour_caps(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    w = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "click", 1).otherwise(0)
    return e.groupBy("user_id").agg(F.least(F.lit(25), F.sum(w)).alias("capped"), F.least(F.lit(12), F.count_if(F.col("event_type") == "signup") * 2).alias("signups"), F.round(F.sum(F.col("value") * 1.5) / F.greatest(F.lit(1.0), F.sqrt(F.count("*"))), 3).alias("affinity"))
