"""Queries of a place catalogue: filtered search, resolving sources, photos and claims, recommendations, social lists, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, hashing, moments, text
from ..operators import catalogue as op
from ..operators.gridjoin import grid_join
from ..operators.relational import top_per_key, without
from .places import _A, _B, load, source_a, source_b, viewport_cap

NOW = "2024-02-01 00:00:00"
QUERIES, ORACLE_SQL = {}, {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def venues(spark, sf_dir) -> DataFrame:
    """Parts as places with status, price, amenities, quality, popularity, photo and position."""
    key = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        key.alias("id"), F.lower("p_name").alias("name"), F.lower("p_type").alias("category"), (F.col("p_size") % 4 + 1).alias("price"),
        F.when(F.col("p_size") % 10 == 0, "draft").otherwise("published").alias("status"), F.split(F.initcap("p_name"), " ").alias("amenities"),
        F.when(F.col("p_size") % 3 == 0, "yes").otherwise("no").alias("accessible"), ((key * 7919 % 18000).cast("double") / 100 - 90).alias("lat"),
        ((key * 104729 % 36000).cast("double") / 100 - 180).alias("lon"), (F.col("p_retailprice") / 2000).alias("quality"), (key % 17).cast("double").alias("popularity"), (key % 4 == 0).alias("photo"),
    )


_V = """v AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_type) AS category, p_size % 4 + 1 AS price, CASE WHEN p_size % 10 = 0 THEN 'draft' ELSE 'published' END AS status,
 string_split(lower(p_name), ' ') AS amenities, CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'no' END AS accessible, CAST((p_partkey * 7919) % 18000 AS DOUBLE) / 100 - 90 AS lat,
 CAST((p_partkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS lon, p_retailprice / 2000 AS quality, CAST(p_partkey % 17 AS DOUBLE) AS popularity, p_partkey % 4 = 0 AS photo FROM part)"""


def _ladder(field: str, q: str, weight: float) -> str:
    return f"CASE WHEN {field} = '{q}' THEN {5 * weight} WHEN starts_with({field}, '{q}') THEN {3.6 * weight} WHEN contains(' ' || {field}, ' {q}') THEN {2.7 * weight} WHEN contains({field}, '{q}') THEN {2.1 * weight} ELSE 0.0 END"


def _away(lat: float, lon: float) -> str:
    h = f"(pow(sin(radians(lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin(radians(lon - {lon}) / 2), 2))"
    return f"12742008.8 * atan2(sqrt({h}), sqrt(greatest(1 - {h}, 0.0)))"


@register(f"""WITH {_V}, d AS (SELECT *, {_away(10.0, 20.0)} AS d, {_ladder("name", "ring", 5.0)} + {_ladder("category", "ring", 2.0)} AS t FROM v WHERE status = 'published' AND price = 2 AND list_contains(amenities, 'ring')),
s AS (SELECT *, t + greatest(0, quality) * 2 + popularity * 0.25 + CASE WHEN category IN ('economy', 'promo') THEN 1.8 ELSE 0 END + CASE WHEN photo THEN 1 ELSE 0 END + 2.5 * greatest(0.0, 1 - d / 9000000.0) AS score FROM d WHERE d <= 9000000 AND t > 0)
SELECT id, round(d, 3) AS distance_m, round(score, 6) AS score FROM s ORDER BY s.score DESC, d, id LIMIT 40""")
def search_filtered(spark, sf_dir, request: dict | None = None):
    """Status, price, exact amenity and radius, then text, quality, popularity, preference, photo and distance by their weights."""
    r = {"price": "2", "amenity": "RING", "radius_m": 9_000_000.0, "limit": None, "q": "ring"} | (request or {})
    radius, amenity = op.clamp(r["radius_m"], 1000.0, 20_000_000.0, 25_000.0), r["amenity"].lower()
    south, north, west, east = geo.radius_box(10.0, 20.0, radius)
    v = venues(spark, sf_dir).where((F.col("status") == "published") & (F.col("price") == int(r["price"])) & F.exists("amenities", lambda a: F.lower(a) == amenity))
    v = v.where(geo.in_bounds(F.col("lat"), F.col("lon"), south, north, west, east)).withColumn("d", geo.haversine_m(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lon")))
    v = v.withColumn("t", text.field_score(text.search_text(F.col("name")), r["q"], 5.0) + text.field_score(text.search_text(F.col("category")), r["q"], 2.0)).where((F.col("d") <= radius) & (F.col("t") > 0))
    # The weights of quality, popularity, a preferred category, a photo and nearness.
    score = F.col("t") + F.greatest(F.lit(0), F.col("quality")) * 2 + F.col("popularity") * 0.25 + F.when(F.col("category").isin("economy", "promo"), 1.8).otherwise(0) + F.when(F.col("photo"), 1).otherwise(0)
    v = v.withColumn("score", score + 2.5 * F.greatest(F.lit(0.0), 1 - F.col("d") / radius)).orderBy(F.col("score").desc(), "d", "id")
    return v.limit(op.clamp(r["limit"], 1, 100, 40)).select("id", F.round("d", 3).alias("distance_m"), F.round("score", 6).alias("score"))


@register(f"WITH {_V} SELECT id FROM v WHERE contains(name || ' ' || category, 'in') AND len(list_filter(amenities, lambda a: contains(a, 'lu'))) > 0 AND accessible IN ('yes', '1', 'true')")
def search_substring(spark, sf_dir):
    """Query and amenity as substrings, accessibility as one of three words."""
    v = venues(spark, sf_dir).where(F.contains(F.concat_ws(" ", "name", "category"), F.lit("in")) & F.exists("amenities", lambda a: F.contains(F.lower(a), F.lit("lu"))))
    return v.where(F.lower("accessible").isin("yes", "1", "true")).select("id")


@register(f"""WITH {_A}, t AS (SELECT *, row_number() OVER (PARTITION BY floor((latitude + 90) / 30.0), floor((longitude + 180) / 30.0) ORDER BY quality DESC, source_id) AS rn FROM a)
SELECT source_id, quality FROM t WHERE rn <= 200 AND latitude BETWEEN -60 AND 60 AND (longitude >= 100 OR longitude <= -20) ORDER BY quality DESC, source_id LIMIT 80""")
def viewport_pyramid(spark, sf_dir, zoom: int = 5):
    """Below zoom 8 a view is answered from the best 200 places of each tile, above from all places."""
    a = source_a(spark, sf_dir)
    if zoom < 8:
        ty, tx = geo.degree_tile(F.col("latitude"), F.col("longitude"), 30.0)
        a = top_per_key(a.withColumns({"ty": ty, "tx": tx}), ["ty", "tx"], [F.col("quality").desc(), F.col("source_id").asc()], 200)
    seen = a.where(geo.in_bounds(F.col("latitude"), F.col("longitude"), -60.0, 60.0, 100.0, -20.0))
    return seen.orderBy(F.col("quality").desc(), "source_id").limit(viewport_cap(zoom)).select("source_id", "quality")


def matches(spark, sf_dir) -> DataFrame:
    """Places of both sources in neighbouring cells with one name and category, within 0.0015 degrees."""
    near = (F.abs(F.col("b_lat") - F.col("latitude")) <= 0.0015) & (F.abs(F.col("b_lon") - F.col("longitude")) <= 0.0015)
    return grid_join(source_b(spark, sf_dir), source_a(spark, sf_dir), ("b_lat", "b_lon"), ("latitude", "longitude"), 1000.0, near, (("b_key", "name_key"), ("b_category", "category")))


_M = """m AS (SELECT a.*, b.* FROM b JOIN a ON b_key = name_key AND b_category = category AND abs(b_lat - latitude) <= 0.0015 AND abs(b_lon - longitude) <= 0.0015
 AND abs(floor((b_lat + 90) * 1000.0) - floor((latitude + 90) * 1000.0)) <= 1 AND abs(floor((b_lon + 180) * 1000.0) - floor((longitude + 180) * 1000.0)) <= 1)"""


@register(f"WITH {_A}, {_B}, {_M} SELECT source_id, b_id, b_quality FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY b_quality DESC, b_id) AS rn FROM m) WHERE rn = 1")
def best_b_per_a(spark, sf_dir):
    """The best match of the other source for each place."""
    return top_per_key(matches(spark, sf_dir), ["source_id"], [F.col("b_quality").desc(), F.col("b_id").asc()]).select("source_id", "b_id", "b_quality")


@register(f"""WITH {_A}, {_B}, {_M}, w AS (SELECT source_id AS id, b_id AS other FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY b_quality DESC, b_id) AS rn FROM m) WHERE rn = 1),
x AS (SELECT source_id AS id, name_key, category, quality FROM a WHERE quality > 0), y AS (SELECT coalesce(id, b_id) AS id, b_key AS name_key, b_category AS category, b_quality AS quality FROM b LEFT JOIN w ON other = b_id)
SELECT coalesce(x.id, y.id) AS id, coalesce(x.name_key, y.name_key) AS name_key, coalesce(x.category, y.category) AS category, coalesce(x.quality, y.quality) AS quality,
 concat_ws(',', CASE WHEN x.id IS NOT NULL THEN 'a' END, CASE WHEN y.id IS NOT NULL THEN 'b' END) AS sources FROM x FULL JOIN y ON x.id = y.id""")
def resolve_merge(spark, sf_dir):
    """Both sources under one id: a matched row of the second takes the first one's; of each field the first source's value, else the second's."""
    best = best_b_per_a(spark, sf_dir).select(F.col("source_id").alias("own"), F.col("b_id"))
    a = source_a(spark, sf_dir).where("quality > 0").select(F.col("source_id").alias("id"), "name_key", "category", "quality")
    b = source_b(spark, sf_dir).join(best, "b_id", "left").select(F.coalesce("own", "b_id").alias("id"), F.col("b_key").alias("name_key"), F.col("b_category").alias("category"), F.col("b_quality").alias("quality"))
    return op.merged(a, b, "id", ["name_key", "category", "quality"])


@register("""SELECT o_orderpriority AS source, o_custkey AS source_id, o_orderkey AS location FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def resolve_crosswalk(spark, sf_dir):
    """One place for each id of each source: the latest, then the surest, then the least."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("location"), "o_orderdate", "o_totalprice")
    return top_per_key(o, ["source", "source_id"], [F.col("o_orderdate").desc(), F.col("o_totalprice").desc(), F.col("location").asc()]).select("source", "source_id", "location")


@register("""WITH RECURSIVE l AS (SELECT c_custkey AS old, c_custkey // 3 AS new FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey <> c_custkey // 3), r AS (SELECT old, new FROM l UNION ALL SELECT r.old, l.new FROM r JOIN l ON r.new = l.old)
SELECT old, new FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.old = r.new)""")
def resolve_aliases(spark, sf_dir):
    """Superseded ids with their last successors, through chains."""
    key = F.col("c_custkey")
    return op.aliases(load(spark, sf_dir, "customer").where(key % 5 != 0).select(key.alias("old"), F.floor(key / 3).alias("new")), "old", "new")


_PHOTO = "SELECT l_partkey AS place, l_orderkey * 10 + l_linenumber AS photo, l_linestatus = 'F' AS main, CASE l_returnflag WHEN 'A' THEN 'venue' WHEN 'N' THEN 'provider' ELSE 'other' END AS source, l_linenumber AS sort, l_shipdate AS verified, l_suppkey AS supplier FROM lineitem"


def photos(spark, sf_dir) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_returnflag") == "A", "venue").when(F.col("l_returnflag") == "N", "provider").otherwise("other")
    return li.select(F.col("l_partkey").alias("place"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("photo"), (F.col("l_linestatus") == "F").alias("main"), source.alias("source"), F.col("l_linenumber").alias("sort"), F.col("l_shipdate").alias("verified"), F.col("l_suppkey").alias("supplier"))


@register(f"""SELECT place, photo, supplier FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY main DESC, CASE source WHEN 'venue' THEN 0 WHEN 'provider' THEN 2 ELSE 9 END, sort, verified DESC, photo, supplier) AS rn FROM ({_PHOTO})) WHERE rn = 1""")
def primary_photo(spark, sf_dir):
    """A place's photo: marked ones first, then by kind of source, order and age."""
    kind = F.when(F.col("source") == "venue", 0).when(F.col("source") == "provider", 2).otherwise(9)
    order = [F.col("main").desc(), kind.asc(), F.col("sort").asc(), F.col("verified").desc(), F.col("photo").asc(), F.col("supplier").asc()]
    return op.best_photos(photos(spark, sf_dir), "place", order).select("place", "photo", "supplier")


@register(f"""WITH r AS (SELECT place, photo, supplier, CASE WHEN place % 3 = 0 THEN CASE source WHEN 'provider' THEN 0 WHEN 'venue' THEN 1 ELSE 3 END ELSE CASE source WHEN 'venue' THEN 0 WHEN 'provider' THEN 1 ELSE 3 END END AS provider_rank, sort FROM ({_PHOTO})
 WHERE place NOT IN (SELECT p_partkey FROM part WHERE p_size > 40))
SELECT place, photo, supplier, provider_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY provider_rank, sort DESC, photo, supplier) AS rank FROM r) WHERE rank <= 4""")
def provider_rank(spark, sf_dir):
    """Candidates of places without a photo, by a provider order that depends on the place's kind; four of each."""
    done = load(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("place"))
    a, b = (F.when(F.col("source") == x, 0).when(F.col("source") == y, 1).otherwise(3) for x, y in (("provider", "venue"), ("venue", "provider")))
    r = without(photos(spark, sf_dir), done, "place").withColumn("provider_rank", F.when(F.col("place") % 3 == 0, a).otherwise(b))
    return op.best_photos(r, "place", [F.col("provider_rank").asc(), F.col("sort").desc(), F.col("photo").asc(), F.col("supplier").asc()], 4).select("place", "photo", "supplier", "provider_rank", "rank")


@register(f"""SELECT place, photo, supplier, CASE WHEN rn = 1 THEN 'approved' ELSE 'expired' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY main DESC, nullif(verified, TIMESTAMP '1999-01-01') DESC NULLS LAST, sort, supplier DESC, photo) AS rn FROM ({_PHOTO}))""")
def keep_best(spark, sf_dir):
    """All but the best photo of a place expire; five keys, nulls last."""
    verified = F.nullif(F.col("verified"), F.lit("1999-01-01").cast("timestamp_ntz"))
    w = Window.partitionBy("place").orderBy(F.col("main").desc(), verified.desc_nulls_last(), "sort", F.col("supplier").desc(), "photo")
    return photos(spark, sf_dir).select("place", "photo", "supplier", F.when(F.row_number().over(w) == 1, "approved").otherwise("expired").alias("status"))


@register("""WITH c AS (SELECT c_custkey AS id, c_nationkey * 100 + c_custkey % 60 AS place, sha256(c_mktsegment || CAST(c_custkey % 211 AS VARCHAR)) AS bytes,
 xor(('0x' || substr(sha256(CAST(c_custkey % 90 AS VARCHAR)), 1, 16))::UBIGINT, ((1::UBIGINT << (c_custkey % 9)::UBIGINT) - 1::UBIGINT)) AS fp, xor(('0x' || substr(sha256('x' || CAST(c_custkey % 45 AS VARCHAR)), 1, 16))::UBIGINT, ((1::UBIGINT << (c_custkey % 15)::UBIGINT) - 1::UBIGINT)) AS fc FROM customer),
x AS (SELECT id, 0 AS stage, min(id) OVER (PARTITION BY place) AS other FROM c UNION ALL SELECT id, 1, min(id) OVER (PARTITION BY bytes) FROM c
 UNION ALL SELECT a.id, 2, min(b.id) FROM (SELECT min(id) AS id, fp, fc FROM c GROUP BY fp, fc) a JOIN (SELECT min(id) AS id, fp, fc FROM c GROUP BY fp, fc) b ON b.id < a.id AND bit_count(xor(a.fp, b.fp)) <= 5 AND bit_count(xor(a.fc, b.fc)) <= 10 GROUP BY 1)
SELECT id, arg_min(stage, stage) AS stage, arg_min(other, stage) AS other FROM x WHERE id <> other GROUP BY 1""")
def photo_claims(spark, sf_dir):
    """Claims in the order of their ids: the place is taken, the bytes are known, or the picture is near one that is."""
    key = F.col("c_custkey")
    bits = lambda n: F.expr(f"shiftleft(1L, CAST(c_custkey % {n} AS INT)) - 1L")
    c = load(spark, sf_dir, "customer").select(
        key.alias("id"), (F.col("c_nationkey") * 100 + key % 60).alias("place"), F.sha2(F.concat("c_mktsegment", (key % 211).cast("string")), 256).alias("bytes"),
        hashing.fingerprint64((key % 90).cast("string")).bitwiseXOR(bits(9)).alias("fp"), hashing.fingerprint64(F.concat(F.lit("x"), (key % 45).cast("string"))).bitwiseXOR(bits(15)).alias("fc"),
    )
    return op.conflicts(c, "id", "id", ["place", "bytes"], "fp", "fc")


@register(f"""WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'signup') AS since, max(ts) FILTER (event_type = 'purchase') AS live FROM events GROUP BY 1)
SELECT user_id, CASE WHEN live >= since AND live <= since + INTERVAL 15 MINUTE THEN 'live' WHEN TIMESTAMP '{NOW}' > since + INTERVAL 15 MINUTE THEN 'expired' ELSE 'pending' END AS state, since FROM l WHERE since IS NOT NULL""")
def lease_states(spark, sf_dir):
    """Pending, live and expired leases at a moment."""
    kind = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "purchase", "live")
    e = load(spark, sf_dir, "events").select("user_id", "ts", kind.alias("kind"))
    return op.leases(e, "user_id", "ts", "kind", F.lit(NOW).cast("timestamp_ntz"))


@register("""WITH s AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) FILTER (l_suppkey % 7 = 0) AS f FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT 'place' AS kind, p_partkey AS id, coalesce(n, 0) AS n, coalesce(f, 0) AS f, p_size < 10 AS near FROM part LEFT JOIN s ON l_partkey = p_partkey UNION ALL SELECT 'event', s_suppkey, coalesce(n, 0), 0, s_acctbal > 5000 FROM supplier LEFT JOIN t ON l_suppkey = s_suppkey)
SELECT kind, id, round(least(1.0, ln(1 + n) / 8.0), 6) AS popularity, round(least(1.0, f / 5.0), 6) AS friend_score, concat_ws(',', CASE WHEN near THEN 'proximity' END, CASE WHEN f > 0 THEN 'friend_activity' END, CASE WHEN n > 0 THEN 'popularity' END) AS tags FROM r""")
def recommendation_pool(spark, sf_dir):
    """Places and events in one pool with popularity, friends' activity and what speaks for each; engagement is aggregated before the joins."""
    li = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    places = li.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("l_suppkey") % 7 == 0, F.col("l_suppkey"))).alias("f"))
    events = li.groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("f"))
    p = load(spark, sf_dir, "part").select(F.lit("place").alias("kind"), F.col("p_partkey").alias("id"), (F.col("p_size") < 10).alias("near")).join(places, "id", "left")
    s = load(spark, sf_dir, "supplier").select(F.lit("event").alias("kind"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 5000).alias("near")).join(events, "id", "left")
    n, f = F.coalesce("n", F.lit(0)), F.coalesce("f", F.lit(0))
    tags = F.concat_ws(",", F.when(F.col("near"), "proximity"), F.when(f > 0, "friend_activity"), F.when(n > 0, "popularity"))
    return p.unionByName(s).select("kind", "id", F.round(F.least(F.lit(1.0), F.ln(1 + n) / 8.0), 6).alias("popularity"), F.round(F.least(F.lit(1.0), f / 5.0), 6).alias("friend_score"), tags.alias("tags"))


_SIGNALS = (("purchase", 5.0, 25.0), ("signup", 2.0, 12.0), ("click", 1.0, 8.0), ("view", 0.25, 4.0), ("error", -3.0, -9.0))


@register("WITH s AS (" + " UNION ALL ".join(f"SELECT user_id, '{k}' AS signal, {'least' if w > 0 else 'greatest'}({cap}::DOUBLE, count(*) * {w}::DOUBLE) AS capped FROM events WHERE event_type = '{k}' GROUP BY 1" for k, w, cap in _SIGNALS) + """
 UNION ALL SELECT o_custkey, 'order', least(30.0::DOUBLE, count(*) * 3.0::DOUBLE) FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'urgent', least(6.0::DOUBLE, count(*) * 1.5::DOUBLE) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1
 UNION ALL SELECT o_custkey, 'returned', greatest(-5.0::DOUBLE, count(*) * -0.5::DOUBLE) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT user_id, round(sum(capped), 4) AS score, count(*) AS n_signals, round(coalesce(sum(capped) FILTER (capped < 0), 0), 4) AS negative FROM s GROUP BY 1""")
def behaviour_signals(spark, sf_dir):
    """A user's signals from several tables, each kind with its weight and cap, negative ones apart. One pass a table: kinds are keys."""
    e, o, li = (load(spark, sf_dir, t) for t in ("events", "orders", "lineitem"))
    by_type = e.groupBy("user_id", F.col("event_type").alias("signal")).agg(F.count("*").alias("n"))
    orders = o.select(F.col("o_custkey").alias("user_id"), F.explode(F.array_compact(F.array(F.lit("order"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent")))).alias("signal")).groupBy("user_id", "signal").agg(F.count("*").alias("n"))
    back = o.join(li.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n")).withColumn("signal", F.lit("returned"))
    weight, capped = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, w, cap in (*_SIGNALS, ("order", 3.0, 30.0), ("urgent", 1.5, 6.0), ("returned", -0.5, -5.0)):
        weight = F.when(F.col("signal") == k, w).otherwise(weight)
        capped = F.when(F.col("signal") == k, F.least(F.lit(cap), F.col("n") * w) if w > 0 else F.greatest(F.lit(cap), F.col("n") * w)).otherwise(capped)
    s = by_type.unionByName(orders).unionByName(back).withColumn("capped", capped).where(F.col("capped").isNotNull())
    return s.groupBy("user_id").agg(F.round(F.sum("capped"), 4).alias("score"), F.count("*").alias("n_signals"), F.round(F.coalesce(F.sum(F.when(F.col("capped") < 0, F.col("capped"))), F.lit(0)), 4).alias("negative"))


@register("""WITH k AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey), f AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)),
n AS (SELECT f.a, f.b, count(*) AS common FROM f JOIN k x ON x.o_custkey = f.a JOIN k y ON y.o_custkey = f.b AND x.l_partkey = y.l_partkey GROUP BY 1, 2),
c AS (SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1)
SELECT f.a, f.b, coalesce(common, 0) AS common, last_turn, last_role FROM f LEFT JOIN n ON n.a = f.a AND n.b = f.b LEFT JOIN c ON conv_id = f.a""")
def friends_list(spark, sf_dir):
    """Friends with the number of common places and the last message of their conversation; places are joined only along friendships."""
    o, li = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    k = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    f = c.join(c.select((F.col("a") - 1).alias("a")), "a").withColumn("b", F.col("a") + 1)
    mine = f.join(k.select(F.col("o_custkey").alias("a"), "l_partkey"), "a")
    n = mine.join(k.select(F.col("o_custkey").alias("b"), "l_partkey"), ["b", "l_partkey"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    talk = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("a")).agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))
    return f.join(n, ["a", "b"], "left").join(talk, "a", "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"), "last_turn", "last_role")


@register("""WITH e AS (SELECT l_partkey, l_suppkey, count(*) AS votes, max(l_shipdate) AS last, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber) AS evidence FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, last DESC, l_suppkey) AS rn FROM e WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 0))
SELECT l_partkey, l_suppkey, votes, evidence FROM r WHERE rn = 1""")
def candidate_claim(spark, sf_dir):
    """For each place the candidate with most votes that isn't barred, with the evidence in order."""
    li = load(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    barred = load(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    proof = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"].cast("string")), ",")
    e = without(li, barred, "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("votes"), F.max("l_shipdate").alias("last"), proof.alias("evidence"))
    return top_per_key(e, ["l_partkey"], [F.col("votes").desc(), F.col("last").desc(), F.col("l_suppkey").asc()]).select("l_partkey", "l_suppkey", "votes", "evidence")


@register("""WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS kinds FROM events GROUP BY 1) SELECT user_id, list_contains(kinds, 'purchase') AS buys, list_has_any(kinds, ['signup', 'error']) AS either, len(list_intersect(kinds, ['click', 'view', 'signup'])) AS n FROM u""")
def array_overlap(spark, sf_dir):
    """Membership in and overlap with a user's kinds of events."""
    u = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    words = lambda *w: F.array(*map(F.lit, w))
    return u.select("user_id", F.array_contains("kinds", "purchase").alias("buys"), F.arrays_overlap("kinds", words("signup", "error")).alias("either"), F.size(F.array_intersect("kinds", words("click", "view", "signup"))).cast("long").alias("n"))


@register("""WITH e AS (SELECT event_id, CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '[0-9]+') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events)
SELECT event_id, k, s_name FROM e LEFT JOIN supplier ON s_suppkey = k""")
def json_key_join(spark, sf_dir):
    """A join through a number within JSON, where it is one."""
    k = F.get_json_object("props", "$.k")
    e = load(spark, sf_dir, "events").select("event_id", F.when(k.rlike("^[0-9]+$"), k.try_cast("long")).alias("k"))
    return e.join(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k", "left").select("event_id", "k", "s_name")


@register("WITH o AS (SELECT avg(c_acctbal) AS mean, max(c_acctbal) AS top FROM customer) SELECT c_custkey, round((c_acctbal - mean) / top, 6) AS share FROM customer CROSS JOIN o WHERE c_acctbal > mean")
def origin_cross(spark, sf_dir):
    """Rows against a one-row relation of parameters."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    one = c.agg(F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("top"))
    return c.crossJoin(F.broadcast(one)).where("c_acctbal > mean").select("c_custkey", F.round((F.col("c_acctbal") - F.col("mean")) / F.col("top"), 6).alias("share"))


@register(f"""WITH {_A}, t AS (SELECT source_id, CAST(floor((longitude + 180) / 6) AS BIGINT) AS x, CAST(floor((latitude + 90) / 6) AS BIGINT) AS y, quality FROM a)
SELECT l.source_id AS a, r.source_id AS b FROM t l JOIN t r ON abs(l.x - r.x) <= 1 AND abs(l.y - r.y) <= 1 AND l.source_id < r.source_id AND l.quality > 0 AND r.quality > 0""")
def tile_neighbours(spark, sf_dir):
    """Pairs of places in the same or adjoining tiles."""
    y, x = geo.degree_tile(F.col("latitude"), F.col("longitude"), 6.0)
    t = source_a(spark, sf_dir).where("quality > 0").select("source_id", x.alias("x"), y.alias("y"))
    return op.tile_neighbours(t, "source_id", "x", "y")


@register("WITH d AS (SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS bucket FROM documents), w AS (SELECT DISTINCT o_custkey AS doc_id, substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 3) AS bucket FROM orders) SELECT doc_id, bucket FROM d JOIN w USING (bucket, doc_id)")
def bucket_lookup(spark, sf_dir):
    """Documents by id through their hash bucket, which is a partition of a bucketed store."""
    key = lambda c: hashing.hash_bucket(F.col(c).cast("string")).alias("bucket")
    d = load(spark, sf_dir, "documents").select("doc_id", key("doc_id"))
    w = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key("o_custkey")).distinct()
    return d.join(w, ["bucket", "doc_id"]).select("doc_id", "bucket")


@register("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def nearest_rank(spark, sf_dir):
    """Percentiles that are values of the column."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"))


@register("SELECT event_id FROM events WHERE ('0x' || right(sha256(CAST(event_id AS VARCHAR)), 2))::INTEGER < 0.1 * 256")
def hash_tenth(spark, sf_dir):
    """A tenth of the events by the last byte of a hash of their ids: a sampling operator."""
    byte = F.conv(F.right(F.sha2(F.col("event_id").cast("string"), 256), F.lit(2)), 16, 10).cast("int")
    return load(spark, sf_dir, "events").where(byte < 0.1 * 256).select("event_id")


@register("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def first_wins(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return op.first_wins(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@register("""WITH r(kind, weight) AS (VALUES ('purchase', 4.0), ('click', 1.0), ('view', 0.25)) SELECT user_id, round(sum(CAST(weight AS DOUBLE)), 4) AS score FROM events JOIN r ON kind = event_type GROUP BY 1""")
def recordset(spark, sf_dir):
    """Weights given as a JSON record set, joined to events."""
    given = '[{"kind":"purchase","weight":4.0},{"kind":"click","weight":1.0},{"kind":"view","weight":0.25}]'
    r = spark.range(1).select(F.inline(F.from_json(F.lit(given), "array<struct<kind:string,weight:double>>")))
    return load(spark, sf_dir, "events").join(F.broadcast(r), F.col("kind") == F.col("event_type")).groupBy("user_id").agg(F.round(F.sum("weight"), 4).alias("score"))


@register("""WITH n AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 5 = 0 THEN '-beta' ELSE '.' || CAST(o_orderkey % 3 AS VARCHAR) END AS name FROM orders) SELECT max(name) AS release FROM n WHERE regexp_full_match(name, '[0-9]{4}-[0-9]{2}-[0-9]{2}\\.[0-9]+')""")
def latest_release(spark, sf_dir):
    """The greatest of the names that are releases."""
    key = F.col("o_orderkey")
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(key % 5 == 0, "-beta").otherwise(F.concat(F.lit("."), (key % 3).cast("string"))))
    return load(spark, sf_dir, "orders").select(name.alias("name")).where(F.col("name").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\.[0-9]+$")).agg(F.max("name").alias("release"))


_CAPTIONS = ("<b>CC BY-SA 3.0</b> by A", "CC0", "Public&nbsp;domain", "<i>CC&nbsp;BY</i>  2.5", "all rights &lt;reserved&gt;", "CC BY", "GFDL &amp; more")


@register(f"""WITH c AS (SELECT event_id, [{", ".join(repr(x) for x in _CAPTIONS)}][CAST(event_id % 7 + 1 AS INTEGER)] AS caption FROM events),
d AS (SELECT event_id, replace(replace(replace(replace(caption, '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&') AS t FROM c), s AS (SELECT event_id, trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM d),
l AS (SELECT *, CASE WHEN regexp_matches(plain, '^CC0(\\s|$)', 'i') THEN 'CC0-1.0' WHEN regexp_matches(plain, 'public domain', 'i') THEN 'public-domain' WHEN regexp_matches(plain, 'CC\\s*BY-SA', 'i') THEN 'CC-BY-SA-' || coalesce(nullif(regexp_extract(plain, '(\\d\\.\\d)', 1), ''), '4.0')
 WHEN regexp_matches(plain, 'CC\\s*BY', 'i') THEN 'CC-BY-' || coalesce(nullif(regexp_extract(plain, '(\\d\\.\\d)', 1), ''), '4.0') END AS licence FROM s)
SELECT event_id, plain, licence FROM l WHERE licence IS NOT NULL""")
def licensed_images(spark, sf_dir):
    """Images whose caption, without its markup, names an open licence."""
    caption = F.element_at(F.array(*map(F.lit, _CAPTIONS)), (F.col("event_id") % 7 + 1).cast("int"))
    plain = load(spark, sf_dir, "events").select("event_id", text.strip_html(caption).alias("plain"))
    return plain.withColumn("licence", text.open_licence(F.col("plain"))).where("licence IS NOT NULL")


@register("WITH p AS (SELECT p_partkey, ['Espresso and work', 'wine BAR', 'a walk', '', 'mini-golf', 'low key', 'special date'][CAST(p_partkey % 7 + 1 AS INTEGER)] AS q, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS category, p_size % 5 = 0 AS open, p_size % 2 = 0 AS accessible FROM part), w AS (SELECT *, lower(q || ' ' || category) AS t FROM p) SELECT p_partkey, CASE "
          + " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN '{name}'" for name, pattern in text.INTENTS)
          + " WHEN category <> '' THEN regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g') WHEN open THEN 'open_now' WHEN accessible THEN 'accessible' END AS intent FROM w")
def intent_buckets(spark, sf_dir):
    """What searches are about."""
    size = F.col("p_size")
    q = F.element_at(F.array(*map(F.lit, ("Espresso and work", "wine BAR", "a walk", "", "mini-golf", "low key", "special date"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", text.intent_bucket(q, F.when(size % 3 == 0, F.col("p_type")).otherwise(""), size % 5 == 0, size % 2 == 0).alias("intent"))


@register("""WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), t AS (SELECT name, left(name, length(name) - 1) || CASE WHEN right(name, 1) = 'x' THEN 'y' ELSE 'x' END AS typo FROM n) SELECT name, typo, levenshtein(name, typo) AS distance FROM t""")
def typo_queries(spark, sf_dir):
    """Names with a slip in the last letter, for testing a search."""
    n = load(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    return n.withColumn("typo", text.typo(F.col("name"))).withColumn("distance", F.levenshtein("name", "typo").cast("long"))


@register("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents WHERE text IS NOT NULL")
def folded_texts(spark, sf_dir):
    """Whole texts without marks."""
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.fold_marks(F.col("text")).cast("binary")).alias("folded"))


@register(f"WITH {_A} SELECT grp, count(*) AS n FROM (SELECT CASE WHEN quality < 0 THEN 'dup:' || CAST(nation AS VARCHAR) ELSE name_key || ':' || CAST(round(CAST(latitude AS DECIMAL(10, 4)), 1) AS DECIMAL(8, 1))::VARCHAR || ':' || CAST(round(CAST(longitude AS DECIMAL(10, 4)), 1) AS DECIMAL(8, 1))::VARCHAR END AS grp FROM a) GROUP BY 1")
def group_keys(spark, sf_dir):
    """Groups by a known duplicate, else by name and rounded place."""
    at = lambda c: F.round(F.col(c).cast("decimal(10,4)"), 1).cast("decimal(8,1)").cast("string")
    key = F.when(F.col("quality") < 0, F.concat(F.lit("dup:"), F.col("nation").cast("string"))).otherwise(F.concat_ws(":", "name_key", at("latitude"), at("longitude")))
    return source_a(spark, sf_dir).groupBy(key.alias("grp")).agg(F.count("*").alias("n"))


@register("SELECT o_orderkey, c_custkey IS NOT NULL AS found, c_name AS owner_name, c_mktsegment AS owner_segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_totalprice < 200000")
def embedded_struct(spark, sf_dir):
    """Orders with their owner as a nested record, null where there is none, and fields read from it."""
    owner = load(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("owner"))
    o = load(spark, sf_dir, "orders").where("o_orderstatus <> 'F' AND o_totalprice < 200000").join(owner, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("o_orderkey", F.col("owner").isNotNull().alias("found"), F.col("owner.name").alias("owner_name"), F.col("owner.segment").alias("owner_segment"))


@register("""WITH b AS (SELECT c_custkey, CAST(1950 + c_custkey % 60 AS VARCHAR) || '-' || lpad(CAST(c_custkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 33 AS VARCHAR), 2, '0') AS born FROM customer)
SELECT c_custkey, CAST(date_sub('year', try_cast(born AS DATE), DATE '2024-01-30') AS BIGINT) AS age FROM b""")
def ages(spark, sf_dir):
    """Whole years since a birth date; null where it isn't a day of the calendar."""
    key = F.col("c_custkey")
    two = lambda n: F.lpad((key % n).cast("string"), 2, "0")
    born = F.try_to_date(F.concat_ws("-", (1950 + key % 60).cast("string"), two(14), two(33)), "yyyy-MM-dd")
    return load(spark, sf_dir, "customer").select("c_custkey", F.floor(F.months_between(F.lit("2024-01-30").cast("date"), born) / 12).cast("long").alias("age"))


@register("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND (o_totalprice < 400000.0 OR (o_totalprice = 400000.0 AND o_orderkey > 7)) ORDER BY o_totalprice DESC, o_orderkey LIMIT 41")
def page_until_full(spark, sf_dir):
    """A page after a cursor with one row more; partners are joined and filtered before the cut, so that it is full."""
    c = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey").join(c, "o_custkey").select("o_orderkey", "o_totalprice", "c_name")
    return op.page(o, [("o_totalprice", True), ("o_orderkey", False)], 40, "WzQwMDAwMC4wLCA3XQ").rows


@register("SELECT user_id, CAST((rn - 1) // 20 AS BIGINT) AS batch, count(*) AS n, string_agg(event_type, ',' ORDER BY rn) AS actions FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2")
def action_batches(spark, sf_dir):
    """A user's actions in order, in batches of twenty."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(w).alias("rn"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_type"))), lambda x: x["event_type"]), ",")
    return e.groupBy("user_id", F.floor((F.col("rn") - 1) / 20).alias("batch")).agg(F.count("*").alias("n"), kinds.alias("actions"))


@register("""WITH l AS (SELECT user_id, event_id % 10 AS item, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2) SELECT user_id, count(*) AS standing FROM l WHERE last <> 'error' GROUP BY 1""")
def undo_state(spark, sf_dir):
    """What still stands of a user's actions: the last one on an item counts, and 'error' takes it back."""
    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error"))
    last = e.groupBy("user_id", (F.col("event_id") % 10).alias("item")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.where("last <> 'error'").groupBy("user_id").agg(F.count("*").alias("standing"))


_WEEK = '{"Monday":"9:00 am - 5 pm","Tuesday":"8 pm - 2 am","Wednesday":"Open 24 hours","Thursday":"closed","Friday":"by request","Saturday":"10 am - 4:30 pm"}'


@register(f"""WITH e AS (SELECT event_id, json_extract_string('{_WEEK}', '$.' || dayname(ts)) AS hours, hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT event_id, CASE WHEN hours IS NULL OR hours = 'Open 24 hours' THEN true WHEN hours = 'closed' THEN false WHEN hours = '9:00 am - 5 pm' THEN m >= 540 AND m < 1020 WHEN hours = '8 pm - 2 am' THEN m >= 1200 OR m < 120 WHEN hours = '10 am - 4:30 pm' THEN m >= 600 AND m < 990 ELSE true END AS is_open FROM e""")
def open_weekday(spark, sf_dir):
    """Opening hours of the weekday out of JSON; a missing day counts as open."""
    e = load(spark, sf_dir, "events").withColumn("hours", F.element_at(F.from_json(F.lit(_WEEK), "map<string,string>"), F.date_format("ts", "EEEE")))
    return e.select("event_id", moments.open_at(F.col("hours"), F.hour("ts") * 60 + F.minute("ts")).alias("is_open"))


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) AS position FROM orders")
def global_position(spark, sf_dir):
    """Every order's place by price."""
    return op.global_position(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", F.col("o_orderkey").asc()).select("o_orderkey", "position")


@register(f"""SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 4.0 WHEN 'click' THEN 1.0 ELSE 0.3 END * exp(-greatest(0.0, (epoch_us(TIMESTAMP '2024-07-10') - epoch_us(ts)) / 86400000000.0) / 45.0)), 6) AS weight FROM events WHERE ts >= TIMESTAMP '2024-07-10' - INTERVAL 180 DAY GROUP BY 1""")
def decay_horizon(spark, sf_dir):
    """Decayed weights of the last 180 days; the horizon is a filter of the scan."""
    since = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    e = load(spark, sf_dir, "events").where(F.col("ts") >= since)
    weight = F.when(F.col("event_type") == "purchase", 4.0).when(F.col("event_type") == "click", 1.0).otherwise(0.3)
    return e.groupBy("user_id").agg(F.round(F.sum(moments.decay(weight, F.col("ts"), "2024-07-10 00:00:00")), 6).alias("weight"))


@register("""WITH o AS (SELECT p_partkey AS id, 'orphan' AS why, 1 AS place FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) UNION ALL SELECT p_partkey, 'deleted', 2 FROM part WHERE p_size > 45)
SELECT id, arg_max(why, place) AS why FROM o GROUP BY 1""")
def orphans_union(spark, sf_dir):
    """Places without children and deleted ones, once each; the last reason stands."""
    p, li = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size"), load(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    alone = p.join(li, "id", "left_anti").select("id", F.lit("orphan").alias("why"), F.lit(1).alias("at"))
    gone = p.where("p_size > 45").select("id", F.lit("deleted").alias("why"), F.lit(2).alias("at"))
    return alone.unionByName(gone).groupBy("id").agg(F.max_by("why", "at").alias("why"))


@register("""WITH a AS (SELECT 'a' AS source, CAST(c_custkey AS VARCHAR) AS source_id, trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS name, lower(c_mktsegment) AS category, NULL::VARCHAR AS address, c_nationkey AS nation, c_acctbal AS quality FROM customer),
b AS (SELECT 'b', CAST(s_suppkey AS VARCHAR), trim(regexp_replace(s_name, '\\s+', ' ', 'g')), NULL, 'Dock ' || CAST(s_suppkey % 9 AS VARCHAR), s_nationkey, s_acctbal FROM supplier), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT source, source_id, name, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS name_key, coalesce(category, 'place') AS category, address, coalesce(n_name, 'ZZ') AS country, round(quality, 2) AS quality,
 name || ' is a ' || coalesce(category, 'place') || CASE WHEN address IS NULL THEN '' ELSE ' at ' || address END || '.' AS summary FROM u LEFT JOIN nation ON n_nationkey = nation""")
def stage_sources(spark, sf_dir):
    """Two sources brought to one shape, missing columns null, with a summary made of what is known."""
    a = load(spark, sf_dir, "customer").select(F.lit("a").alias("source"), F.col("c_custkey").cast("string").alias("source_id"), text.clean_name(F.col("c_name")).alias("name"), F.lower("c_mktsegment").alias("category"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("quality"))
    b = load(spark, sf_dir, "supplier").select(F.lit("b").alias("source"), F.col("s_suppkey").cast("string").alias("source_id"), text.clean_name(F.col("s_name")).alias("name"), F.concat(F.lit("Dock "), (F.col("s_suppkey") % 9).cast("string")).alias("address"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("quality"))
    u = a.unionByName(b, allowMissingColumns=True).join(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name"), "nation", "left")
    kind = F.coalesce("category", F.lit("place"))
    summary = F.concat(F.col("name"), F.lit(" is a "), kind, F.coalesce(F.concat(F.lit(" at "), F.col("address")), F.lit("")), F.lit("."))
    return u.select("source", "source_id", "name", text.name_key(F.col("name")).alias("name_key"), kind.alias("category"), "address", F.coalesce("n_name", F.lit("ZZ")).alias("country"), F.round("quality", 2).alias("quality"), summary.alias("summary"))
