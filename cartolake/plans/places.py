"""Queries over places: staging, resolution, search, tiles. Places are derived from customer and supplier by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, hashing, text
from ..operators.gridjoin import grid_join
from ..operators.relational import latest_per_key, top_per_key

#: Fixed value: the namespace of place ids.
NAMESPACE = "4cc1f63b-1a05-5ca2-9f15-5c860930f7d7"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def source_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    lat, lon = (key * 7919 % 18000).cast("double") / 100 - 90, (key * 104729 % 36000).cast("double") / 100 - 180
    name = F.concat(F.lit("Place  "), (key % 50).cast("string"))
    return c.select(key.cast("string").alias("source_id"), text.clean_name(name).alias("name"), text.name_key(name).alias("name_key"), F.lower("c_mktsegment").alias("category"), lat.alias("latitude"), lon.alias("longitude"), F.col("c_acctbal").alias("quality"), F.col("c_nationkey").alias("nation"))


def source_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier lies close to the customer with five times its key, some a little too far."""
    s, a = load(spark, sf_dir, "supplier"), source_a(spark, sf_dir)
    moved = F.col("s_suppkey") % 20 * 0.0001
    return s.join(a, (F.col("s_suppkey") * 5).cast("string") == F.col("source_id")).select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("b_id"), F.col("name_key").alias("b_key"), F.col("category").alias("b_category"), (F.col("latitude") + moved).alias("b_lat"), (F.col("longitude") + moved).alias("b_lon"), F.col("s_acctbal").alias("b_quality")
    )


_A = """a AS (SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'Place ' || CAST(c_custkey % 50 AS VARCHAR) AS name, 'place' || CAST(c_custkey % 50 AS VARCHAR) AS name_key, lower(c_mktsegment) AS category,
 CAST((c_custkey * 7919) % 18000 AS DOUBLE) / 100 - 90 AS latitude, CAST((c_custkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude, c_acctbal AS quality, c_nationkey AS nation FROM customer)"""
_B = """b AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS b_id, name_key AS b_key, category AS b_category, latitude + CAST(s_suppkey % 20 AS DOUBLE) * 0.0001 AS b_lat, longitude + CAST(s_suppkey % 20 AS DOUBLE) * 0.0001 AS b_lon, s_acctbal AS b_quality
 FROM supplier JOIN a ON CAST(s_suppkey * 5 AS VARCHAR) = source_id)"""
_HAV = "12742008.8 * atan2(sqrt(h), sqrt(greatest(1 - h, 0.0)))"


def grid_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest place of the same name and category in the 3 x 3 cells around, within 0.0015 degrees."""
    a, b = source_a(spark, sf_dir), source_b(spark, sf_dir)
    dy, dx = F.col("b_lat") - F.col("latitude"), F.col("b_lon") - F.col("longitude")
    near = (F.abs(dy) <= 0.0015) & (F.abs(dx) <= 0.0015)
    d2 = dy * dy + dx * dx * F.pow(F.cos(F.radians("b_lat")), 2)
    pairs = grid_join(b, a, ("b_lat", "b_lon"), ("latitude", "longitude"), 1000.0, near, (("b_key", "name_key"), ("b_category", "category"))).withColumn("d2", d2)
    return top_per_key(pairs, ["b_id"], [F.col("d2").asc(), F.col("source_id").asc()]).select("b_id", "source_id", F.round(F.col("d2") * 1e9, 3).alias("d2e9"))


GRID_MATCH = f"""WITH {_A}, {_B},
m AS (SELECT b_id, source_id, (b_lat-latitude)*(b_lat-latitude) + (b_lon-longitude)*(b_lon-longitude)*pow(cos(radians(b_lat)),2) AS d2 FROM b JOIN a ON b_key = name_key AND b_category = category
 AND abs(b_lat-latitude) <= 0.0015 AND abs(b_lon-longitude) <= 0.0015 AND abs(floor((b_lat+90)*1000.0) - floor((latitude+90)*1000.0)) <= 1 AND abs(floor((b_lon+180)*1000.0) - floor((longitude+180)*1000.0)) <= 1)
SELECT b_id, source_id, round(d2*1e9, 3) AS d2e9 FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY d2, source_id) AS rn FROM m) WHERE rn = 1"""


def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical places of both sources: a matched b takes a's id, an unmatched one its own; one row for each id, the best."""
    a, b, m = source_a(spark, sf_dir), source_b(spark, sf_dir), grid_match(spark, sf_dir)
    ida = a.select(hashing.uuid5(NAMESPACE, F.concat(F.lit("a:"), F.col("source_id"))).alias("location_id"), "source_id", "name_key", "quality")
    matched = b.join(m.select("b_id", F.col("source_id").alias("m_id")), "b_id", "left")
    ident = F.coalesce(F.when(F.col("m_id").isNotNull(), F.concat(F.lit("a:"), F.col("m_id"))), F.concat(F.lit("b:"), F.col("b_id")))
    idb = matched.select(hashing.uuid5(NAMESPACE, ident).alias("location_id"), F.col("b_id").alias("source_id"), F.col("b_key").alias("name_key"), F.col("b_quality").alias("quality"))
    both = ida.unionByName(idb)
    best = latest_per_key(both, ["location_id"], ["quality", "source_id"])
    links = both.groupBy("location_id").agg(F.count("*").alias("n_sources"))
    return best.join(links, "location_id")


RESOLVE = f"""WITH {_A}, {_B},
m AS (SELECT b_id, source_id AS m_id FROM ({GRID_MATCH.replace("WITH " + _A + ", " + _B + ",", "WITH")})),
u AS (SELECT 'a:' || source_id AS k, source_id, name_key, quality FROM a UNION ALL SELECT coalesce('a:' || m_id, 'b:' || b.b_id), b.b_id, b_key, b_quality FROM b LEFT JOIN m ON b.b_id = m.b_id),
i AS (SELECT *, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(k)) AS h FROM u),
l AS (SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', h[17:17]), 1) || h[18:20] || '-' || h[21:32] AS location_id, source_id, name_key, quality FROM i)
SELECT location_id, source_id, name_key, quality, n_sources FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY quality DESC, source_id DESC) AS rn, count(*) OVER (PARTITION BY location_id) AS n_sources FROM l) WHERE rn = 1"""


def slug_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest id keeps a shared slug, the others get their id appended."""
    a = source_a(spark, sf_dir).select("source_id", F.col("name_key").alias("slug"))
    first = a.groupBy("slug").agg(F.min("source_id").alias("winner"))
    return a.join(first, "slug").select("source_id", F.when(F.col("source_id") == F.col("winner"), F.col("slug")).otherwise(F.concat("slug", F.lit("-"), "source_id")).alias("slug"))


SLUG_COLLISION = f"WITH {_A}, w AS (SELECT name_key, min(source_id) AS winner FROM a GROUP BY 1) SELECT source_id, CASE WHEN source_id = winner THEN a.name_key ELSE a.name_key || '-' || source_id END AS slug FROM a JOIN w USING (name_key)"


def geo_search_topk(spark: SparkSession, sf_dir: str, lat: float = 10.0, lon: float = 20.0, radius_m: float = 3_000_000.0, query: str = "place 1", k: int = 25) -> DataFrame:
    """Box, exact radius, text and distance score, best k by score, distance, id. Positions are computed here, so the box filters after the scan; a stored column would take it as a pushed filter."""
    south, north, west, east = geo.radius_box(lat, lon, radius_m)
    a = source_a(spark, sf_dir).where(geo.in_bounds(F.col("latitude"), F.col("longitude"), south, north, west, east))
    a = a.withColumn("distance_m", geo.haversine_m(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))).where(F.col("distance_m") <= radius_m)
    exact = text.field_score(text.search_text(F.col("name")), query, 5.0)
    a = a.withColumn("text_score", F.when(exact > 0, exact).otherwise(text.fuzzy_score(text.search_text(F.col("name")), query))).where("text_score > 0")
    score = F.col("text_score") + 2.5 * F.greatest(F.lit(0.0), 1 - F.col("distance_m") / radius_m)
    return a.withColumn("score", score).orderBy(F.col("score").desc(), "distance_m", "source_id").limit(k).select("source_id", F.round("distance_m", 3).alias("distance_m"), F.round("score", 6).alias("score"))


def _search_sql(lat: float, lon: float, radius: float, k: int) -> str:
    """Distances and exact ladder for 'place 1'; names 'Place n' that don't match exactly fall to Dice and edit distance."""
    return f"""WITH {_A}, d AS (SELECT *, {_HAV.replace("h)", "pow(sin(radians(latitude - {0}) / 2), 2) + cos(radians({0})) * cos(radians(latitude)) * pow(sin(radians(longitude - {1}) / 2), 2))".format(lat, lon)).replace("1 - h", "1 - (pow(sin(radians(latitude - {0}) / 2), 2) + cos(radians({0})) * cos(radians(latitude)) * pow(sin(radians(longitude - {1}) / 2), 2))".format(lat, lon))} AS distance_m, lower(name) AS n FROM a),
g AS (SELECT *, list_distinct(list_transform(range(1, length(n) + 1), lambda i: substr(' ' || n || ' ', i, 3))) AS gn, list_distinct(list_transform(range(1, 8), lambda i: substr(' place 1 ', i, 3))) AS gq FROM d WHERE distance_m <= {radius}),
s AS (SELECT *, 2.0 * len(list_intersect(gn, gq)) / (len(gn) + len(gq)) AS dice FROM g),
t AS (SELECT *, CASE WHEN n = 'place 1' THEN 25.0 WHEN starts_with(n, 'place 1') THEN 18.0 WHEN contains(n, ' 1') THEN 13.5 WHEN dice >= 0.72 THEN 8 + dice * 8 WHEN dice >= 0.48 AND levenshtein(n, 'place 1') <= 2 THEN 10 + dice * 6
 WHEN dice >= 0.48 AND len(list_filter(string_split(n, ' '), lambda x: levenshtein(x, 'place 1') <= 2)) > 0 THEN 8 + dice * 5 ELSE 0 END AS text_score FROM s)
SELECT source_id, round(distance_m, 3) AS distance_m, round(text_score + 2.5 * greatest(0.0, 1 - distance_m / {radius}), 6) AS score FROM t WHERE text_score > 0 ORDER BY text_score + 2.5 * greatest(0.0, 1 - distance_m / {radius}) DESC, t.distance_m, source_id LIMIT {k}"""


GEO_SEARCH = _search_sql(10.0, 20.0, 3_000_000.0, 25)


def viewport_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view across the date line, capped by zoom, best quality first."""
    a = source_a(spark, sf_dir).where(geo.in_bounds(F.col("latitude"), F.col("longitude"), -30.0, 40.0, 150.0, -120.0))
    return a.orderBy(F.col("quality").desc(), "source_id").limit(viewport_cap(7)).select("source_id", "latitude", "longitude", "quality")


def viewport_cap(zoom: float) -> int:
    return next(cap for below, cap in ((6, 80), (9, 100), (12, 120), (15, 150), (99, 180)) if zoom < below)


VIEWPORT = f"WITH {_A} SELECT source_id, latitude, longitude, quality FROM a WHERE latitude BETWEEN -30 AND 40 AND (longitude >= 150 OR longitude <= -120) ORDER BY quality DESC, source_id LIMIT 100"


def tile_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for each tile of zooms 2 to 8 from one pass: zooms are exploded and counted with a partial aggregate."""
    a = source_a(spark, sf_dir).select("latitude", "longitude", F.explode(F.sequence(F.lit(2), F.lit(8))).alias("zoom"))
    x, y = geo.mercator_tile(F.col("latitude"), F.col("longitude"), F.col("zoom"))
    return a.select("zoom", x.cast("long").alias("tile_x"), y.cast("long").alias("tile_y")).groupBy("zoom", "tile_x", "tile_y").agg(F.count("*").alias("n"))


TILE_PYRAMID = f"""WITH {_A}, z AS (SELECT latitude, longitude, unnest(range(2, 9)) AS zoom FROM a), r AS (SELECT *, radians(greatest(-85.05112878, least(85.05112878, latitude))) AS p, pow(2.0, zoom) AS n FROM z)
SELECT CAST(zoom AS INTEGER) AS zoom, CAST(greatest(0, least(n - 1, floor((longitude + 180.0) / 360.0 * n))) AS BIGINT) AS tile_x, CAST(greatest(0, least(n - 1, floor((1 - ln(tan(p) + 1 / cos(p)) / pi()) / 2 * n))) AS BIGINT) AS tile_y, count(*) AS n FROM r GROUP BY ALL"""


def tile_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of each 30 degree tile; among equals the larger id stays."""
    ty, tx = geo.degree_tile(F.col("latitude"), F.col("longitude"), 30.0)
    a = source_a(spark, sf_dir).withColumn("ty", ty).withColumn("tx", tx).withColumn("band", F.floor(F.col("quality") / 2000))
    return top_per_key(a, ["ty", "tx"], [F.col("band").desc(), F.col("source_id").desc()], 20).select("ty", "tx", "source_id", "band")


TILE_TOPS = f"""WITH {_A}, t AS (SELECT CAST(floor((latitude + 90) / 30.0) AS BIGINT) AS ty, CAST(floor((longitude + 180) / 30.0) AS BIGINT) AS tx, source_id, CAST(floor(quality / 2000) AS BIGINT) AS band FROM a)
SELECT ty, tx, source_id, band FROM (SELECT *, row_number() OVER (PARTITION BY ty, tx ORDER BY band DESC, source_id DESC) AS rn FROM t) WHERE rn <= 20"""


def stage_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, keys, slugs, countries and categories of parts."""
    p = load(spark, sf_dir, "part")
    raw = F.concat_ws("  ", "p_name", "p_type")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("barber_shop", "coffee", "public_hall", "school", "theatre", "food_court", "plain", "dog_park")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", text.clean_name(raw).alias("name"), text.name_key(raw).alias("name_key"), text.token_key(raw).alias("token"), text.country_or_zz(F.substring("p_type", 1, 2)).alias("country"), text.category(kind).alias("category"))


STAGE_NORMALIZE = """WITH x AS (SELECT p_partkey, p_name || '  ' || p_type AS raw, p_type, ['barber_shop', 'coffee', 'public_hall', 'school', 'theatre', 'food_court', 'plain', 'dog_park'][CAST(p_partkey % 8 + 1 AS INTEGER)] AS kind FROM part)
SELECT p_partkey, nullif(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '') AS name, regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') AS name_key, left(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60) AS token,
 CASE WHEN regexp_matches(upper(left(p_type, 2)), '^[A-Z]{2}$') THEN upper(left(p_type, 2)) ELSE 'ZZ' END AS country,
 CASE kind WHEN 'barber_shop' THEN 'bar' WHEN 'coffee' THEN 'cafe' WHEN 'public_hall' THEN 'bar' WHEN 'theatre' THEN 'attraction' WHEN 'food_court' THEN 'restaurant' WHEN 'dog_park' THEN 'park' END AS category FROM x"""

QUERIES = {f.__name__: f for f in (grid_match, resolve_entities, slug_collision, geo_search_topk, viewport_search, tile_pyramid, tile_tops, stage_normalize)}
ORACLE_SQL = {"grid_match": GRID_MATCH, "resolve_entities": RESOLVE, "slug_collision": SLUG_COLLISION, "geo_search_topk": GEO_SEARCH, "viewport_search": VIEWPORT, "tile_pyramid": TILE_PYRAMID, "tile_tops": TILE_TOPS, "stage_normalize": STAGE_NORMALIZE}
