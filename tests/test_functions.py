import math
import uuid

from pyspark.sql import functions as F

from cartolake.functions import geo, hashing, moments, text, vector


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_hash_buckets_of_known_ids(spark):
    assert value(spark, hashing.hash_bucket(F.lit("loc-1"))) == "60c"
    assert value(spark, hashing.hash_bucket(F.lit("cn-tower"))) == "e79"


def test_uuid5_equals_python(spark):
    space = "4cc1f63b-1a05-5ca2-9f15-5c860930f7d7"
    for name in ("fsq_os:1", "é:2", ""):
        assert value(spark, hashing.uuid5(space, F.lit(name))) == str(uuid.uuid5(uuid.UUID(space), name))


def test_category_takes_the_first_rule(spark):
    cases = {"barber_shop": "bar", "Coffee Bar": "cafe", "medical_bar": None, "public_hall": "bar", "zoo": "attraction", None: None}
    for raw, want in cases.items():
        assert value(spark, text.category(F.lit(raw).cast("string"))) == want


def test_names_and_slugs(spark):
    assert value(spark, text.clean_name(F.lit("  a \t b "))) == "a b"
    assert value(spark, text.clean_name(F.lit("  "))) is None
    assert value(spark, text.name_key(F.lit("Café No. 1"))) == "cafno1"
    assert value(spark, text.slug(F.lit("Café No. 1"), F.lit("12345678-9abc"))) == "caf-no-1-12345678"
    assert value(spark, text.slug(F.lit("!!"), F.lit("12345678-9abc"))) == "place-12345678"
    assert [value(spark, text.country_or_zz(F.lit(x).cast("string"))) for x in ("ca", "CAN", None)] == ["CA", "ZZ", "ZZ"]


def test_distance_and_date_line(spark):
    d = value(spark, geo.haversine_m(F.lit(43.6426), F.lit(-79.3871), F.lit(43.65), F.lit(-79.3871)))
    assert 800 < d < 900
    assert value(spark, geo.in_bounds(F.lit(0.0), F.lit(179.5), -1, 1, 179, -179))
    assert not value(spark, geo.in_bounds(F.lit(0.0), F.lit(0.0), -1, 1, 179, -179))
    south, north, west, east = geo.radius_box(0.0, 179.9, 50_000)
    assert south < 0 < north and west > 0 > east


def test_fuzzy_match_finds_a_misspelt_name(spark):
    assert value(spark, text.fuzzy_score(F.lit("cn tower"), "cn towr")) > 0
    assert value(spark, text.fuzzy_score(F.lit("harbour pier"), "cn towr")) == 0
    assert value(spark, text.field_score(F.lit("old mill road"), "mi ro", 2.0)) == 5.4


def test_opening_hours(spark):
    for hours, minute, want in (("9:00 am - 5 pm", 600, True), ("9 am - 5 pm", 1020, False), ("8 pm - 2 am", 60, True), ("8 pm - 2 am", 600, False), ("Open 24 hours", 0, True), ("closed", 0, False), ("?", 5, True)):
        assert value(spark, moments.open_at(F.lit(hours), F.lit(minute))) is want


def test_decay_and_cosine(spark):
    got = value(spark, moments.decay(F.lit(2.0), F.to_timestamp(F.lit("2024-01-01 00:00:00")), "2024-02-15 00:00:00"))
    assert abs(got - 2 * math.exp(-1)) < 1e-9
    assert abs(value(spark, vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) - 1 / math.sqrt(2)) < 1e-9
    assert value(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
