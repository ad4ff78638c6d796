"""Text columns: names, keys, slugs, categories, trigrams, match scores. All are built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and their patterns, first match wins; the first rule excludes.
CATEGORY_RULES: tuple[tuple[str | None, str], ...] = (
    (None, "hospital|clinic|medical|dentist|school|university|college|office|warehouse|factory|police|fire_station|private_residence|government_office"),
    ("cafe", "cafe|coffee|tea_house|tea room|bakery|dessert|ice_cream|gelato|donut"),
    ("nightlife", "nightclub|night_club|dance_club|karaoke"),
    ("bar", "bar|pub|brewpub|beer_garden|wine_bar|cocktail_bar|sports_bar|lounge"),
    ("activity_venue", "arcade|bowling|miniature_golf|mini_golf|escape_room|recreation|sports_center|sports_centre|climbing_gym|trampoline|game_center|game_centre|clubhouse"),
    ("community_space", "community_center|community_centre|community_space|cultural_center|cultural_centre|public_hall|social_center"),
    ("park", "park|garden|playground|nature_reserve|dog_park|waterfront_park"),
    ("museum", "museum"),
    ("gallery", "gallery"),
    ("attraction", "cinema|movie_theat|theater|theatre|aquarium|zoo|tourist_attraction|amusement_park|theme_park|planetarium"),
    ("scenic_spot", "viewpoint|scenic|landmark|historic|monument|memorial|observation_deck|waterfront"),
    ("shop", "bookstore|book_shop|market|shopping_mall|shopping_center|shopping_centre|department_store|gift_shop|record_store|game_store|toy_store"),
    ("restaurant", "restaurant|food_court|fine_dining|fast_food|dining|eat_and_drink|_restaurant"),
)


def clean_name(c: Column) -> Column:
    """White space runs to one space, trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def country_or_zz(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    return F.when(up.rlike("^[A-Z]{2}$"), up).otherwise("ZZ")


def category(c: Column) -> Column:
    """First rule whose pattern occurs anywhere in the lower-cased value; null if none, or if it is the excluding one."""
    value, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(None).cast("string")
    for name, pattern in reversed(CATEGORY_RULES):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def slug(name: Column, ident: Column, limit: int = 70) -> Column:
    """ASCII letters and digits joined by '-', with the first eight hex digits of the id."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\x00-\x7F]", "")
    body = F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.concat(F.when(body == "", F.lit("place")).otherwise(body), F.lit("-"), F.substring(F.replace(ident, F.lit("-"), F.lit("")), 1, 8))


def token_key(c: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, limit)


def search_text(c: Column) -> Column:
    """Lower case without marks, everything but letters and digits one space."""
    return F.trim(F.regexp_replace(fold_marks(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", " "))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the value between two spaces; a value of one or two characters is its own; empty has none."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(padded, i, 3)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) < 3, F.array(c)).otherwise(grams)


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two distinct arrays, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def token_overlap(left: Column, right: Column, stop: Sequence[str] = ()) -> Column:
    """Share of the left side's distinct tokens that the right side has."""
    def own(c: Column) -> Column:
        return F.array_except(F.array_distinct(F.filter(F.split(search_text(c), " "), lambda t: t != "")), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))

    return F.coalesce(F.size(F.array_intersect(own(left), own(right))) / F.nullif(F.size(own(left)), F.lit(0)), F.lit(0.0))


def field_score(field: Column, query: str, weight: float) -> Column:
    """Equal 5, prefix 3.6, every query token begins some token 2.7, substring 2.1, each times the weight."""
    tokens = F.split(field, " ")
    every = F.lit(True)
    for begin in map(F.lit, query.split()):
        every = every & (F.size(F.filter(F.transform(tokens, lambda x: F.struct(x.alias("t"), begin.alias("b"))), lambda y: F.startswith(y["t"], y["b"]))) > 0)
    return F.when((field == "") | F.lit(query == ""), 0.0).when(field == query, 5.0 * weight).when(F.startswith(field, F.lit(query)), 3.6 * weight).when(every, 2.7 * weight).when(F.contains(field, F.lit(query)), 2.1 * weight).otherwise(0.0)


def fuzzy_score(name: Column, query: str) -> Column:
    """Typo-tolerant score of a name, with fixed values: trigram Dice first, then bounded edit distance of the whole and of each token."""
    d = dice(trigrams(F.lit(query)), trigrams(name))
    k = 1 if len(query) <= 5 else 2
    near = F.levenshtein(name, F.lit(query), k) >= 0
    token = F.exists(F.split(name, " "), lambda t: F.levenshtein(t, F.lit(query), k) >= 0)
    return F.when(d >= 0.72, 8 + d * 8).when((d >= 0.48) & (F.length(name) <= 96) & F.lit(len(query) <= 64), F.when(near, 10 + d * 6).when(token, 8 + d * 5).otherwise(0.0)).otherwise(0.0)


def _folds() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one letter and marks, and these letters."""
    pairs = []
    for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(k):
            pairs.append((chr(k), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_marks(c: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(c, *_folds()), r"\p{M}+", "")


#: Intents and the words that tell them, in order.
INTENTS = (
    ("coffee", "coffee|cafe|espresso|tea|brunch|bakery"),
    ("drinks", "drink|cocktail|bar|pub|beer|wine|lounge"),
    ("meal", "dinner|lunch|food|restaurant|meal|sushi|pizza|dessert"),
    ("outdoors", "park|walk|hike|trail|outdoor|sunset|scenic|garden|waterfront"),
    ("culture", "museum|gallery|art|culture|exhibit|theatre|theater"),
    ("activity", "activity|bowling|arcade|game|climb|skate|mini.?golf"),
    ("quiet", "quiet|study|read|work|cozy|low.?key"),
    ("romantic", "romantic|date|anniversary|special"),
    ("casual", "casual|hangout|chill|friends"),
)


def intent_bucket(query: Column, category: Column, open_now: Column, accessible: Column) -> Column:
    """The first intent whose words occur in query and category, else the category's token, else a flag's name, else null."""
    words = F.lower(F.concat_ws(" ", query, category))
    token = token_key(F.coalesce(category, F.lit("")))
    out = F.when(token != "", token).when(F.coalesce(open_now, F.lit(False)), F.lit("open_now")).when(F.coalesce(accessible, F.lit(False)), F.lit("accessible"))
    for name, pattern in reversed(INTENTS):
        out = F.when(words.rlike(pattern), F.lit(name)).otherwise(out)
    return out


#: The character references that captions are written with.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_html(c: Column) -> Column:
    """A caption without tags, its references decoded, white space in single blanks."""
    out = F.coalesce(c, F.lit(""))
    for name, plain in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"\s+", " "))


def open_licence(c: Column) -> Column:
    """The licence that a short name stands for; null if it isn't an open one."""
    version = F.coalesce(F.nullif(F.regexp_extract(c, r"(\d\.\d)", 1), F.lit("")), F.lit("4.0"))
    return (
        F.when(c.rlike(r"(?i)^CC0(?:\s|$)"), "CC0-1.0")
        .when(c.rlike("(?i)public domain"), "public-domain")
        .when(c.rlike(r"(?i)CC\s*BY-SA"), F.concat(F.lit("CC-BY-SA-"), version))
        .when(c.rlike(r"(?i)CC\s*BY"), F.concat(F.lit("CC-BY-"), version))
    )


def typo(c: Column) -> Column:
    """The value with another last letter, as a search with a slip of the finger."""
    return F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.when(F.endswith(c, F.lit("x")), "y").otherwise("x"))
