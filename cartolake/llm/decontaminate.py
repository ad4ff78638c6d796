"""Benchmark decontamination, all in DataFrame functions.

Words are runs of letters and digits (ASCII signs part them), lower-cased. A shingle is `width` words; its weight is the whole number
1000 * ln(1 + items / items that hold it), unknown shingles counting as held by one. Windows have the size of a benchmark item in words.
A window whose similarity to an item is not zero shares a shingle with it, so windows are laid where a document's shingle is one
of the item's, at the same place in both (at a text's edge they move or shrink to fit). Each window and item gets a 64-bit SimHash of its weighted
shingles. The fingerprints are cut into `blocks` blocks; two within `radius` bits differ in at most radius // blocks bits in some
block, so each item is filed under its blocks' values and those that many bits away, and a window looks its own up, among items of
its size. What lies within the radius is verified: the sum of lesser weighted counts over the sum of greater ones, in whole numbers.

Null texts have no words. Items of fewer words than a shingle are not searched for; documents without a doc_id can't be named and are
left out (the pipeline form keeps them). Repeated rows find the same items; of equal windows the first is told.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

@dataclass(frozen=True)
class LeakParams:
    width: int = 5
    over: int = 80
    under: int = 100
    radius: int = 18
    blocks: int = 10
    #: The benchmark's shingles are broadcast only when they are counted to be so many at most; beyond, they are joined by shuffle.
    broadcast_rows: int = 1_000_000


def _shingles(text: str, width: int) -> Column:
    """xxhash64 over `width` word hashes at each place; an empty array for fewer words. The word hashes are a lambda's variable, so that
    they are worked out once for a text and not again for each place."""
    flat = rf"trim(regexp_replace(lower(coalesce({text}, '')), r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' '))"
    parts = ", ".join(f"h[i + {k}]" for k in range(width))
    at = f"CASE WHEN size(h) >= {width} THEN transform(sequence(0, size(h) - {width}), i -> xxhash64({parts})) ELSE array() END"
    return F.expr(f"element_at(transform(array(transform(split({flat}, ' '), w -> xxhash64(w))), h -> {at}), 1)")


def _simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fp. rows: keys, s, wt; repeated shingles count again."""
    sums = [F.sum(F.when(F.shiftrightunsigned("s", b).bitwiseAND(1) == 1, F.col("wt")).otherwise(-F.col("wt"))).alias(f"b{b}") for b in range(64)]
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.groupBy(*keys).agg(*sums).select(*keys, fp.alias("fp"))


def _block(fp: str, b: int, blocks: int) -> tuple[Column, int]:
    low, high = 64 * b // blocks, 64 * (b + 1) // blocks
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << (high - low)) - 1), high - low


def _masks(bits: int, flips: int) -> list[int]:
    out = {0}
    for _ in range(flips):
        out |= {m ^ (1 << k) for m in out for k in range(bits)}
    return sorted(out)


def leaks(documents: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """doc_id, item_id, start (word of the document, from 0), n_words (of the window), hamming, similarity (6 decimals): the best window of each pair found."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", _shingles("text", p.width).alias("all"))
    scratch = Scratch(documents.sparkSession, "leaks")
    items = scratch.keep(items.select("item_id", "all", F.posexplode("all").alias("at", "s")).select("item_id", (F.size("all") + p.width - 1).alias("words"), "at", "s"), "items")
    n_items = F.lit(benchmark.where("item_id IS NOT NULL").select("item_id").distinct().count())
    rows = items.count()
    weights = scratch.keep(items.groupBy("s").agg(F.round(1000 * F.log(1 + n_items / F.count_distinct("item_id"))).cast("long").alias("wt")), "weights")
    unknown = F.round(1000 * F.log(1 + n_items)).cast("long")
    small = F.broadcast if rows <= p.broadcast_rows else (lambda df: df)

    # One pass over all texts: shingles as rows, kept where the benchmark has them; what follows is as large as the finds.
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), _shingles("text", p.width).alias("all"))
    places = items.select("s", "at", "words").distinct()
    hits = docs.select("doc_id", "t", "all", F.posexplode("all").alias("pos", "s")).join(small(places), "s")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.size("all") + (p.width - 1) - F.col("words")))
    hits = hits.select("doc_id", "t", "words", start.alias("start"), "all")
    windows = hits.select("doc_id", "t", "words", "start", F.slice("all", F.col("start") + 1, F.col("words") - (p.width - 1)).alias("own")).groupBy("doc_id", "t", "words", "start").agg(F.first("own").alias("own"))
    windows = scratch.keep(windows, "windows")

    key = ["doc_id", "t", "words", "start"]
    shingles = windows.select(*key, F.explode("own").alias("s")).join(small(weights), "s", "left").select(*key, "s", F.coalesce("wt", unknown).alias("wt"))
    prints = scratch.keep(_simhash(shingles, key), "prints")
    item_rows = items.join(weights, "s").select("item_id", "words", "s", "wt")
    item_prints = scratch.keep(_simhash(item_rows, ["item_id", "words"]), "item-prints")
    flips, look, file = p.radius // p.blocks, [], []
    for b in range(p.blocks):
        (own, bits), (theirs, _) = _block("fp", b, p.blocks), _block("fp", b, p.blocks)
        look.append(F.struct(F.lit(b).alias("b"), own.alias("v")))
        file += [F.struct(F.lit(b).alias("b"), theirs.bitwiseXOR(m).alias("v")) for m in _masks(bits, flips)]
    index = item_prints.select("item_id", "words", F.col("fp").alias("item_fp"), F.explode(F.array(*file)).alias("x")).select("item_id", "words", "item_fp", "x.b", "x.v")
    near = prints.select(*key, "fp", F.explode(F.array(*look)).alias("x")).select(*key, "fp", "x.b", "x.v").join(small(index), ["words", "b", "v"])
    near = near.select(*key, "item_id", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("hamming")).where(F.col("hamming") <= p.radius).distinct()

    counts = shingles.groupBy(*key, "s").agg(F.count("*").alias("c"), F.first("wt").alias("wt"))
    item_counts = item_rows.groupBy("item_id", "s").agg(F.count("*").alias("ci"))
    item_total = item_rows.groupBy("item_id").agg(F.sum("wt").alias("item_total"))
    both = near.join(counts, key).join(small(item_counts), ["item_id", "s"], "left").groupBy(*key, "item_id", "hamming").agg(F.sum(F.col("c") * F.col("wt")).alias("total"), F.sum(F.least("c", F.coalesce("ci", F.lit(0))) * F.col("wt")).alias("least"))
    both = both.join(small(item_total), "item_id").withColumn("most", F.col("total") + F.col("item_total") - F.col("least")).where(p.under * F.col("least") >= p.over * F.col("most"))
    best = both.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("least") / F.col("most")).alias("x"), "start", "words", "hamming")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.start").alias("start"), F.col("m.words").alias("n_words"), F.col("m.hamming").cast("int").alias("hamming"), F.round(-F.col("m.x"), 6).alias("similarity"))


def drop_leaks(documents: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """Pipeline form: the documents in which no item was found."""
    found = leaks(documents, benchmark, p).select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti").select(documents.columns)


#: The same in DuckDB SQL for the default parameters: every aligned window is verified, without fingerprints.
SQL = r"""
WITH bw AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM benchmark),
dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM documents),
it AS (SELECT item_id, len(w) AS words, unnest(range(0, len(w) - 4)) AS o, w FROM bw WHERE len(w) >= 5),
i AS (SELECT item_id, words, o, array_to_string(w[o + 1:o + 5], ' ') AS s FROM it),
nn AS (SELECT count(DISTINCT item_id) AS n FROM benchmark),
wt AS (SELECT s, CAST(round(1000 * ln(1 + (SELECT n FROM nn) / count(DISTINCT item_id))) AS BIGINT) AS wt FROM i GROUP BY s),
dt AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS pos, w FROM dw WHERE len(w) >= 5),
d AS (SELECT doc_id, n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS s FROM dt),
win AS (SELECT DISTINCT d.doc_id, i.item_id, i.words, greatest(0, least(d.pos - i.o, d.n - i.words)) AS start FROM d JOIN i ON d.s = i.s),
ws AS (SELECT win.doc_id, win.item_id, win.words, win.start, d.s, count(*) AS c FROM win JOIN d ON d.doc_id = win.doc_id AND d.pos >= win.start AND d.pos < win.start + win.words - 4 GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS ci FROM i GROUP BY ALL),
tot AS (SELECT item_id, sum(wt) AS t FROM i JOIN wt USING (s) GROUP BY item_id),
m AS (SELECT ws.doc_id, ws.item_id, ws.words, ws.start, sum(least(c, coalesce(ci, 0)) * coalesce(wt, CAST(round(1000 * ln(1 + (SELECT n FROM nn))) AS BIGINT))) AS least_,
  sum(c * coalesce(wt, CAST(round(1000 * ln(1 + (SELECT n FROM nn))) AS BIGINT))) AS total
  FROM ws LEFT JOIN ic ON ws.item_id = ic.item_id AND ws.s = ic.s LEFT JOIN wt ON ws.s = wt.s GROUP BY ALL),
v AS (SELECT m.*, total + t - least_ AS most FROM m JOIN tot USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY least_ / most DESC, start, words) AS rn FROM v WHERE 100 * least_ >= 80 * most)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(words AS INTEGER) AS n_words, round(least_ / most, 6) AS similarity FROM r WHERE rn = 1
"""
