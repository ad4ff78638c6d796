"""Relational helpers with a total order and explicit places for nulls."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark cuts groups to n rows before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order columns, by a partial aggregate: no key's rows are gathered or sorted. Ties on all order columns
    are settled by the row's other columns."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in (*order, *rest)]).select(df.columns)


def ordered_array(value: Column, *keys: Column) -> Column:
    """Aggregate: values in the order of the keys."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v")))), lambda x: x["v"])


def keyset_after(df: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence[object], size: int) -> DataFrame:
    """The page after a row: order is (column, descending), last that row's values."""
    after, equal = F.lit(False), F.lit(True)
    for (name, descending), value in zip(order, last, strict=True):
        c = F.col(name)
        after = after | (equal & ((c < F.lit(value)) if descending else (c > F.lit(value))))
        equal = equal & (c == F.lit(value))
    return df.where(after).orderBy(*[F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in order]).limit(size)


def without(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows with no partner on any one of the keys: one anti join for each, where an OR would be a nested loop."""
    for k in keys:
        df = df.join(other.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return df


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """An undirected edge table in both directions, so that either end joins by equality."""
    return edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()


def common_counts(df: DataFrame, item: str, key: str, least: int = 1, block: int = 1000) -> DataFrame:
    """a < b and the number of keys that both items have, `least` or more, from distinct rows. No key is left out: the right rows of one with
    over `block` rows are dealt into blocks, and its left rows meet each block."""
    blocks = df.groupBy(F.col(key).alias("k")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    rows = df.select(F.col(key).alias("k"), F.col(item).alias("i")).join(blocks, "k")
    left = rows.select("k", F.col("i").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at"))
    right = rows.select("k", F.col("i").alias("b"), F.pmod(F.xxhash64("i"), F.col("blocks")).alias("at"))
    return left.join(right, ["k", "at"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common")).where(F.col("common") >= least)


def ranged_common_counts(df: DataFrame, item: str, key: str, degrees: DataFrame, block: int = 1000, task_paths: int = 2_000_000, bins: int = 4096) -> DataFrame:
    """As `common_counts`, for whole numbers, but no pair is shuffled: what goes over the network is each key's items from the first of a range on, once for every range
    that the key has items of, and a range's pairs are made and counted in one task. Keys of over `block` items go in pairs of blocks. degrees (i, n): every
    item and about how many keys it has; they set how many ranges there are, where these end and how wide distances of items are."""
    low, high, paths = degrees.agg(F.min("i"), F.max("i"), F.sum(F.col("n").cast("double") * F.col("n")) / 2).head()
    low, high = low or 0, high or 0
    place = lambda c: F.least(F.greatest(F.floor((c - low).cast("double") * bins / (high - low + 1)), F.lit(0)), F.lit(bins - 1)).cast("int")
    filled = dict(degrees.dropna().groupBy(place(F.col("i")).alias("bin")).agg(F.sum(F.col("n").cast("double"))).collect())
    ranges, so_far, whole, at = min(bins, math.ceil((paths or 1) / task_paths)), 0.0, sum(filled.values()) or 1.0, []
    for b in range(bins):
        at.append(min(ranges - 1, int(so_far * ranges / whole)))
        so_far += filled.get(b, 0.0)
    of_bin = F.split(F.lit(",".join(map(str, at))), ",").cast("array<int>")
    distance = "int" if high - low < 2**31 else "long"

    rows = df.select(F.col(key).alias("k"), F.col(item).alias("i")).dropna().repartition("k")
    large = F.broadcast(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).where((F.col("n") > block) & (F.col("top") >= low)).select("k", F.ceil(F.col("n") / block).alias("blocks")))

    whole_keys = rows.join(large, "k", "left_anti").groupBy("k").agg(F.array_sort(F.collect_list("i")).alias("s")).where(F.size("s") > 1)
    placed = whole_keys.select("s", F.transform("s", lambda x: F.get(of_bin, place(x))).alias("g"))
    starts = placed.select("s", "g", F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda p: (p == 0) | (F.get("g", p) != F.get("g", p - 1))).alias("p"))
    each = starts.select("s", "g", F.explode(F.transform("p", lambda p, j: F.struct(p.alias("from"), F.coalesce(F.get("p", j + 1), F.size("s")).alias("to")))).alias("r"))
    first = F.get("s", F.col("r.from"))
    tails = each.select(F.get("g", F.col("r.from")).alias("range"), first.alias("base"), (F.col("r.to") - F.col("r.from")).alias("m"), F.slice("s", F.col("r.from") + 1, F.size("s") - F.col("r.from")).alias("t"), F.lit(None).cast(f"array<{distance}>").alias("ls"))
    tails = tails.where(F.size("t") > 1).select("range", "base", "m", "ls", F.expr(f"transform(t, x -> cast(x - base AS {distance}))").alias("rs"))

    dealt = rows.join(large, "k").withColumn("at", F.pmod(F.xxhash64("i"), F.col("blocks")))
    lists = dealt.groupBy("k", "blocks", "at").agg(F.collect_list("i").alias("rs"))
    split = lists.select("k", "blocks", F.col("at").alias("from"), F.explode("rs").alias("i")).withColumn("range", F.get(of_bin, place(F.col("i"))))
    left = split.groupBy("k", "blocks", "from", "range").agg(F.collect_list("i").alias("ls")).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = left.join(lists.select("k", "at", "rs"), ["k", "at"]).withColumn("base", F.array_min("ls"))
    met = met.select("range", "base", F.lit(0).alias("m"), F.expr(f"transform(ls, x -> cast(x - base AS {distance}))").alias("ls"), F.expr(f"transform(filter(rs, x -> x > base), x -> cast(x - base AS {distance}))").alias("rs"))

    there = tails.unionByName(met.where(F.size("rs") > 0)).repartitionById(ranges, F.col("range"))
    lefts = there.select("range", "base", "rs", F.explode(F.coalesce("ls", F.slice("rs", F.lit(1), F.col("m")))).alias("l"))
    pairs = lefts.select("range", "base", "l", F.explode("rs").alias("r")).where("l < r").select("range", (F.col("base") + F.col("l")).alias("a"), (F.col("base") + F.col("r")).alias("b"))
    return pairs.groupBy("range", "a", "b").agg(F.count("*").alias("common")).select("a", "b", "common")


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union by name, missing columns null, then the latest row of each key."""
    return latest_per_key(old.unionByName(new, allowMissingColumns=True), keys, order)


def ledger_conflicts(df: DataFrame, key: str, *content: str) -> DataFrame:
    """Rows and different contents of each key; more than one content is a conflict."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*content)).alias("n_contents"))
