"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

All documents' lines, in order of doc_id and line, are one sequence of line ids; suffixes end with their document. Level k ranks each
suffix by its first 2^k lines: the ranks of pairs (rank at i, rank at i + 2^(k-1)) of the level below, in their order. A suffix whose
prefix is met once is settled and leaves; only suffixes in runs of equal rank go on, as only they can share more.

A longest-common-prefix interval of depth m, the suffixes that share their first m lines, is named by m and by the ranks of two
prefixes of 2^k <= m lines that overlap to m. A run of lines counts when it has at least `min_words` words. Each line is tried with the
shortest such run that starts at it and the shortest that ends at it: a repeated run of that many words is covered by these exactly. In
each interval the first run, by doc_id and line, stays; the lines of all later ones are deleted. Copies may overlap in a document.

A null text has no lines and stays null; an empty one is one empty line. Documents that repeat a doc_id, or have none, are
put in order by doc_id (none first) and text; of wholly equal ones any may be the first. Texts of any length are read whole, a few at
a time. Extra columns are passed on, but for those that the counts replace. A document may lose all its lines; its text is then
empty. An empty table gives an empty result. doc_id has to be of an integer type, or repeated (then of any type).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, slices


@dataclass(frozen=True)
class LineDedupParams:
    min_words: int = 50
    #: Rows of a class from which on they aren't shuffled to one task, and classes of this kind that may be broadcast.
    heavy: int = 500
    broadcast_classes: int = 100_000


def lines_of(documents: DataFrame) -> DataFrame:
    """doc, i, h1, h2 (a 128-bit line id), w (words) of every line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for b in slices(batches):
            doc, i, h1, h2, w = [], [], [], [], []
            for d, t in zip(b["doc"].to_pylist(), b["text"].to_pylist(), strict=True):
                if t is None:
                    continue
                lines = t.encode("utf-8", "surrogatepass").split(b"\n")
                doc += [d] * len(lines)
                i += range(len(lines))
                for x in lines:
                    h = digest(x)
                    h1.append((h >> 64) - (1 << 63))
                    h2.append((h & (1 << 64) - 1) - (1 << 63))
                    w.append(len(x.split()))
            yield pa.RecordBatch.from_pydict({"doc": pa.array(doc, pa.int64()), "i": pa.array(i, pa.int32()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "w": pa.array(w, pa.int32())})

    return documents.select("doc", "text").mapInArrow(run, "doc long, i int, h1 long, h2 long, w int")


def joined(rows: DataFrame, classes: DataFrame, keys: list[str], p: LineDedupParams) -> DataFrame:
    """rows and classes (keys, c, more), joined by the keys; c is a class's number of rows. Classes of more than p.heavy rows, of which
    there is one for so many rows at most, are broadcast if they are counted to be few enough, and their rows aren't shuffled."""
    big = classes.where(F.col("c") > p.heavy)
    n = big.count()
    if not n or n > p.broadcast_classes:
        return rows.join(classes, keys)
    rest = rows.join(F.broadcast(big.select(keys)), keys, "left_anti").join(classes.where(F.col("c") <= p.heavy), keys)
    return rows.join(F.broadcast(big), keys).select(rest.columns).unionByName(rest)


def ranked(rows: DataFrame, x: str, y: str, keep: list[str], scratch: Scratch, p: LineDedupParams) -> DataFrame:
    """`keep` and r, the rank of (x, y), of the rows whose (x, y) is met again. Classes are counted before they are sorted by range, and
    ranks come back by a join that deals the rows of very large classes. Ranks have gaps; only their order counts."""
    classes = rows.groupBy(x, y).agg(F.count("*").alias("c")).where("c > 1")
    order = scratch.keep(classes.repartitionByRange(x, y).sortWithinPartitions(x, y).withColumn("r", F.monotonically_increasing_id()), "ranks")
    return joined(rows, order, [x, y], p).select(*keep, "r")


def double(level: DataFrame, step: int, scratch: Scratch, p: LineDedupParams) -> DataFrame:
    """doc, i, r of the next level: prefixes of 2 * step lines."""
    there = Window.partitionBy("doc").orderBy("i").rangeBetween(step, step)
    pairs = level.select("doc", "i", F.col("r").alias("r1"), F.max("r").over(there).alias("r2")).where("r2 IS NOT NULL")
    return ranked(scratch.keep(pairs, "pairs"), "r1", "r2", ["doc", "i"], scratch, p)


def runs_of(stretches: DataFrame, p: LineDedupParams) -> DataFrame:
    """doc, i, m (lines), k (floor of log2 m), j (start of the second overlapping prefix): of each line of a stretch the shortest run
    of enough words from it, and up to it."""
    least = p.min_words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, lines in zip(b["doc"].to_pylist(), b["lines"].to_pylist(), strict=True):
                w, first = [x["w"] for x in lines], lines[0]["i"]
                found, end, total = set(), 0, 0
                for s in range(len(w)):
                    while end < len(w) and total < least:
                        total += w[end]
                        end += 1
                    if total < least:
                        break
                    found.add((s, end))
                    total -= w[s]
                start, total = len(w), 0
                for e in range(len(w), 0, -1):
                    while start > 0 and total < least:
                        start -= 1
                        total += w[start]
                    if total < least:
                        break
                    found.add((start, e))
                    total -= w[e - 1]
                for s, e in sorted(found):
                    k = (e - s).bit_length() - 1
                    out.append((d, first + s, e - s, k, first + e - (1 << k)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("doc", "i", "m", "k", "j"), cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)})

    return stretches.mapInArrow(run, "doc long, i int, m int, k int, j int")


def later_copies(documents: DataFrame, scratch: Scratch, p: LineDedupParams) -> DataFrame:
    """doc, cuts: the lines to delete, as joined [a, b) intervals."""
    rows = scratch.keep(lines_of(documents), "lines")
    level = scratch.keep(ranked(rows, "h1", "h2", ["doc", "i", "w"], scratch, p), "level0")
    scratch.drop(rows)
    # Neighbouring lines that are all met again, with enough words: nothing outside of these can repeat.
    level = level.withColumn("stretch", F.col("i") - F.row_number().over(Window.partitionBy("doc").orderBy("i")))
    level = level.withColumn("words", F.sum("w").over(Window.partitionBy("doc", "stretch"))).where(F.col("words") >= p.min_words)
    level = scratch.keep(level.select("doc", "stretch", "i", "w", "r"), "stretches")
    stretches = level.groupBy("doc", "stretch").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("lines")).select("doc", "lines")
    runs = scratch.keep(runs_of(stretches, p), "runs")
    deepest = runs.agg(F.max("k")).first()[0]
    level, later, k = level.select("doc", "i", "r"), None, 0
    while deepest is not None and k <= deepest:
        own = runs.where(F.col("k") == k).join(level.withColumnRenamed("r", "ra"), ["doc", "i"]).join(level.select("doc", F.col("i").alias("j"), F.col("r").alias("rb")), ["doc", "j"])
        own = scratch.keep(own.select("doc", "i", "m", "ra", "rb"), f"intervals{k}")
        first = own.groupBy("m", "ra", "rb").agg(F.min(F.struct("doc", "i")).alias("first"), F.count("*").alias("c")).where("c > 1")
        first = scratch.keep(first, f"firsts{k}")
        copies = scratch.keep(joined(own, first, ["m", "ra", "rb"], p).where("doc <> first.doc OR i <> first.i").select("doc", "i", "m"), f"copies{k}")
        scratch.drop(own, first)
        later = copies if later is None else later.unionByName(copies)
        if k < deepest:
            level = scratch.keep(double(level, 1 << k, scratch, p), f"level{k + 1}")
            if level.isEmpty():
                break
        k += 1
    if later is None:
        later = runs.select("doc", "i", "m").where("false")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, cuts = b["doc"], []
            for own in b["own"].to_pylist():
                out: list[list[int]] = []
                for x in sorted((x["i"], x["i"] + x["m"]) for x in own):
                    if out and x[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], x[1])
                    else:
                        out.append(list(x))
                cuts.append([{"a": a, "b": e} for a, e in out])
            yield pa.RecordBatch.from_pydict({"doc": docs, "cuts": pa.array(cuts, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    return later.groupBy("doc").agg(F.collect_set(F.struct("i", "m")).alias("own")).mapInArrow(join, "doc long, cuts array<struct<a int, b int>>")


def dedup(documents: DataFrame, p: LineDedupParams = LineDedupParams(), counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The documents with later copies of runs deleted from text, and n_lines, n_removed under the names in `counts` (columns of these
    names are replaced). Other columns stay as they are."""
    scratch = Scratch(documents.sparkSession, "line-dedup")
    plain = documents.where("doc_id IS NULL").isEmpty() and documents.groupBy("doc_id").count().where("count > 1").isEmpty()
    key = F.col("doc_id").cast("long") if plain else F.monotonically_increasing_id()
    whole = F.struct(*documents.columns)
    docs = documents.select(key.alias("doc"), whole.alias("row"))
    if not plain:  # a place in the input has to be written down to stay the same
        docs = scratch.keep(docs.repartitionByRange("row.doc_id", "row.text").sortWithinPartitions("row.doc_id", "row.text").select(F.monotonically_increasing_id().alias("doc"), "row"), "numbered")
    cuts = scratch.keep(later_copies(docs.select("doc", F.col("row.text").alias("text")), scratch, p), "cuts")
    joined = docs.join(cuts, "doc", "left").withColumn("lines", F.when(F.col("cuts").isNotNull(), F.split("row.text", "\n", -1)))
    left = F.expr("array_join(filter(lines, (x, i) -> NOT exists(cuts, c -> i >= c.a AND i < c.b)), '\\n')")
    text = F.when(F.col("cuts").isNotNull(), left).otherwise(F.col("row.text"))
    own = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in counts]
    n = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"), F.lit(""))) + 1)
    removed = F.coalesce(F.aggregate("cuts", F.lit(0), lambda s, c: s + c["b"] - c["a"]), F.lit(0))
    return joined.select(*own, n.cast("long").alias(counts[0]), removed.cast("long").alias(counts[1]))


def drop_copies(documents: DataFrame, p: LineDedupParams = LineDedupParams()) -> DataFrame:
    """Pipeline form: documents with their shortened texts; n_chars, where there is one, is counted anew. Documents whose every word was a
    later copy go; those without words before stay."""
    done = dedup(documents, p, ("_lines_before", "_lines_gone")).where(~((F.col("_lines_gone") > 0) & (F.regexp_replace(F.col("text"), SPACES, "") == "")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("_lines_gone") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return done.select(documents.columns)


#: The same in DuckDB SQL, for the default parameters and unique doc_ids.
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]'), lambda s: s <> '')) AS w FROM x),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM w),
f AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY ALL),
g AS (SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY ALL),
r AS (SELECT doc_id, s, e FROM f UNION SELECT doc_id, s, e FROM g),
t AS (SELECT r.doc_id, s, e, row_number() OVER (PARTITION BY array_to_string(l[s:e], chr(10)) ORDER BY r.doc_id, s) AS n FROM r JOIN d ON r.doc_id = d.doc_id),
k AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM t WHERE n > 1),
o AS (SELECT x.doc_id, count(*) AS n_lines, count(k.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY x.i) FILTER (WHERE k.i IS NULL), '') AS text FROM x LEFT JOIN k ON x.doc_id = k.doc_id AND x.i = k.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE o.text END AS text FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""
