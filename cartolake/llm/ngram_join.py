"""N-gram Jaccard join by a tree of count vectors.

A document is the set of its distinct word shingles. Shingles are hashed to groups, and a set's group counts are a point. The summed
minima of two points' coordinates bound the sets' overlap from above; with the boxes of a tree over the points, a box's greatest
coordinates take the place of the point's.

The tree's root is dealt over the cluster by its finest coordinates (64-bit groups, one shingle each in practice). A set of n
shingles reaches the similarity t only with an overlap of t * n, so its summed minima with any box that lacks n - t * n + 1 of its
shingles are too small: it's filed in the boxes of that many of its shingles and meets all its partners there. The rarest ones are
taken (all occurrences are counted by 2^bits groups beforehand; the order only decides how full the boxes get), so a passage that
unrelated texts share fills none. In a box:

1. Points of a few groups go along. All members are tried by them against the one whose filed shingles are the commonest, the
   centre of a family of near copies; of a few members, all pairs are. Boxes of very many members are dealt into parts with
   centres of their own, whose centres are tried against one of them. What the bound leaves is verified.
2. Linked members are components. Only boxes of many whose members lie in several components need more: a tree of coarse points is
   bulk-loaded, components together, and joined with itself; two subtrees part where they are one component, or where sizes or
   summed minima of their boxes exclude the similarity. Boxes with more than `block` members have several trees, joined in pairs.

Surviving pairs of different components are verified on the whole sets. No link between different components is left untested, so components are exact.

Texts with equal sets are one node, whose copies only take its component. A null or empty text has no shingles and is linked with
nothing; a text shorter than a shingle is one shingle. Texts of any length are read whole, a few at a time. Repeated doc_ids are
separate rows in a shared class; rows without a doc_id get no component of their own, but that of an equal text. Of ties the least
doc_id names a component. Extra columns, whatever their names, aren't read. An empty table gives an empty result. doc_id has to be of
an integer type.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch, WordHashes, lower_words_of, mix, rolling, slices, writing
from .components import components


@dataclass(frozen=True)
class JoinParams:
    width: int = 5
    #: Similarity, as a fraction.
    over: int = 80
    under: int = 100
    #: Occurrences are counted in 2^bits groups; a byte each is sent to the workers.
    bits: int = 20
    #: Boxes of possibly more members are dealt into parts of about this many.
    part: int = 4096
    #: Groups of the coarse point, and of the smaller one that goes along to the boxes (a divisor); children of a box of the tree.
    coarse: int = 128
    fine: int = 32
    fan: int = 16
    #: Members up to which a box's pairs are listed without a tree, and members that are joined in one task.
    small: int = 8
    block: int = 2048
    #: Nodes (8 bytes each) that may be broadcast.
    broadcast_nodes: int = 1_000_000

    def needed(self, n: np.ndarray) -> np.ndarray:
        """The least overlap that a set of n shingles needs."""
        return -(-self.over * n // self.under)


def _texts(batches: Iterable[pa.RecordBatch], width: int, hashes: WordHashes) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches, with each text's shingles, as often as they occur."""
    for part in slices(batches):
        words = [lower_words_of(t) for t in part["text"].to_pylist()]
        sizes = [len(w) for w in words]
        every = hashes([w for own in words for w in own])
        runs, out, end = rolling(every, width), [], 0
        for n in sizes:
            end += n
            out.append(runs[end - n : end - width + 1] if n >= width else rolling(every[end - n : end], max(n, 1)))
        yield part, out


def _set(runs: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles."""
    if len(runs) < 2:
        return runs
    s = np.sort(runs)
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def _add(rows: Iterable[pa.RecordBatch], groups: int) -> np.ndarray:
    total = np.zeros(groups, np.uint64)
    for b in rows:
        for x in b["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint64)
    return total


def _blob(counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"counts": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())})


def commonness(documents: DataFrame, p: JoinParams) -> bytes:
    """How often the shingles of each group occur in all documents, as 4 * log2(1 + count) in a byte, deflated: a table of fixed size.
    Each task adds up its own documents; the sums are added in two steps."""
    groups = 1 << p.bits

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups, np.uint64)
        for _, texts in _texts(batches, p.width, WordHashes()):
            np.add.at(total, (np.concatenate(texts) >> np.uint64(64 - p.bits)).astype(np.int64), np.uint64(1))
        yield _blob(total)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _blob(_add(batches, groups))

    def classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _add(batches, groups)
        level = np.minimum(255, 4 * np.log2(1 + total.astype(np.float64))).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([zlib.compress(level.tobytes(), 6)], pa.binary())})

    one = documents.select("text").mapInArrow(count, "counts binary").repartition(16).mapInArrow(add, "counts binary")
    with writing(documents.sparkSession):
        return bytes(one.repartition(1).mapInArrow(classes, "counts binary").first()[0])


def parts_of(level: np.ndarray, p: JoinParams) -> np.ndarray:
    """log2 of the parts that a box of a group of each level is dealt into: its count over p.part, but for what an even spread brings."""
    count = np.exp2(np.arange(257) / 4)
    even = count[level].mean() * 4
    return np.clip(np.floor(np.log2(count / max(p.part, even))), 0, 40).astype(np.int64)


def filed(s: np.ndarray, level: np.ndarray, parts: np.ndarray, p: JoinParams) -> tuple[np.ndarray, int]:
    """The boxes of a set (58 bits of a shingle, then log2 of the box's parts) and how common their shingles are."""
    of = level[(s >> np.uint64(64 - p.bits)).astype(np.int64)]
    order = (of.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    k = len(s) - int(p.needed(len(s))) + 1
    first = np.argpartition(order, k - 1)[:k] if k < len(s) else np.arange(len(s))
    own = of[first]
    return (s[first] & ~np.uint64(63)) | parts[own].astype(np.uint64), int(16 * own.mean())


def point_of(s: np.ndarray, groups: int) -> bytes:
    """Counts of the coarse groups in a byte each; 255 stands for that and more."""
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % groups, minlength=groups), 255).astype(np.uint8).tobytes()


def bounded(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, p: JoinParams) -> np.ndarray:
    """True where sizes and the summed minima of two points allow similarity over / under. a, b: a point in the last axis."""
    least = np.minimum(a, b)
    most = least.sum(axis=-1, dtype=np.int64) + (1 << 40) * (least == 255).any(axis=-1)
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (p.under * low >= p.over * high) & (p.under * most >= p.over * (na + nb - np.minimum(most, na + nb)))


def sketch(documents: DataFrame, common: bytes, p: JoinParams) -> DataFrame:
    """doc_id, n, f1, f2 (the set's fingerprint), point, boxes, rank (how common the boxes' shingles are)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zlib.decompress(common), np.uint8)
        parts = parts_of(level, p)
        for part, texts in _texts(batches, p.width, WordHashes()):
            n, f1, f2, point, boxes, rank = [], [], [], [], [], []
            for runs in texts:
                s = _set(runs)
                n.append(len(s))
                if not len(s):
                    for x in (f1, f2, point, boxes, rank):
                        x.append(None)
                    continue
                with np.errstate(over="ignore"):
                    f1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).view(np.int64)))
                point.append(point_of(s, p.coarse))
                own, r = filed(s, level, parts, p)
                boxes.append(own.tobytes())
                rank.append(r)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part["doc_id"], "n": pa.array(n, pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()),
                "point": pa.array(point, pa.binary()), "boxes": pa.array(boxes, pa.binary()), "rank": pa.array(rank, pa.int32()),
            })

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, f1 long, f2 long, point binary, boxes binary, rank int")


def members(nodes: DataFrame, p: JoinParams) -> DataFrame:
    """box, part, rank, node, n, q (a point of p.fine groups) of all nodes' boxes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = [np.frombuffer(c, np.int64) for c in part["boxes"].to_pylist()]
                times = [len(g) for g in got]
                coarse = np.frombuffer(b"".join(part["point"].to_pylist()), np.uint8).astype(np.int64).reshape(len(got), -1, p.fine)
                q = np.repeat(np.minimum(coarse.sum(axis=1), 255).astype(np.uint8), times, axis=0)
                box = np.concatenate(got)
                node, rank, n = (np.repeat(part[k].to_numpy(zero_copy_only=False), times) for k in ("node", "rank", "n"))
                own = (mix(node.view(np.uint64)) >> np.uint64(23)).astype(np.int64) & ((np.int64(1) << (box & 63)) - 1)
                ends = np.arange(len(box) + 1, dtype=np.int32) * p.fine
                points = pa.Array.from_buffers(pa.binary(), len(box), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(q.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(box), pa.array(own), pa.array(rank), pa.array(node), pa.array(n), points], ["box", "part", "rank", "node", "n", "q"])

    return nodes.select("node", "rank", "n", "point", "boxes").mapInArrow(run, "box long, part long, rank int, node long, n long, q binary")


class _Rows:
    """Rows of boxes as arrays."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns
        self.box, self.part, self.node, self.n, self.q = columns

    @classmethod
    def of(cls, b: pa.RecordBatch, p: JoinParams) -> _Rows:
        return cls([*(b[k].to_numpy() for k in ("box", "part", "node", "n")), np.frombuffer(b"".join(b["q"].to_pylist()), np.uint8).reshape(-1, p.fine)])

    def __add__(self, other: _Rows) -> _Rows:
        return _Rows([np.concatenate(x) for x in zip(self.columns, other.columns, strict=True)])

    def __getitem__(self, at) -> _Rows:
        return _Rows([x[at] for x in self.columns])

    def __len__(self) -> int:
        return len(self.box)

    def near(self, a: np.ndarray, b: np.ndarray, p: JoinParams) -> np.ndarray:
        return bounded(self.n[a], self.n[b], self.q[a], self.q[b], p)


_SHARED = pa.schema([("kind", pa.int8()), ("box", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _out(kind: int, box: np.ndarray | int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(np.broadcast_to(box, len(a)).astype(np.int64)), pa.array(a), pa.array(b)], schema=_SHARED)


#: Kinds of rows of `shared`: a pair with its box's center, another pair; a member b of a box whose center a it may be similar to, one that can't.
PAIR, OTHER, MEMBER, STRANGER = 0, 1, 2, 3


def shared(rows: DataFrame, p: JoinParams) -> DataFrame:
    """kind, box, a, b. The rows of boxes are shuffled and sorted once, by descending rank within a part of a box, and read off as they
    pass by; the first one is the part's center. Of a box of up to p.small members the pairs that their points allow come out, of
    larger and of dealt ones the members."""

    def runs(rows: _Rows, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole parts of boxes, from row `first` to before row `last`."""
        size, dealt = last - first, (rows.box[first] & 63) > 0
        for j in range(1, p.small):
            for i in range(j):
                at = first[(size > j) & (size <= p.small) & ~dealt]
                own = rows.near(at + i, at + j, p)
                if own.any():
                    yield _out(OTHER if i else PAIR, 0, rows.node[at[own] + i], rows.node[at[own] + j])
            if not len(at):
                break
        many = dealt | (size > p.small)
        if many.any():
            of = np.repeat(first[many], size[many])
            x = of + np.arange(len(of)) - np.repeat(np.cumsum(size[many]) - size[many], size[many])
            yield from placed(rows[x], rows.node[of], rows.near(x, of, p))

    def placed(rows: _Rows, center: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        for kind, own in ((MEMBER, near), (STRANGER, ~near)):
            if own.any():
                yield _out(kind, rows.box[own], center[own], rows.node[own])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Rows | None = None  # rows of a part that the next batch may go on with
        large: _Rows | None = None  # the center of a part of more rows than are held
        for b in batches:
            if not b.num_rows:
                continue
            rows = _Rows.of(b, p)
            if large is not None:
                other = (rows.box != large.box[0]) | (rows.part != large.part[0])
                on = int(np.argmax(other)) if other.any() else len(rows)
                if on:
                    both = large + rows[:on]
                    own = np.arange(1, on + 1)
                    yield from placed(rows[:on], np.full(on, large.node[0]), both.near(own, np.zeros(on, np.int64), p))
                if on == len(rows):
                    continue
                rows, large = rows[on:], None
            if held is not None:
                rows = held + rows
            start = np.flatnonzero(np.concatenate([[True], (rows.box[1:] != rows.box[:-1]) | (rows.part[1:] != rows.part[:-1])]))
            tail = int(start[-1])
            yield from runs(rows, start[:-1], start[1:])
            held = rows[tail:]
            if len(held) > p.small:
                yield from runs(held, np.zeros(1, np.int64), np.array([len(held)]))
                large, held = held[:1], None
        if held is not None:
            yield from runs(held, np.zeros(1, np.int64), np.array([len(held)]))

    dealt = rows.repartition("box", "part").sortWithinPartitions("box", "part", F.col("rank").desc(), "node")
    return dealt.select("box", "part", "node", "n", "q").mapInArrow(run, "kind byte, box long, a long, b long")


def sets(texts: DataFrame, p: JoinParams) -> DataFrame:
    """node, shingles (sorted unsigned 64-bit)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _texts(batches, p.width, WordHashes()):
            yield pa.RecordBatch.from_pydict({"node": part["node"], "shingles": pa.array([_set(s).tobytes() for s in own], pa.binary())})

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def similar(a: bytes, b: bytes, p: JoinParams) -> bool:
    na, nb = len(a) // 8, len(b) // 8
    both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    both.sort(kind="stable")
    i = int((both[1:] == both[:-1]).sum())
    return p.under * i >= p.over * (na + nb - i)


def prune(pairs: DataFrame, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) that the bound allows."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("qa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("qb"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qa, qb = (np.frombuffer(b"".join(b[k].to_pylist()), np.uint8).reshape(-1, p.coarse) for k in ("qa", "qb"))
            own = b.filter(pa.array(bounded(b["na"].to_numpy(), b["nb"].to_numpy(), qa, qb, p)))
            yield pa.RecordBatch.from_pydict({"a": own["a"], "b": own["b"]})

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "qa", "qb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, documents: DataFrame, scratch: Scratch, p: JoinParams) -> DataFrame:
    """The pairs (a, b) that are links. Only the texts of these are read again. The wanted nodes are counted: up to
    p.broadcast_nodes they are broadcast, so that no text is shuffled to find them; beyond that both sides are."""
    need = scratch.keep(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "need")
    wanted = F.broadcast(need) if need.count() <= p.broadcast_nodes else need
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node", "left_semi")
    whole = scratch.keep(sets(texts, p).dropDuplicates(["node", "shingles"]), "sets")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.filter(pa.array([similar(x, y, p) for x, y in zip(b["sa"].to_pylist(), b["sb"].to_pylist(), strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_pydict({"a": own["a"], "b": own["b"]})

    left, right = whole.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), whole.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    links = scratch.keep(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct(), "links")
    scratch.drop(whole, need)
    return links


class Tree:
    """An R-tree of points in bulk-loaded order. Level 0 holds the points; each box above covers `fan` neighbours of the level below by
    their greatest coordinates, their least and greatest size, and their component if they have only one (else -1)."""

    def __init__(self, comp: np.ndarray, n: np.ndarray, points: np.ndarray, fan: int):
        self.fan, self.levels = fan, [(comp, n, n, points)]
        while len(self.levels[-1][0]) > 1:
            c, low, high, top = self.levels[-1]
            at = np.arange(0, len(c), fan)
            least, most = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            self.levels.append((np.where(least == most, least, -1), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(top, at, axis=0)))

    def children(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places on the level below of the boxes i, and for each the index into i."""
        first = i * self.fan
        size = np.minimum(self.fan, len(self.levels[level - 1][0]) - first)
        of = np.repeat(np.arange(len(i)), size)
        return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def may_meet(a: tuple, b: tuple, p: JoinParams) -> np.ndarray:
    """Whether boxes may hold similar sets of different components: (component, least size, greatest size, greatest coordinates) each."""
    most = np.minimum(a[3], b[3])
    bound = most.sum(axis=-1, dtype=np.int64) + (1 << 40) * (most == 255).any(axis=-1)
    least = np.maximum(p.needed(a[1]), p.needed(b[1]))
    fits = (p.under * a[2] >= p.over * b[1]) & (p.under * b[2] >= p.over * a[1]) & (bound >= least)
    return fits & ~((a[0] == b[0]) & (a[0] >= 0))


def tree_pairs(left: Tree, right: Tree, p: JoinParams, chunk: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of points in different components that sizes and summed minima allow. Pairs of boxes are opened level by level, the
    later ones of a level after the earlier ones' points, in chunks of bounded size."""
    todo = [(len(left.levels) - 1, len(right.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        u, v, i, j = todo.pop()
        if len(i) > chunk:
            todo.append((u, v, i[chunk:], j[chunk:]))
            i, j = i[:chunk], j[:chunk]
        a, b = tuple(x[i] for x in left.levels[u]), tuple(x[j] for x in right.levels[v])
        own = may_meet(a, b, p)
        i, j = i[own], j[own]
        if not len(i):
            continue
        if u == 0 and v == 0:
            fine = bounded(left.levels[0][1][i], right.levels[0][1][j], left.levels[0][3][i], right.levels[0][3][j], p)
            yield i[fine], j[fine]
            continue
        step = max(1, chunk // (p.fan * p.fan))
        for at in range(0, len(i), step):
            x, y, nu, nv = i[at : at + step], j[at : at + step], u, v
            if u >= v:
                x, of = left.children(u, x)
                y, nu = y[of], u - 1
            if v >= u:
                y, of = right.children(v, y)
                x, nv = x[of], v - 1
            todo.append((nu, nv, x, y))


def _named(rows: DataFrame, column: str, comp: DataFrame) -> DataFrame:
    """The rows with the component of a node as <column>_comp."""
    own = comp.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return rows.join(own, column, "left").withColumn(f"{column}_comp", F.coalesce("_c", column)).drop("_c")


def _apart(held: DataFrame, comp: DataFrame, scratch: Scratch, p: JoinParams) -> DataFrame:
    """box, node, comp, size, main, rest of the members of boxes that lie in several components: the commonest of these in the box,
    and how many members are in others. Members of a box and component are counted before boxes are; up to p.broadcast_nodes boxes are
    broadcast, so that the members of a large one aren't shuffled to one task."""
    now = scratch.keep(_named(held.select("box", F.col("b").alias("node")), "node", comp).withColumnRenamed("node_comp", "comp"), "placed")
    each = now.groupBy("box", "comp").agg(F.count("*").alias("c"))
    boxes = each.groupBy("box").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("x")).where("x.c < size AND size > 2")
    boxes = scratch.keep(boxes.select("box", "size", F.col("x.comp").alias("main"), (F.col("size") - F.col("x.c")).alias("rest")), "boxes")
    return now.join(F.broadcast(boxes) if boxes.count() <= p.broadcast_nodes else boxes, "box")


def _far_pairs(apart: DataFrame, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """Pairs in different components that share a box of many members. One of them isn't of the box's main component: trees of those
    are joined with trees of all members, about p.block points each, two by two."""
    rows = apart.withColumn("i", F.ceil(F.col("rest") / p.block).cast("int")).withColumn("j", F.ceil(F.col("size") / p.block).cast("int"))
    rows = rows.join(nodes.select("node", "n", "point"), "node").withColumn("h", F.xxhash64("node"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return side.select("box", F.pmod(F.col("h"), F.col(own)).cast("int").alias(own), every, F.lit(own == "i").alias("left"), (F.col("comp") != F.col("main")).alias("strays"), "node", "comp", "n", "point").select("box", "i", "j", "left", "strays", "node", "comp", "n", "point")

    both = dealt(rows.where("comp <> main"), "i", "j").unionByName(dealt(rows, "j", "i"))

    def run(table: pa.Table) -> pa.Table:
        left, strays, node, comp, n = (table[k].to_numpy() for k in ("left", "strays", "node", "comp", "n"))
        q = np.frombuffer(b"".join(table["point"].to_pylist()), np.uint8).reshape(-1, p.coarse)
        place = [x[np.lexsort((n[x], comp[x]))] for x in (np.flatnonzero(left), np.flatnonzero(~left))]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if all(len(x) for x in place):
            for x, y in tree_pairs(*[Tree(comp[x], n[x], q[x], p.fan) for x in place], p):
                x, y = place[0][x], place[1][y]
                once = ~strays[y] | (node[x] > node[y])  # two strays meet both ways
                x, y = node[x[once]], node[y[once]]
                a.append(np.maximum(x, y))
                b.append(np.minimum(x, y))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return both.groupBy("box", "i", "j").applyInArrow(run, "a long, b long")


def groups(documents: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach, itself included), n_copies (documents with the same set)."""
    if not isinstance(documents.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be of an integer type")
    scratch = Scratch(documents.sparkSession, "ngram-join")
    wide = scratch.keep(sketch(documents, commonness(documents, p), p), "sketches")
    found = wide.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min_by(F.struct("doc_id", "n", "point", "boxes", "rank"), "doc_id").alias("x"), F.count("*").alias("n_copies"))
    nodes = scratch.keep(found.select("f1", "f2", F.col("x.doc_id").cast("long").alias("node"), "x.n", "x.point", "x.boxes", "x.rank", "n_copies"), "nodes")
    sketches = scratch.keep(wide.select("doc_id", "n", "f1", "f2"), "sets")
    scratch.drop(wide)

    held = scratch.keep(shared(members(nodes, p), p), "shared")
    slim = scratch.keep(nodes.drop("boxes", "rank"), "points")
    scratch.drop(nodes)
    nodes = slim
    ordered = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Centers of a dealt box's parts: at most its members over p.part. One of them is tried against the others.
    centers = held.where(F.col("kind").isin(MEMBER, STRANGER) & (F.col("box").bitwiseAND(63) > 0)).select("box", "a").distinct()
    tops = centers.join(centers.groupBy("box").agg(F.min("a").alias("b")), "box")
    star = held.where(F.col("kind").isin(PAIR, MEMBER)).select("a", "b").unionByName(tops.select("a", "b")).where("a <> b").select(*ordered).distinct()
    tried = scratch.keep(prune(star, nodes, p), "pairs")
    links = verify(tried, documents, scratch, p)

    comp = components(links, scratch)
    others = held.where(F.col("kind") == OTHER).select(*ordered).distinct()
    others = _named(_named(others, "a", comp), "b", comp).where("a_comp <> b_comp").select("a", "b")
    apart = scratch.keep(_apart(held.where(F.col("kind").isin(MEMBER, STRANGER)), comp, scratch, p), "apart")
    few = apart.where(F.col("size") <= p.small).select("box", "node", "comp")
    listed = few.alias("x").join(few.alias("y"), "box").where("x.node > y.node AND x.comp <> y.comp").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    far = _far_pairs(apart.where(F.col("size") > p.small), nodes, p)
    more = prune(listed.unionByName(others).distinct(), nodes, p).unionByName(far).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(verify(scratch.keep(more, "more"), documents, scratch, p))

    comp = components(links, scratch)
    named = nodes.join(comp, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component"), "n_copies")
    return sketches.join(named, ["f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", F.col("doc_id").cast("long")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one(documents: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """Pipeline form: of each component the document with the least doc_id stays; documents without a doc_id stay."""
    gone = groups(documents, p).where("doc_id <> component_id").select("doc_id")
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)
