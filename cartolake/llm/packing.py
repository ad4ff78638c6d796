"""Packing into sequences of at most `capacity` tokens by linear grouping, then best fit.

1. Tokenize; cut only texts longer than the capacity. All pieces of one length are alike to a packer, so the plan is made on the
   histogram of lengths, which has at most `capacity` rows whatever the corpus holds.
2. Linear grouping: the large pieces, longest first, fall into groups of equal cardinality; each group counts as its longest.
   Configurations of these few sizes are chosen, each the fullest one with the largest size left, and used as often as supply allows.
3. The actual pieces take the slots of their groups, which leaves each sequence with its real free room; small pieces go, longest
   first, where they fit best. The plan is a list of runs (length, first rank, number, first sequence, offset).
4. Each piece's rank among those of its length finds its run. Ranks come from counts per (length, slice) and row numbers within a
   slice, so that one common length is no task's burden.

A null or empty text is one piece holding just the end id. Repeated rows are pieces of their own.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices


@dataclass(frozen=True)
class PackingParams:
    capacity: int = 4096
    end_id: int = 1
    #: Pieces longer than this share of the capacity are large: of these shares, the one whose plan needs the fewest sequences is taken.
    large_shares: tuple[float, ...] = (0.25, 0.35, 0.5)
    #: So many groups of equal cardinality.
    groups: int = 256
    #: Words whose ids each worker remembers, and twice as many parts.
    cache_words: int = 250_000


class WordTokens:
    """Ids of whole texts, put together from those of their words. This vocabulary's splitter never joins what white space parts
    and drops the white space itself, so the ids of a text are those of its words in a row; and those of a word are those of its
    parts (letters, a digit, other signs). Words and parts already met are looked up; only new parts are encoded."""

    #: One for each worker process, which serves many tasks: the file is read once, and words stay known.
    _own: dict = {}
    #: The splitter's pattern, after lower-casing; a word that holds anything besides these classes is encoded whole.
    _PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[\p{P}\p{S}\p{M}]+")
    _PLAIN = regex.compile(r"[\p{L}\p{N}\p{P}\p{S}\p{M}]+")

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.words, self.parts = Tokenizer.from_file(path), limit, {}, {}
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of_worker(cls, path: str, limit: int) -> WordTokens:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, limit) not in cls._own:
            cls._own[path, limit] = cls(path, limit)
        return cls._own[path, limit]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.encode(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of new parts, encoded in one string: each part's last token is marked as a word's end in the vocabulary."""
        plain = [x for x in parts if x.isalpha() or self._PLAIN.fullmatch(x)]
        ids = np.array(self._one(" ".join(plain)), "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(plain):
            return dict(zip(parts, self._encode(parts), strict=True))
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        out = {x: raw[at[i] : at[i + 1]] for i, x in enumerate(plain)}
        rest = [x for x in parts if x not in out]
        return out | dict(zip(rest, self._encode(rest), strict=True)) if rest else out

    def _one(self, text: str) -> list[int]:
        return self.encode([text], add_special_tokens=False)[0].ids if text else []

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met before."""
        split, new = [], {}
        for w in words:
            t = w.decode("utf-8", "replace")
            own = [t] if t.isalpha() or not self._PLAIN.fullmatch(t) else self._PART.findall(t)
            split.append(own)
            for x in own:
                if x not in self.parts:
                    new[x] = None
        if new:
            new = self._parts(list(new))
        get = self.parts.get
        out = {w: b"".join([get(x) or new.get(x, b"") for x in own]) for w, own in zip(words, split, strict=True)}
        if (room := 2 * self.limit - len(self.parts)) > 0:
            self.parts.update(list(new.items())[:room])
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, split, whole = self.words, [], {}
        for i, t in enumerate(texts):
            t = t or ""
            if not t.isascii():
                t = unicodedata.normalize("NFC", t)
            if "<|" in t or "\u03a3" in t:  # special tokens keep their case, and a last sigma is lower-cased otherwise here
                whole[i] = t
                t = ""
            split.append(t.lower().encode("utf-8", "surrogatepass").split())
        missing = set().union(*split).difference(known)
        if missing:
            known.update(self._fresh(list(missing)))
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for w in missing:  # what doesn't fit is forgotten again
            if len(known) <= self.limit:
                break
            del known[w]
        for i, t in whole.items():
            out[i] = b"".join(self._encode([w.decode("utf-8", "replace") for w in t.encode("utf-8", "surrogatepass").split()]))
        return out


def pieces(documents: DataFrame, tokenizer_path: str, p: PackingParams = PackingParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, step = WordTokens.of_worker(tokenizer_path, p.cache_words), struct.pack("<I", p.end_id), 4 * p.capacity
        for part in slices(batches, 128):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tokens(part["text"].to_pylist())):
                ids += end
                for k, s in enumerate(range(0, len(ids), step)):
                    own = ids[s : s + step]
                    rows.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].take(pa.array(rows, pa.int32())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], supply: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(number of each size, times used) until the supply is gone. sizes: descending. Each step takes the largest size left and
    fills what it leaves free as far as it can (subset sums of what is left, larger sizes first), then repeats that as often as it can."""
    left, out = list(supply), []
    while any(left):
        first = next(i for i, n in enumerate(left) if n)
        room = capacity - sizes[first]
        best: dict[int, tuple[int, ...]] = {0: ()}  # sum: indices used
        for i in range(first, len(sizes)):
            have = left[i] - (i == first)
            if have <= 0 or sizes[i] > room:
                continue
            for total, used in list(best.items()):
                for k in range(1, min(have, (room - total) // sizes[i]) + 1):
                    best.setdefault(total + k * sizes[i], used + (i,) * k)
        chosen = (first, *best[max(best)])
        need = [chosen.count(i) for i in range(len(sizes))]
        times = min(left[i] // n for i, n in enumerate(need) if n)
        left = [a - n * times for a, n in zip(left, need, strict=True)]
        out.append((tuple(need), times))
    return out


def plan(histogram: dict[int, int], p: PackingParams = PackingParams()) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, number, first sequence, offset), and the number of sequences."""
    return min((_plan(histogram, p, share) for share in p.large_shares), key=lambda x: x[1])


def _plan(histogram: dict[int, int], p: PackingParams, share: float) -> tuple[np.ndarray, int]:
    c, rows, made = p.capacity, [], 0
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room: (first sequence, number)
    many = np.zeros(c + 1, np.int64)  # runs of each free room
    next_rank: dict[int, int] = defaultdict(int)

    def free(first: int, number: int, fill: int) -> None:
        if fill < c:
            rooms[c - fill].append((first, number))
            many[c - fill] += 1

    def put(length: int, number: int, first: int, offset: int) -> None:
        rows.append((length, next_rank[length], number, first, offset))
        next_rank[length] += number

    large = sorted((n for n in histogram if n > share * c), reverse=True)
    total = sum(histogram[n] for n in large)
    if total:
        size = -(-total // p.groups)
        supply: list[list[list[int]]] = []  # of each group: [length, number], longest first
        room = 0
        for n in large:
            count = histogram[n]
            while count:
                if not room:
                    supply.append([])
                    room = size
                m = min(count, room)
                supply[-1].append([n, m])
                count, room = count - m, room - m
        rounded: dict[int, list[list[int]]] = {}
        for g in supply:  # groups with the same longest piece are one size
            rounded.setdefault(g[0][0], []).extend(g)
        sizes = list(rounded)
        for need, times in configurations(sizes, [sum(m for _, m in rounded[s]) for s in sizes], c):
            slots = []
            for s, k in zip(sizes, need, strict=True):
                for _ in range(k):
                    slot, want = [], times
                    while want:
                        n, m = rounded[s][0]
                        took = min(m, want)
                        slot.append([n, took])
                        want -= took
                        rounded[s][0][1] -= took
                        if not rounded[s][0][1]:
                            rounded[s].pop(0)
                    slots.append(slot)
            done = 0
            while done < times:
                m, fill = min(s[0][1] for s in slots), 0
                for s in slots:
                    put(s[0][0], m, made, fill)
                    fill += s[0][0]
                    s[0][1] -= m
                    if not s[0][1]:
                        s.pop(0)
                free(made, m, fill)
                made, done = made + m, done + m
    for n in sorted((n for n in histogram if n <= share * c), reverse=True):
        count = histogram[n]
        while count:
            found = np.flatnonzero(many[n:])
            if len(found):
                room = n + int(found[0])
                first, number = rooms[room].pop()
                many[room] -= 1
                m = min(count, number)
                if m < number:
                    rooms[room].append((first + m, number - m))
                    many[room] += 1
                put(n, m, first, c - room)
                free(first, m, c - room + n)
                count -= m
            else:
                each = c // n
                number, rest = divmod(count, each)
                for k in range(each if number else 0):
                    put(n, number, made, k * n)
                if number:
                    free(made, number, each * n)
                made += number
                for k in range(rest):
                    put(n, 1, made, k * n)
                if rest:
                    free(made, 1, rest * n)
                    made += 1
                count = 0
    return np.array(rows or np.zeros((0, 5)), np.int64).reshape(-1, 5), made


def pack(documents: DataFrame, tokenizer_path: str, p: PackingParams = PackingParams()) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(documents.sparkSession, "packing")
    cut = scratch.keep(pieces(documents, tokenizer_path, p), "pieces")
    slices = max(16, cut.count() // 20_000)
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    counts = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, p)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("length", "slice", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32"))).join(before, ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] << 44 | runs[:, 1]
        for b in batches:
            length, rank = (b[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            cols = {k: b[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(runs[at, 3] + rank - runs[at, 1], pa.int64()), "offset": pa.array(runs[at, 4], pa.int64())})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
