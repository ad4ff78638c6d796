"""LM scoring by an interpolated modified Kneser-Ney bigram model.

Counting. Workers turn texts into word hashes and count the pairs (word before, word) of a few million tokens at a time, as sorted
arrays. The counts are dealt to parts by the first word, salted by the second so that one very common word is no part's burden,
and merged there. Each part writes its pairs as a sorted hash array and a count array, and deals what its pairs say of single words (counts,
number of different words before; total and number of pairs met once, twice, more often as a context) to parts by word, which are
written the same way. Files appear under their names only when complete, so a task that runs again changes nothing.

Scoring. Workers map the arrays into memory and look up the sorted queries of a batch of texts, part by part.

The order is 2: pairs of a corpus are some half of its tokens, triples nearly all of them, which the disk limit would not hold.
A text's tokens are its words, A-Z lower-cased, and one end. Null and empty texts are one end. Repeated rows count again. Rows without
a doc_id are scored but not learned from. With nothing to learn from, every probability is 1 / (distinct tokens + 1).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, bucket, lower_words_of, mix, slices, writing

#: Words are 48 bits of a hash: of a billion different ones some 1,800 pairs share theirs. START and END are longer than any word's.
WORD_BITS = np.uint64((1 << 48) - 1)
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000003)


@dataclass(frozen=True)
class LmParams:
    #: Parts for each so many characters of text, salts of a context, tokens counted or scored at a time.
    chars_per_part: int = 16_000_000
    salts: int = 8
    parts_per_salt: int = 64
    chunk: int = 1_000_000


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(before) + word * np.uint64(0x9E3779B97F4A7C15))


def pair_part(before: np.ndarray, word: np.ndarray, parts: int, salts: int) -> np.ndarray:
    return ((mix(before) >> np.uint64(33)) + (mix(word) >> np.uint64(40)) % np.uint64(salts) * np.uint64(parts // salts or 1)) % np.uint64(parts)


def word_part(word: np.ndarray, parts: int) -> np.ndarray:
    return (mix(word) >> np.uint64(33)) % np.uint64(parts)


def _group(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order and the sums of their values."""
    if not len(keys[0]):
        return keys, sums
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(s[order].astype(np.int64), at) for s in sums]


def _planes(a: np.ndarray, kind: str) -> bytes:
    """An array by places of its bytes, all first ones together, then all second ones, as these are alike and compress well."""
    return np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(len(a), -1).T).tobytes()


class _Reader:
    """Reads what _planes wrote."""

    def __init__(self, blob: bytes, at: int):
        self.blob, self.at = blob, at

    def __call__(self, n: int, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(self.blob, np.uint8, n * width, self.at).reshape(width, n)
        self.at += n * width
        return np.ascontiguousarray(raw.T).view(kind).ravel()


def _pack(keys: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    return np.int64(len(keys[0])).tobytes() + b"".join(_planes(k, "<u8") for k in keys) + b"".join(_planes(v, "<i8") for v in values)


def _unpack(blob: bytes, keys: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n, read = int(np.frombuffer(blob, "<i8", 1)[0]), _Reader(blob, 8)
    return [read(n, "<u8") for _ in range(keys)], [read(n, "<i8") for _ in range(values)]


def _pack_pairs(keys: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Pairs by their second word, which is written once for all its pairs; their first words, of which a part has few, are places in a
    list. Counts are four bytes."""
    befores, place = np.unique(keys[0], return_inverse=True)
    words, of = np.unique(keys[1], return_inverse=True)
    order = np.argsort(of, kind="stable")
    sizes = np.array([len(order), len(befores), len(words)], "<i8").tobytes()
    runs = _planes(np.bincount(of, minlength=len(words)), "<u4")
    return sizes + _planes(befores, "<u8") + _planes(words, "<u8") + runs + _planes(place[order], "<u4") + _planes(np.minimum(values[0][order], (1 << 32) - 1), "<u4")


def _unpack_pairs(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    (n, m, k), read = np.frombuffer(blob, "<i8", 3).tolist(), _Reader(blob, 24)
    befores, words, runs = read(m, "<u8"), read(k, "<u8"), read(k, "<u4")
    return [befores[read(n, "<u4")], np.repeat(words, runs)], [read(n, "<u4").astype(np.int64)]


def _deal(kind: int, part: np.ndarray, keys: list[np.ndarray], values: list[np.ndarray], pack=_pack) -> Iterator[pa.RecordBatch]:
    order = np.argsort(part, kind="stable")
    part, keys, values = part[order], [k[order] for k in keys], [v[order] for v in values]
    edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "part": pa.array([int(part[a])], pa.int32()), "blob": pa.array([pack([k[a:b] for k in keys], [v[a:b] for v in values])], pa.binary())})


def _place(where: str) -> tuple[object, str]:
    """File system and path of a folder."""
    from pyarrow import fs

    if "://" not in where and not where.startswith("file:"):
        return fs.LocalFileSystem(), where
    return fs.FileSystem.from_uri(where if not where.startswith("file:/") or where.startswith("file://") else "file://" + where[5:])


def write_arrays(where: str, **arrays: np.ndarray) -> None:
    """Each array in a file of its own, which gets its name when it is complete."""
    system, path = _place(where)
    system.create_dir(path, recursive=True)
    for name, a in arrays.items():
        half = f"{path}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(half) as f:
            f.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
        system.move(half, f"{path}/{name}")


def map_array(where: str, name: str, kind: str) -> np.ndarray:
    """A file mapped into memory. From a store that can't be mapped it is copied to a file without a name first."""
    from pyarrow import fs

    system, path = _place(where)
    info = system.get_file_info(f"{path}/{name}")
    if info.type == fs.FileType.NotFound or not info.size:
        return np.zeros(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", kind, "r")
    with tempfile.TemporaryFile() as f, system.open_input_stream(f"{path}/{name}") as source:
        while block := source.read(1 << 22):
            f.write(block)
        f.flush()
        return np.memmap(f, kind, "r")


class Model:
    """The arrays of a model's folder."""

    def __init__(self, where: str, parts: int, salts: int, totals: dict[str, int]):
        self.where, self.parts, self.salts, self.totals, self._open = where, parts, salts, totals, {}
        self.pair_discounts = self.discounts([totals.get(f"p{k}", 0) for k in range(1, 5)])
        self.word_discounts = self.discounts([totals.get(f"a{k}", 0) for k in range(1, 5)])

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @staticmethod
    def discounts(n: list[int]) -> tuple[float, float, float, float]:
        """For counts 0, 1, 2 and more; the closed form of modified Kneser-Ney, and 0.5, 1, 1.5 where counts of counts are missing."""
        if min(n) <= 0:
            return 0.0, 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        return 0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))

    def _array(self, folder: str, name: str, kind: str) -> np.ndarray:
        if (folder, name) not in self._open:
            self._open[folder, name] = map_array(f"{self.where}/{folder}", name, kind)
        return self._open[folder, name]

    def _look(self, table: str, key: np.ndarray, part: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Values of sorted or unsorted keys, 0 where a key is not there."""
        out = [np.zeros(len(key), np.int64) for _ in names]
        order = np.lexsort((key, part))
        edges = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(order) else []
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            own = order[a:b]
            folder = f"{table}-{int(part[own[0]])}"
            keys = self._array(folder, "keys", "<u8")
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
            hit = keys[at] == key[own]
            for o, name in zip(out, names, strict=True):
                o[own[hit]] = self._array(folder, name, "<u4")[at[hit]]
        return out

    def words(self, word: np.ndarray) -> list[np.ndarray]:
        """Count, different words before; as a context: total, pairs met once, twice, more often."""
        own, back = np.unique(word, return_inverse=True)
        return [x[back] for x in self._look("word", own, word_part(own, self.parts), ("count", "befores", "total", "once", "twice", "more"))]

    def pairs(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._look("pair", pair_hash(before, word), pair_part(before, word, self.parts, self.salts), ("count",))[0]

    def log10(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p(word | before) of each token, and each word's count."""
        n = len(word)
        got = self.words(np.concatenate([word, before]))
        count, befores = got[0][:n], got[1][:n]
        total, once, twice, more = (x[n:] for x in got[2:])
        t, d = self.totals, np.array(self.word_discounts)
        types, left = t.get("befores", 0), d[1] * t.get("a1", 0) + d[2] * t.get("a2", 0) + d[3] * t.get("a3+", 0)
        same = 1.0 / (t.get("types", 0) + 1)
        low = (np.maximum(befores - d[np.minimum(befores, 3)], 0) + left * same) / types if types else np.full(n, same)
        e = np.array(self.pair_discounts)
        pair = self.pairs(before, word)
        high = np.maximum(pair - e[np.minimum(pair, 3)], 0) + (e[1] * once + e[2] * twice + e[3] * more) * low
        return np.log10(np.where(total > 0, high / np.maximum(total, 1), low)), count


def _tokens(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, word before, and the number of tokens of each text."""
    words, sizes = [], []
    for t in texts:
        ws = lower_words_of(t)
        sizes.append(len(ws) + 1)
        words.append(ws)
    word = hashes([w for ws in words for w in ws]) & WORD_BITS
    sizes = np.array(sizes, np.int64)
    ends = np.cumsum(sizes) - 1
    out = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = word, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends - sizes + 1] = START
    return out, before, sizes


def train(documents: DataFrame, where: str, parts: int, p: LmParams = LmParams()) -> Model:
    """documents: text. Writes the model into folder `where`. Salts of a context grow with the parts, so that the share of a part that the
    commonest one may take stays the same."""
    salts = max(p.salts, parts // p.parts_per_salt)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept, size = WordHashes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            (before, word), (c,) = _group([np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])], [np.concatenate([k[2] for k in kept])])
            yield from _deal(0, pair_part(before, word, parts, salts), [before, word], [c], _pack_pairs)

        for b in slices(batches, size=p.chunk):
            if b.num_rows:
                word, before, _ = _tokens(b["text"].to_pylist(), hashes)
                kept.append((before, word, np.ones(len(word), np.int64)))
                size += len(word)
                if size >= 3 * p.chunk:
                    yield from flush()
                    kept, size = [], 0
        if kept:
            yield from flush()

    def by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
        now, own = None, []
        for b in batches:
            for k, part, blob in zip(b["kind"].to_pylist(), b["part"].to_pylist(), b["blob"].to_pylist(), strict=True):
                if part != now and own:
                    yield now, own
                    own = []
                now = part
                own.append((k, blob))
        if own:
            yield now, own

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in by_part(batches):
            got = [_unpack_pairs(blob) for _, blob in own]
            own.clear()
            (before, word), (c,) = _group([np.concatenate([g[0][k] for g in got]) for k in range(2)], [np.concatenate([g[1][0] for g in got])])
            del got
            h = pair_hash(before, word)
            order = np.argsort(h)
            write_arrays(f"{where}/pair-{part}", keys=h[order].astype("<u8"), count=np.minimum(c[order], (1 << 32) - 1).astype("<u4"))
            tally = [int((c == k).sum()) for k in range(1, 5)]
            yield pa.RecordBatch.from_pydict({"kind": pa.array([2], pa.int32()), "part": pa.array([int(part) % parts], pa.int32()), "blob": pa.array([np.array(tally, "<i8").tobytes()], pa.binary())})
            (w,), (n, befores) = _group([word], [c, np.ones(len(c), np.int64)])
            yield from _deal(0, word_part(w, parts), [w], [n, befores])
            (x,), sums = _group([before], [c, c == 1, c == 2, c > 2])
            yield from _deal(1, word_part(x, parts), [x], sums)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("count", "befores", "total", "once", "twice", "more")
        for part, own in by_part(batches):
            tally = np.sum([np.frombuffer(blob, "<i8") for k, blob in own if k == 2] or [np.zeros(4, np.int64)], axis=0)
            keys, values = [], [[] for _ in names]
            for k, blob in own:
                if k == 2:
                    continue
                (w,), got = _unpack(blob, 1, 2 if k == 0 else 4)
                keys.append(w)
                for i, v in enumerate(values):
                    j = i if k == 0 else i - 2
                    v.append(got[j] if 0 <= j < len(got) else np.zeros(len(w), np.int64))
            own.clear()
            stats = dict(zip(("p1", "p2", "p3", "p4"), tally.tolist(), strict=True))
            if keys:
                (w,), sums = _group([np.concatenate(keys)], [np.concatenate(v) for v in values])
                write_arrays(f"{where}/word-{part}", keys=w.astype("<u8"), **{k: np.minimum(v, (1 << 32) - 1).astype("<u4") for k, v in zip(names, sums, strict=True)})
                c, a = sums[0], sums[1]
                stats |= {"tokens": int(c.sum()), "types": int((c > 0).sum()), "befores": int(a.sum()), "a3+": int((a > 2).sum())} | {f"a{k}": int((a == k).sum()) for k in range(1, 5)}
            yield pa.RecordBatch.from_pydict({"name": pa.array(list(stats)), "value": pa.array(list(stats.values()), pa.int64())})

    blobs = "kind int, part int, blob binary"
    counted = documents.select("text").mapInArrow(count, blobs).repartitionById(parts, "part").sortWithinPartitions("part")
    merged = counted.mapInArrow(merge, blobs).repartitionById(parts, "part").sortWithinPartitions("part")
    with writing(documents.sparkSession):
        rows = merged.mapInArrow(finish, "name string, value long").groupBy("name").agg(F.sum("value").alias("value")).collect()
    return Model(where, parts, salts, {r["name"]: r["value"] for r in rows})


def score(documents: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. Rows whose crc32(doc_id) mod 5 is 1 are held out."""
    held = F.coalesce(bucket("doc_id", 5) == 1, F.lit(False))
    learn = documents.where(bucket("doc_id", 5) != 1)
    chars = learn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = train(learn, Scratch(documents.sparkSession, "kneser-ney").root, p.salts * max(2, -(-chars // (p.chars_per_part * p.salts))), p)
    seen, types = model.totals.get("tokens", 0), model.totals.get("types", 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for own in slices(batches, 4096, 6 * p.chunk):
            if own.num_rows:
                word, before, sizes = _tokens(own["text"].to_pylist(), hashes)
                logs, count = model.log10(before, word)
                base = np.log10((count + 0.5) / (seen + 0.5 * (types + 1)))
                at = np.cumsum(sizes) - sizes
                total = np.add.reduceat(logs, at)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": own["doc_id"], "held_out": own["held_out"], "n_tokens": pa.array(sizes), "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), "train_tokens": pa.array(np.full(len(sizes), seen, np.int64)),
                    "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(total), "perplexity": pa.array(10 ** np.minimum(-total / sizes, 300)),
                })

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
