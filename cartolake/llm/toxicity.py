"""Toxicity by a weighted lexicon.

Terms (whole words and word beginnings) are matched by an Aho-Corasick automaton on folded text: A-Z lower-cased, homoglyphs
and digits replaced by the letters that they imitate. Exception phrases take back the hits inside them. The summed weights,
normalised by length, give the score through a logistic curve. Weights and curve are learned from a labelled table; a small
seed lexicon covers words that the labels don't show.

Nulls and empty texts have no words and get the curve's value at zero hits. Repeated rows get equal scores. Of repeated labels
of a doc_id the largest counts; null labels and null doc_ids are not learned from. With no usable labels, seed weights and a
fixed curve are used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, slices

#: Letters of other scripts and digits that imitate a-z.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһκνοαρτυ", "aeopcyxijsdhkvoaptu", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = {"@": "a", "$": "s"}
#: Common insults; a learned weight replaces the seed weight.
SEED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "imbecile", "dumbass", "bastard", "asshole", "bitch", "fuck", "shithead", "retard", "whore", "slut", "vermin", "subhuman")
SEED_WEIGHT = 3.0
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "circus clown", "stupid mistake", "sore loser", "pond scum")


def fold(text: str) -> str:
    """Lower case, homoglyphs and digit substitutions undone, all that is no letter or digit a space. Digits fold only beside letters."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_GLYPH_TABLE)
    out = []
    for w in text.split():
        if not w.isalpha():
            w = "".join(SIGNS.get(c, c) if i + 1 < len(w) and w[i + 1].isalnum() else c for i, c in enumerate(w)) if "@" in w or "$" in w else w
            if any(c.isalpha() for c in w):
                w = w.translate(_DIGIT_TABLE)
            w = "".join(c if c.isalnum() else " " for c in w)
        out.append(w)
    return " ".join(" ".join(out).split())


_GLYPH_TABLE = str.maketrans(HOMOGLYPHS)
_DIGIT_TABLE = str.maketrans(DIGITS)


@dataclass(frozen=True)
class ToxicityParams:
    #: Labelled rows learned from, at most so many of each label (those with the smallest hashes).
    sample_per_label: int = 8000
    #: Lexicon size; least support in toxic texts, as a count and as a share; least log odds, two standard errors taken off; word beginnings' lengths.
    max_terms: int = 2000
    min_support: int = 4
    min_share: float = 0.01
    min_log_odds: float = 1.5
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    threshold: float = 0.3


@dataclass
class Lexicon:
    """terms: 'word' is a whole word, 'begin*' a beginning. curve: of (1, log1p(sum), sum / sqrt(words), sum / words)."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 3.0, 1.0, 1.0)
    limit: int = 100_000
    _seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_seen", "_auto", "_auto_exc")}

    def __setstate__(self, state):
        self.__dict__.update(state, _seen={})

    def _build(self):
        self._auto = ahocorasick.Automaton()
        for t, w in self.terms.items():
            pattern = " " + (t[:-1] if t.endswith("*") else t + " ")
            self._auto.add_word(pattern, (w, len(pattern)))
        self._auto_exc = ahocorasick.Automaton()
        for e in self.exceptions:
            self._auto_exc.add_word(f" {e} ", len(e) + 2)
        for a in (self._auto, self._auto_exc):
            a.make_automaton()

    def word(self, word: str) -> float:
        """The largest weight of a term in the folded word."""
        if not hasattr(self, "_auto"):
            self._build()
        if not self.terms or not (folded := fold(word)):
            return 0.0
        return max((w for _, (w, _) in self._auto.iter(f" {folded} ")), default=0.0)

    def measure(self, text: str | None) -> tuple[int, int, float]:
        """Words, hits and summed weights of the whole text. A term lies within a word, so a word's weight is remembered."""
        words = text.split() if text else []
        got = list(map(self._seen.get, words))
        if None in got:
            seen = self._seen
            for i, g in enumerate(got):
                if g is None:
                    if (g := seen.get(words[i])) is None:
                        g = self.word(words[i])
                        if len(seen) < self.limit:
                            seen[words[i]] = g
                    got[i] = g
        hits, total = sum(map(bool, got)), sum(got)
        if hits and self.exceptions:
            folded = f" {fold(text)} "
            if not hasattr(self, "_auto_exc"):
                self._build()
            for end, n in self._auto_exc.iter(folded):
                inside = folded[end - n + 1 : end + 1].split()
                back = [w for w in map(self.word, inside) if w]
                hits, total = hits - len(back), total - sum(back)
        return len(words), max(hits, 0), max(total, 0.0)

    def score(self, n: int, total: float) -> float:
        z = sum(a * b for a, b in zip(self.curve, inputs(n, total), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def inputs(n: int, total: float) -> tuple[float, float, float, float]:
    return 1.0, math.log1p(total), total / math.sqrt(max(n, 1)), total / max(n, 1)


def terms_of(text: str | None, prefixes: tuple[int, ...]) -> set[str]:
    out = set(fold(text).split()) if text else set()
    return out | {w[:k] + "*" for w in out for k in prefixes if len(w) > k}


def fit(documents: DataFrame, labels: DataFrame, learn_from, p: ToxicityParams = ToxicityParams()) -> Lexicon:
    """documents: doc_id, text. labels: doc_id, toxic. learn_from: a condition on doc_id. The sample's size is bounded by
    p.sample_per_label, so it is broadcast; term counts are summed in Spark and only the strongest terms come to the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn_from).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(p.sample_per_label) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    # The fold hangs on the text, so that it's the same whichever of equal texts is kept.
    fold_of = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(3)).cast("int")
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["text", "toxic"]).withColumn("fold", fold_of)
    prefixes = p.prefixes

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for t, y, f in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), b["fold"].to_pylist(), strict=True):
                if f:
                    seen[y].update(terms_of(t, prefixes))
                    seen[y][""] += 1
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "clean": pa.array([seen[0][k] for k in keys], pa.int64()), "toxic": pa.array([seen[1][k] for k in keys], pa.int64())})

    counted = texts.select("text", "toxic", "fold").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strongest = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5)
    rows = counted.where((F.col("toxic") >= p.min_support) | (F.col("term") == "")).orderBy(F.col("term") != "", (-strongest * F.least(F.lit(1.0), F.col("toxic") / 20)), "term").limit(4 * p.max_terms).collect()
    totals = next(((r["clean"], r["toxic"]) for r in rows if r["term"] == ""), (0, 0))
    least = max(p.min_support, p.min_share * totals[1])
    terms = {}
    for r in rows:
        if r["term"] and r["toxic"] >= least:
            odds = math.log((r["toxic"] + 0.5) / (totals[1] + 1)) - math.log((r["clean"] + 0.5) / (totals[0] + 1))
            if odds - 2 * math.sqrt(1 / (r["toxic"] + 0.5) + 1 / (r["clean"] + 0.5)) >= p.min_log_odds:
                terms[r["term"]] = odds
    short = {t: w for t, w in terms.items() if not any(terms.get(t[:k] + "*", -1) >= w - 1.0 for k in range(1, len(t.rstrip("*"))))}
    terms = dict(sorted(short.items(), key=lambda x: (-x[1], x[0]))[: p.max_terms])
    lexicon = Lexicon({s: SEED_WEIGHT for s in SEED} | {t: round(w, 3) for t, w in terms.items()})

    held = texts.where("fold = 0").select("text", "toxic")
    measured = measure(held, lexicon, keep=("toxic",)).select("toxic", "n_words", "weight").collect()
    if len({r["toxic"] for r in measured}) == 2:
        x = np.array([inputs(r["n_words"], r["weight"]) for r in measured])
        lexicon.curve = logistic(x, np.array([r["toxic"] for r in measured], float))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 100) -> tuple[float, ...]:
    """Ridge logistic regression by damped Newton steps. No input's weight may fall below zero (the first, the constant's, may), so more hits never lower a score."""
    free, penalty = np.ones(x.shape[1], bool), np.full(x.shape[1], ridge)

    def loss(w: np.ndarray, xs: np.ndarray, r: np.ndarray) -> float:
        z = xs @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (r * w * w).sum())

    while True:
        xs, r, w = x[:, free], penalty[free], np.zeros(free.sum())
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
            step = np.linalg.solve((xs * (q * (1 - q))[:, None]).T @ xs + np.diag(r), xs.T @ (q - y) + r * w)
            size, now = 1.0, loss(w, xs, r)
            while size > 1e-4 and loss(w - size * step, xs, r) > now:
                size /= 2
            w = w - size * step
            if abs(size * step).max() < 1e-6:
                break
        full = np.zeros(x.shape[1])
        full[free] = w
        if not (low := full[1:] < 0).any():
            return tuple(round(float(v), 6) for v in full)
        free[1:] &= ~low


def measure(documents: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds n_words, n_hits, weight and score; `keep` are the columns carried along with text left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [lexicon.measure(t) for t in b["text"].to_pylist()]
            cols = {k: b[k] for k in keep}
            cols |= {"n_words": pa.array([g[0] for g in got], pa.int64()), "n_hits": pa.array([g[1] for g in got], pa.int64()), "weight": pa.array([g[2] for g in got], pa.float64()), "score": pa.array([lexicon.score(g[0], g[2]) for g in got], pa.float64())}
            yield pa.RecordBatch.from_pydict(cols)

    chosen = documents.select(*keep, "text")
    schema = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keep)
    return chosen.mapInArrow(run, f"{schema}, n_words long, n_hits long, weight double, score double")


def score(documents: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_words, n_hits, weight. Rows whose crc32(doc_id) mod 4 is 2 are never learned from."""
    lexicon = fit(documents, labels, bucket("doc_id", 4) != 2, p)
    return measure(documents, lexicon).select(
        "doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"), "n_words", "n_hits", "weight"
    )


def drop_toxic(documents: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Pipeline form: the documents that are not predicted toxic, with their own columns. Whole rows pass through the workers."""
    lexicon = fit(documents, labels, bucket("doc_id", 4) != 2, p)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [lexicon.measure(t) for t in b["text"].to_pylist()]
            yield b.filter(pa.array([lexicon.score(g[0], g[2]) < p.threshold for g in got], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
