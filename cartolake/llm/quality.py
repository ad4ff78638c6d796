"""Quality rules, lines first.

Every line with a word is tested: punctuation (symbols, shouting, repeated words, and neither a mark at the end of the line nor a
sentence's end within, unless its last word holds a digit), navigation (separators, short link labels) and boilerplate (stock phrases). Failing lines are removed; a document that
loses too large a share of its words is rejected. Counts over the whole text are reported beside the verdict.

A null text has no words. A document with fewer than `min_words` words or too much repetition fails before its lines are read.
Ties and repeated rows need no rule: each row is judged alone. Texts of any length are read whole, a few at a time. An empty table
gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHashes, rolling, slices

#: Stock phrases of pages in English, German, French and Spanish, lower-cased.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions", "all rights reserved", "click here", "sign up for", "sign in to", "subscribe to our", "log in to",
    "enable javascript", "lorem ipsum", "share on facebook", "share this article", "follow us on", "skip to content", "skip to main content", "back to top", "read more", "we use cookies", "accept all cookies",
    "powered by", "leave a comment", "add to cart", "forgot your password", "your email address", "related articles",
    "alle rechte vorbehalten", "wir verwenden cookies", "hier klicken", "jetzt anmelden", "newsletter abonnieren", "nach oben", "weiterlesen", "folgen sie uns", "zum inhalt springen", "in den warenkorb",
    "tous droits réservés", "nous utilisons des cookies", "cliquez ici", "en savoir plus", "mentions légales", "lire la suite", "haut de page", "suivez nous", "aller au contenu", "ajouter au panier",
    "todos los derechos reservados", "utilizamos cookies", "haga clic aquí", "leer más", "aviso legal", "política de privacidad", "volver arriba", "síguenos en", "saltar al contenido", "añadir al carrito",
)
#: Words of menus in the same languages.
NAVIGATION = tuple(
    "home about contact menu login logout search sitemap next previous faq help register news archive shop cart account imprint privacy terms "
    "startseite kontakt suche anmelden weiter zurück hilfe impressum datenschutz warenkorb konto über "
    "accueil contactez recherche connexion suivant précédent aide inscription panier compte plan "
    "inicio contacto buscar entrar siguiente anterior ayuda registro carrito cuenta mapa".split()
)
#: What sentences, and finished lines, end with.
STOPS = tuple(".!?…。！？")
ENDS = tuple(".!?…:;)]}»”’\"'。！？")


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: A line fails with more than 1 symbol in so many words, capitals above so many percent of its letters, or so many percent of words equal to the one before.
    words_per_symbol: int = 10
    max_upper_percent: int = 40
    min_letters: int = 20
    max_same_percent: int = 30
    #: Boilerplate and navigation are looked for in lines of at most so many words.
    boilerplate_words: int = 30
    navigation_words: int = 6
    #: A document is rejected when less than this percentage of its words is left.
    keep_percent: int = 70


_SYMBOL = re.compile(r"[#*$%&|<>]")
_DIGIT = re.compile("[0-9]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")


def line_fails(line: str, p: QualityParams = QualityParams()) -> bool:
    """True if a line (that holds a word) breaks a rule."""
    words = [w for w in _SPACE.split(line) if w]
    n = len(words)
    if p.words_per_symbol * len(_SYMBOL.findall(line)) > n:
        return True
    if not words[-1].endswith(ENDS) and not _DIGIT.search(words[-1]) and not any(w.endswith(STOPS) for w in words):
        return True
    upper = len(_UPPER.findall(line))
    if upper * 100 > p.max_upper_percent * n and upper > 0:
        letters = len(_LETTER.findall(line))
        if letters >= p.min_letters and 100 * upper > p.max_upper_percent * letters:
            return True
    if 100 * sum(map(str.__eq__, words, words[1:])) > p.max_same_percent * n:
        return True
    if n <= p.boilerplate_words:
        low = line.lower()
        if any(b in low for b in BOILERPLATE):
            return True
        if n <= p.navigation_words and 2 * sum(w.lower() in NAVIGATION for w in words) > n:
            return True
    return False


def judge(text: str | None, hashes: WordHashes, p: QualityParams = QualityParams()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words, cleaned text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - len(_SPACE.findall(text))
    lines, seen, dup, left, out = text.split("\n"), set(), 0, 0, []
    for line in lines:
        k = len(line.encode("utf-8", "surrogatepass").split())
        if not k:
            out.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        if not line_fails(line, p):
            left += k
            out.append(line)
    repeat = 0
    if n > p.window:
        r = rolling(hashes(words), p.window)
        _, back, count = np.unique(r, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[back] > 1)
        if len(at):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + p.window, -1)
            repeat = int((np.cumsum(edge) > 0).sum())
    failed = n < p.min_words or 100 * repeat > p.max_repeat_percent * n
    return n, chars, len(_SYMBOL.findall(text)), dup, repeat, failed, not failed and 100 * left >= p.keep_percent * n, left, "\n".join(out)


def quality(documents: DataFrame, p: QualityParams = QualityParams(), clean: bool = False) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, kept_words; with `clean` also the text without failing lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            got = [judge(t, hashes, p) for t in b["text"].to_pylist()]
            cols = {"doc_id": b["doc_id"]}
            for i, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
                cols[name] = pa.array([g[i] for g in got], pa.int64())
            cols |= {"base_failed": pa.array([bool(g[5]) for g in got]), "kept": pa.array([bool(g[6]) for g in got]), "kept_words": pa.array([g[7] for g in got], pa.int64())}
            if clean:
                cols["clean_text"] = pa.array([g[8] for g in got], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_words long"
    return documents.select("doc_id", "text").mapInArrow(run, schema + ", clean_text string" * clean)


#: The same in DuckDB SQL, for the default parameters.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
lw AS (SELECT doc_id, i, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]'), lambda x: x <> '') AS w FROM l),
lf AS (SELECT doc_id, i, line, len(w) AS n, w,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym,
  length(regexp_replace(line, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS up,
  length(regexp_replace(line, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) AS letters,
  len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS same,
  regexp_matches(lower(line), '__BOILER__') AS boiler,
  len(list_filter(w, lambda x: lower(x) IN (__NAV__))) AS nav
  FROM lw WHERE len(w) > 0),
lr AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
  (10 * sym > n OR NOT (right(w[-1], 1) IN (__ENDS__) OR regexp_matches(w[-1], '[0-9]') OR len(list_filter(w, lambda x: right(x, 1) IN (__STOPS__))) > 0) OR (letters >= 20 AND 100 * up > 40 * letters AND 100 * up > 40 * n) OR 100 * same > 30 * n OR (n <= 30 AND (boiler OR (n <= 6 AND 2 * nav > n)))) AS fails FROM lf),
la AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(n) FILTER (NOT fails), 0) AS kept_words FROM lr GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, w FROM w WHERE len(w) > 8),
gs AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 7], ' ')) AS c FROM g),
gp AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM gs WHERE c > 1) GROUP BY doc_id),
a AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0)::BIGINT AS kept_words
  FROM w LEFT JOIN la USING (doc_id) LEFT JOIN gp USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND 100 * kept_words >= 70 * n_words) AS kept, kept_words FROM f
""".replace("__BOILER__", "|".join(BOILERPLATE)).replace("__NAV__", ", ".join(f"'{x}'" for x in NAVIGATION)).replace("__ENDS__", ", ".join(f"chr({ord(x)})" for x in ENDS)).replace("__STOPS__", ", ".join(f"chr({ord(x)})" for x in STOPS))
