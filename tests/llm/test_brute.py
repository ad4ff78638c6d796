"""The operators without SQL against plain Python, the SQL of the others, and held-out accuracy."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from cartolake.llm import catalog, html, kneser_ney, licenses, toxicity, urls

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def rows_of(folder, table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{table}.parquet'").fetchall()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    df = catalog.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    got, want = ([tuple(plain(v) for v in r) for r in rows] for rows in (df.select(columns).collect(), cursor.fetchall()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def words(text):
    return (text or "").encode().lower().split()


def kneser_ney_in_python(texts):
    """doc_id -> log10 probability by an interpolated modified Kneser-Ney model of order 2."""
    learn = [t for k, t in texts.items() if zlib.crc32(str(k).encode()) % 5 != 1]
    pairs = collections.Counter()
    for t in learn:
        seq = [b"<s>", *words(t), b"</s>"]
        pairs.update(zip(seq[:-1], seq[1:], strict=True))
    context, word, before = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for (x, w), c in pairs.items():
        context[x].append(c)
        word[w] += c
        before[w] += 1

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if min(n) <= 0:
            return 0.0, 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        return 0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))

    d2, d1 = discounts(pairs.values()), discounts(before.values())
    types = sum(before.values())
    left = sum(d1[min(b, 3)] for b in before.values())

    def p(x, w):
        low = (max(before[w] - d1[min(before[w], 3)], 0) + left / (len(word) + 1)) / types
        if x not in context:
            return low
        c = pairs.get((x, w), 0)
        return (max(c - d2[min(c, 3)], 0) + sum(d2[min(v, 3)] for v in context[x]) * low) / sum(context[x])

    out = {}
    for k, t in texts.items():
        seq = [b"<s>", *words(t), b"</s>"]
        out[k] = sum(math.log10(p(x, w)) for x, w in zip(seq[:-1], seq[1:], strict=True))
    total, kinds = sum(word.values()), len(word)
    base = {k: sum(math.log10((word[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*words(t), b"</s>"]) for k, t in texts.items()}
    return out, base, total, word


def test_lm_scores_equal_plain_python(spark):
    """Over the whole smallest table with odd texts and a repeated row; and with salts and parts of other numbers."""
    texts = dict(rows_of(SMALL, "documents", "doc_id, text")) | {90_001: None, 90_002: "", 90_003: " \n", 90_004: "É\u00a0x A a", 90_005: "unseen " * 3}
    want, base, total, count = kneser_ney_in_python(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for p in (kneser_ney.LmParams(), kneser_ney.LmParams(chars_per_part=2000, salts=3, parts_per_salt=8, chunk=5000)):
        got = {r.doc_id: r for r in kneser_ney.score(df, p).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert math.isclose(r.score, want[k], rel_tol=1e-9) and math.isclose(r.base_score, base[k], rel_tol=1e-9)
            tokens = [*words(texts[k]), b"</s>"]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), total)


def test_licenses_equal_a_plain_scan(spark):
    """Every rule is tried on every text, without keywords; base columns from the words."""
    texts = dict(rows_of(SMALL, "documents", "doc_id, text")) | {
        90_001: None, 90_002: "", 90_003: "mit license " * 2000, 90_004: "CC BY-SA 4.0, GPL-3.0 or GNU General Public License v2", 90_005: "Licensed under the Apache License, Version 2.0; BSD 3-Clause License", 90_006: "\u0130 MIT\u212a license cc by",
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in [*texts.items(), (90_004, texts[90_004])]], "doc_id long, text string, labels string")
    rules = [(label, re.compile(f" (?:{pattern})(?= )"), sure) for label, _, pattern, sure in licenses.rules()]
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = 0
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").translate(upper)) if w]
        at = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + phrase.count(" ") + 1] == phrase.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        base = {label for _, label in at}
        flat = f" {' '.join(ws)} "
        hits = [(m.start(), m.end(), k) for k, (_, pattern, _) in enumerate(rules) for m in pattern.finditer(flat)]
        stay, end = [], -1
        for a, b, k in sorted(hits, key=lambda x: (x[0], -x[1], x[2])):
            if b > end:
                stay.append(k)
                end = b
        found += len(stay)
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | {rules[k][0] for k in stay})))
        assert math.isclose(r.score, max([rules[k][2] for k in stay] + [0.7 if at else 0.0]))
    assert found > 100


def test_url_verdicts_equal_plain_python(spark):
    """All urls of the smallest table, odd and repeated ones; the model's own probability by a sum over n-grams."""
    pages = rows_of(SMALL, "pages", "page_id, url")
    pages += [(90_000 + i, u) for i, u in enumerate([None, "", "x", "://", "a://b", "h://COM/en/", "h://x.com?/en/", "h://example.com/en/7", "h://a.b.net/de/x#y", "h://" + "a" * 30_000 + ".org/es/", "h://com/en/", "h://com/en/"])]
    df = spark.createDataFrame([(k, u, "r") for k, u in pages], "page_id long, url string, rule string")
    model = urls.UrlModel(urls.UrlParams())
    table = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    got = urls.judge(df).collect()
    assert len(got) == len(pages)
    of = dict(pages)
    for r in got:
        m = re.match(r"[^\x00]*?://([^/?#]*)([^?#]*)", of[r.page_id] or "", re.S)
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fits = [x for x in table if f".{host}".endswith(f".{x[1]}") and path.startswith(x[2])]
        rule = max(fits, key=lambda x: len(x[1] + x[2])) if fits else None
        verdict = rule[0] if rule else "block" if host and model.score(host, path) >= urls.UrlParams().threshold else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[1] + rule[2], verdict)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty).count() == 0 and urls.judge(empty).columns == urls.judge(df).columns


def test_url_model_on_families_it_has_not_seen():
    """Families of unwanted sites, and ordinary ones, none of whose names are in the labelled table."""
    bad = ["http://best-poker-slots.example.com/en/1", "http://online-viagra-pharmacy.example.net/fr/2", "http://lucky-jackpot-bet.example.org/3", "http://cheap-loans-fast.example.com/4", "http://xxx-adult-cams.example.net/5"]
    good = ["http://www.thereader.example.com/en/1", "http://blog.harbourtown.example.net/fr/2", "http://library.city.example.org/3", "http://m.gardening.example.com/4", "http://news.valley.example.net/5"]
    model = urls.UrlModel(urls.UrlParams())
    right = sum(model.score(*urls.parse(u)) >= urls.UrlParams().threshold for u in bad) + sum(model.score(*urls.parse(u)) < urls.UrlParams().threshold for u in good)
    assert right >= 7


def test_toxicity_on_held_out_labels(spark):
    """AUC, precision and recall over the labelled documents that weren't learned from; scores equal the lexicon's in plain Python."""
    df = catalog.op10_toxicity(spark, LARGER)
    got = {r.doc_id: r for r in df.collect()}
    texts, labels = dict(rows_of(LARGER, "documents", "doc_id, text")), dict(rows_of(LARGER, "labels", "doc_id, toxic"))
    assert got.keys() == texts.keys()
    held = [(got[k].score, y) for k, y in labels.items() if k in got and zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    good, bad = ([s for s, y in held if y == k] for k in (0, 1))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    hits = sum(s >= 0.3 for s in bad)
    precision, recall = hits / max(1, hits + sum(s >= 0.3 for s in good)), hits / len(bad)
    print(f"held out {len(held)}, toxic {len(bad)}: AUC {auc:.3f}, precision {precision:.3f}, recall {recall:.3f}")
    assert auc > 0.9 and precision > 0.8 and recall > 0.75


def test_lexicon_matches_equal_a_plain_search():
    """Aho-Corasick matches of a lexicon are those of a word by word search."""
    lex = toxicity.Lexicon({"idiot": 3.0, "lowei*": 2.0, "trash": 1.5, "you trash": 2.5})
    for text in ("idiot IDIOT id1ot", "loweigen und lowei", "low ei", "x" * 100_000 + " idiot", "idiots", ""):
        plain_hits = sum(w == "idiot" or w.startswith("lowei") for w in toxicity.fold(text).split())
        assert lex.measure(text)[1] == plain_hits


NAMELESS = """<body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/w>Weather</a></div>
<div>We use cookies to make your visit better. Accept all cookies or change your consent.</div>
<h1>How the lighthouse was moved</h1>
<p>The lighthouse stood at the edge of the cliff for more than a hundred years before the sea came too near.</p>
<p>Engineers cut it from its base and pushed it inland on steel rails, a hand's breadth at a time, for most of a summer.</p>
<div>Sponsored: buy garden chairs on sale, order today in our store.</div>
<p>It shines again from its new place, and the old base has since gone over the edge.</p>
<h3>Comments</h3><p>Anna: I saw it as a child and am glad that it was kept, as there are so few of them left on this coast.</p><p>Well done. <a href=/r>Reply</a></p>
<div>Copyright 2021, all rights reserved. <a href=/t>Terms</a> <a href=/p>Privacy</a></div></body>"""


def test_html_of_a_page_without_names(spark):
    got = html.extract(spark.createDataFrame([(1, "u", NAMELESS, "x")], "page_id long, url string, html string, text string")).first()
    paragraphs = [" ".join(x.split()) for x in re.findall(r"<p>((?:The light|Engineers|It shines).*?)</p>", NAMELESS, re.S)]
    assert got.text == "\n\n".join(["How the lighthouse was moved", *paragraphs])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(empty).count() == 0


def test_html_tree_by_words_and_links_alone():
    """Without what containers say, words and links of a block and its neighbours still tell most blocks of left-out pages."""
    mask = np.isin(html.FEATURES, html.TEXT_FEATURES)
    right = total = 0
    used = set()

    def uses(tree):
        if isinstance(tree, tuple):
            used.add(html.FEATURES[tree[0]])
            uses(tree[2])
            uses(tree[3])

    for i in range(len(html.LABELLED)):
        x, y = html.labelled_blocks(html.LABELLED[:i] + html.LABELLED[i + 1 :])
        tree = html.grow(x * mask, y, 10, 1)
        uses(tree)
        x, y = html.labelled_blocks((html.LABELLED[i],))
        right += sum((html.decide(tree, list(f)) >= 0.5) == bool(v) for f, v in zip(x * mask, y, strict=True))
        total += len(y)
    assert right / total > 0.75 and {"words", "links", "words_before", "words_after"} <= used


def test_html_of_deep_and_long_pages():
    import time

    took = []
    for n in (4000, 32_000):
        began = time.process_time()
        assert len(html.blocks("<div>x" * n + "</section>" * n + "</div>" * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5
