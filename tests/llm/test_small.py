"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and results against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolake.llm import common, decontaminate, html, kneser_ney, licenses, line_dedup, ngram_join, packing, quality, toxicity, urls
from cartolake.llm.catalog import tokenizer_path
from cartolake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cell string, node string, n_lines int, words string, part int"
WORDS = "the of and harbour stone tide boat net mast sail rope north wind grey quay mole pier crane gull salt".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    a, long = prose(1, 120), "\n".join(prose(100 + k, 60) for k in range(40))
    near = a.split()
    near[60] = "changed"
    out = [a, a, " ".join(near), None, "", " \n\t", "one", "two words", long, long, "idiot " * 3 + prose(5, 30), prose(6, 55) + "\n" + prose(7, 20), prose(8, 25) + "\n" + prose(6, 55) + "\n" + prose(7, 20)]
    out += [prose(k, 30 + k) for k in range(10, 30)]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "c", "n", 1, "w", 0) for k, t in texts.items()], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width):
    w = common.lower_words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_components(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (7, 9), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links, common.Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("width, over", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(docs, none, texts, width, over):
    p = ngram_join.JoinParams(width=width, over=over, small=2, block=4)
    sets, root = {k: shingles(t, width) for k, t in texts.items()}, {k: k for k in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= over * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs, p).collect()}
    assert got == {k: (len(sets[k]), root[k]) for k in texts}
    assert ngram_join.groups(none, p).count() == 0


def test_boxes_of_similar_sets_meet():
    """Two sets within the similarity always share a box, however the differing shingles fall and whatever is common."""
    p, r = ngram_join.JoinParams(), np.random.default_rng(3)
    level = r.integers(0, 90, 1 << p.bits).astype(np.uint8)
    parts = ngram_join.parts_of(level, p)
    for n in [*range(1, 40), 100, 333, 1000]:
        base = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        for drop in range(0, len(base) // 5 + 1, max(1, len(base) // 50)):
            other = np.sort(np.delete(base, r.choice(len(base), drop, replace=False)))
            if len(other) and p.under * len(other) >= p.over * len(base):
                a, b = (ngram_join.filed(s, level, parts, p)[0] for s in (base, other))
                assert set(a) & set(b) and len(a) == len(base) - -(-p.over * len(base) // p.under) + 1


def test_tree_loses_no_pair():
    """All pairs that the bound on points allows, but for those of one component, come out of a join of two trees."""
    p, r = ngram_join.JoinParams(coarse=16, fan=4), np.random.default_rng(5)
    base = r.integers(0, 6, (30, p.coarse))
    points = np.clip(base[r.integers(0, 30, 500)] + r.integers(-1, 2, (500, p.coarse)) * (r.random((500, p.coarse)) < 0.1), 0, 255).astype(np.uint8)
    n, comp = points.sum(axis=1).astype(np.int64), r.integers(0, 12, 500)
    halves = [x[np.lexsort((n[x], comp[x]))] for x in (np.arange(200), np.arange(200, 500))]
    trees = [ngram_join.Tree(comp[x], n[x], points[x], p.fan) for x in halves]
    got = {(int(halves[0][i]), int(halves[1][j])) for x, y in ngram_join.tree_pairs(*trees, p, 300) for i, j in zip(x, y, strict=True)}
    want = {(a, b) for a in range(200) for b in range(200, 500) if comp[a] != comp[b] and ngram_join.bounded(n[a : a + 1], n[b : b + 1], points[a : a + 1], points[b : b + 1], p)[0]}
    assert got == want and 0 < len(want) < 30_000


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_shared_boxes_of_any_batches(spark, size):
    """Boxes are read off alike however the rows are cut into batches; members of dealt boxes are given even if alone."""
    r, p = random.Random(8), ngram_join.JoinParams(small=3, fine=4)
    rows = [(r.choice([64, 128, 192, 257, 321]) if i % 3 else 640 + 64 * (i % 40), 0 if i % 2 else r.randint(0, 3), r.randint(0, 5), i, 8, bytes(r.choice([(2, 2, 2, 2), (2, 2, 2, 1), (4, 0, 4, 0)]))) for i in range(300)]
    near = lambda x, y: 9 * sum(map(min, x[5], y[5])) >= 8 * 8
    want = []
    for key in {x[:2] for x in rows}:
        own = sorted((x for x in rows if x[:2] == key), key=lambda x: (-x[2], x[3]))
        if len(own) > 3 or key[0] & 63:
            want += [(2 if near(own[0], x) else 3, key[0], own[0][3], x[3]) for x in own]
        else:
            want += [(int(i > 0), 0, x[3], y[3]) for i, x in enumerate(own) for y in own[i + 1 :] if near(x, y)]
    df = spark.createDataFrame(rows, "box long, part long, rank int, node long, n long, q binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = [tuple(x) for x in ngram_join.shared(df, p).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert sorted(got) == sorted(want) and {x[0] for x in want} == {0, 1, 2, 3}


def near_texts():
    """Families of near copies with chains, texts that share a passage, and exact copies."""
    r, out = random.Random(11), {}
    passage = prose(900, 60)
    for f in range(6):
        base = prose(1000 + f, r.choice([20, 60, 150])).split()
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 12)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            out[len(out) * 3] = " ".join(w)
            if r.random() < 0.3:
                base = w
    for _ in range(25):
        out[len(out) * 3] = prose(r.randint(2000, 9000), r.choice([5, 30, 80])) + " " + passage
    return out


@pytest.mark.parametrize("part, small, block", [(4096, 8, 2048), (4, 2, 4)])
def test_join_of_families_equals_brute_force(spark, part, small, block):
    """Dealt boxes, listed pairs and joined trees give the same components."""
    texts = near_texts()
    for width, over in ((3, 90), (5, 80)):
        sets, root = {k: shingles(t, width) for k, t in texts.items()}, {k: k for k in texts}
        links = [(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= over * len(sets[a] | sets[b])]
        for _ in texts:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in ngram_join.groups(df, ngram_join.JoinParams(width=width, over=over, part=part, small=small, block=block, fan=2)).collect()}
        assert got == root and len(set(root.values())) < len(root)


def test_keep_one(docs, none, texts):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {0, 3, 4, 5, 6, 7, 8} <= ids and not ids & {1, 2, 9}
    assert ngram_join.keep_one(none).count() == 0


def lines_brute(texts, least=50):
    where, first, gone = [], {}, collections.defaultdict(set)
    for k in sorted(texts):
        if texts[k] is None:
            continue
        lines = texts[k].split("\n")
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(len(x.encode().split()) for x in lines[s:e]) >= least:
                    where.append((k, s, e, tuple(lines[s:e])))
    for k, s, e, run in sorted(where, key=lambda x: x[:2]):
        if first.setdefault(run, (k, s)) != (k, s):
            gone[k].update(range(s, e))
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in texts.items()}


def test_line_dedup_equals_brute_force(spark, docs, none, texts):
    got = line_dedup.dedup(docs.drop("n_lines"))
    assert {r.doc_id: r.text for r in got.collect()} == lines_brute(texts)
    kept = line_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {1, 9} and {0, 3, 4, 5, 11, 12} <= ids
    assert line_dedup.dedup(none).count() == 0
    twice = spark.createDataFrame([(1, prose(1, 60)), (1, prose(1, 60)), (None, prose(1, 60)), (None, None)], "doc_id long, text string")
    out = line_dedup.dedup(twice).collect()
    assert len(out) == 4 and sum(r.n_removed for r in out) == 2


def test_line_dedup_of_random_lines(spark):
    r = random.Random(4)
    pool = [prose(k, r.choice([0, 3, 12, 20, 60])) for k in range(6)]
    texts = {k: "\n".join(r.choice(pool) for _ in range(r.randint(1, 12))) for k in range(40)}
    got = line_dedup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {x.doc_id: x.text for x in got.collect()} == lines_brute(texts)


def test_quality_counts(docs, none, texts):
    got = {r.doc_id: r for r in quality.quality(docs, clean=True).collect()}
    for k, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert not (got[k].kept and got[k].base_failed)
    assert quality.quality(none).count() == 0
    assert quality.line_fails("HOME | ABOUT | CONTACT") and quality.line_fails("Click here to log in") and not quality.line_fails("The tide came in.")


def test_url_rules_and_model(spark):
    rows = [(1, "https://a.com/en/1"), (2, "http://www.EXAMPLE.com/en/7?q=1"), (3, "x.net/de/"), (4, None), (5, "http://a.example.net/de/8#t"), (6, "https://notcom/en/"), (7, "http://cheap-pills.example.org/fr/9"), (8, "http://thering.example.org/fr/9"), (9, "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.com", "/en/1", "com/en/", "block") and got[2] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[3] == got[4] == got[9] == ("", "", None, "allow") and got[5][2:] == ("example.net/de/8", "block") and got[6][2] is None
    assert got[7][3] == "block" and got[8][3] == "allow"


def test_url_model_on_left_out_rows():
    p = urls.UrlParams()
    hits = 0
    for fold in range(5):
        model = urls.UrlModel(urls.UrlParams(labelled=tuple(x for i, x in enumerate(p.labelled) if i % 5 != fold)))
        hits += sum((model.score(*urls.parse(u)) >= 0.5) == bool(y) for i, (u, y) in enumerate(p.labelled) if i % 5 == fold)
    assert hits / len(p.labelled) > 0.75


def test_kneser_ney_sums_to_one(spark, docs, none, texts, tmp_path):
    p = kneser_ney.LmParams()
    model = kneser_ney.train(docs, f"file://{tmp_path}", 16, p)
    words = sorted({w for t in texts.values() for w in common.lower_words_of(t)})
    hashes = common.WordHashes()(words) & kneser_ney.WORD_BITS
    every = np.append(np.append(hashes, kneser_ney.END), np.uint64(12345))  # one unseen word
    for before in (hashes[0], hashes[7], kneser_ney.START, np.uint64(999)):
        logs, _ = model.log10(np.full(len(every), before), every)
        assert abs((10**logs).sum() - 1) < 1e-9
    got = {r.doc_id: r for r in kneser_ney.score(docs).collect()}
    assert len(got) == len(texts) and got[3].n_tokens == got[4].n_tokens == 1 and got[3].score == got[4].score
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 1) for k in texts)
    assert kneser_ney.score(none).count() == 0


def test_packing(spark, docs, none, texts):
    from tokenizers import Tokenizer

    t, p = Tokenizer.from_file(tokenizer_path()), packing.PackingParams(capacity=64)
    rows = packing.pack(docs, tokenizer_path(), p).collect()
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for k, x in texts.items():
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert by[k] == [(s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for s in range(0, len(ids), 64)]
    full = collections.defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for own in full.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64
    assert packing.pack(none, tokenizer_path(), p).count() == 0


def test_packing_plan_is_near_the_bound():
    r = random.Random(5)
    counts = collections.Counter(min(4096, int(r.lognormvariate(6.2, 1.1)) + 1) for _ in range(20_000))
    rows, made = packing.plan(dict(counts))
    fill = collections.Counter()
    for length, _, number, first, offset in rows.tolist():
        assert offset + length <= 4096
        for s in range(first, first + number):
            fill[s] += length
    assert sum(rows[:, 2]) == sum(counts.values()) and len(fill) == made and max(fill.values()) <= 4096
    assert made <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 4096) + 1


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now, all of it is cheap.</div><article><h1>A &amp; B</h1><p>One\n two <b>three<br>four<p>So.</p><script>var x='</p>';</script><aside>Related things to read about.</aside></article><div id=comments><p>First comment, and a rather long one of more than ten words in all.</p></div><footer>&copy; us</footer>"
    got = {r.page_id: r for r in html.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "", ""), (4, "x", "<<<>"), (5, "y", "<p" + "<div>" * 500)], "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B\n\nOne two three four\n\nSo." and got[1].n_chars == len(got[1].text)
    assert [got[k].text for k in (2, 3, 5)] == ["", "", ""]


def test_html_tree_on_left_out_pages():
    right = total = 0
    for i in range(len(html.LABELLED)):
        tree = html.grow(*html.labelled_blocks(html.LABELLED[:i] + html.LABELLED[i + 1 :]), 10, 1)
        x, y = html.labelled_blocks((html.LABELLED[i],))
        right += sum((html.decide(tree, list(f)) >= 0.5) == bool(v) for f, v in zip(x, y, strict=True))
        total += len(y)
    assert right / total > 0.8


def test_licenses(spark, none):
    cases = {
        1: "Licensed under the Apache License, Version 2.0.", 2: None, 3: "", 4: "cc by cc by CC-BY 4.0", 5: "MIT license and GNU General Public License v3 or later", 6: "the mits license", 7: "é MIT License",
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels) == (8, 1, 3, "apache") and "apache-2.0" in got[1].labels
    assert (got[2].n_words, got[2].labels, got[2].score, got[2].first_word) == (0, "", 0.0, None) and got[3].n_words == 0
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (3, 0, 4) and got[5].base_labels == "gpl,mit" and "gpl-3.0-or-later" in got[5].labels
    assert got[6].n_base == 0 and (got[7].n_base, got[7].first_word) == (1, 1)
    assert len(licenses.rules()) > 200 and licenses.scan(none).count() == 0


def test_leaks(spark, none):
    items = spark.createDataFrame([(1, prose(50, 30)), (2, prose(51, 40)), (3, "too short"), (4, None), (None, prose(52, 30))], "item_id long, text string")
    inside = prose(50, 30).split()
    inside[3] = "other"
    texts = {1: prose(60, 20) + " " + prose(50, 30) + "\n" + prose(61, 20), 2: prose(60, 200), 3: None, 4: "", 5: prose(51, 40).upper().replace(" ", ", "), 6: prose(62, 9) + " " + " ".join(inside), 7: " ".join(prose(50, 30).split()[:12])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.leaks(docs, items).collect()}
    assert got[1, 1] == (20, 1.0) and got[5, 2] == (0, 1.0) and not {d for d, _ in got} & {2, 3, 4, 7}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == set(texts) - {d for d, _ in got}
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.where("false")).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(10, 1), (10, None), (0, 0), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values()) and got[10].score > got[11].score and got[3].score == got[4].score
    assert toxicity.score(none, labels).count() == 0 and toxicity.drop_toxic(docs, labels.where("false")).columns == docs.columns
    lex = toxicity.Lexicon({"idiot": 3.0, "lowei*": 2.0, "trash": 3.0})
    assert [lex.measure(t)[1] for t in ("you 1d10t!", "іdiot", "loweigen lowei", "the trash can", "trash", "idiotic", None)] == [1, 1, 2, 0, 1, 0, 0]


def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, 0, 1), (0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(20, 50))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {0, 3, 4, 5, 6, 7, 8} <= ids and not ids & {1, 2, 9, 23}
