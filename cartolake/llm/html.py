"""HTML extraction: flat text blocks, judged by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its word count and link density and those of its
neighbours on both sides, its tag, its share of words that notices, adverts, comments and page ends are written with, whether the last heading
was that of comments or the like, and what its open containers say of themselves (names, classes, ids, roles). A decision tree learned from a small labelled
table of pages, which is a parameter, says which blocks are main text; those are joined by blank lines. Half of the labelled pages name their
containers and half don't, so that the tree has to tell the latter by words and links alone; `features` leaves features out of it.

A null or empty page, and one without main text, gives an empty text. Unclosed, crossed and cut-off tags are taken as they
come. Pages of any length and depth are read whole, in time that grows with their length; repeated rows are read alone. A tie of the tree
(half of the labelled blocks) is main text. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: Raw text to the end tag, or the page's end.
_RAW_END = {k: re.compile(rf"</{k}\s*>|\Z", re.I) for k in ("script", "style", "iframe", "textarea", "title")}
#: Boxes that are left out up to their end tag, or, where that is missing, up to the next block or container.
_SKIPPED = {k: re.compile(rf"<(/?){k}(?![A-Za-z0-9:-])[^>]*>", re.I) for k in ("noscript", "template", "svg", "object", "select", "button", "canvas", "video", "audio")}
_BLOCK = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary legend hr div section article main nav aside header footer form ul ol dl table tr tbody thead tfoot figure details dialog body html head fieldset address hgroup menu center".split())
_BOX = set("div section article main nav aside header footer form ul ol dl table tr td figure details dialog body blockquote fieldset menu li span a address center".split())
_HINTS = re.compile(r"""(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_WORDS = re.compile(r"[^\W\d_]+")
#: What containers may say of themselves.
JUNK = {
    "ad": "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion promotional banner outbrain taboola partner",
    "notice": "cookie cookies consent notice notices gdpr popup modal overlay alert newsletter subscribe subscription signup login paywall toast dialog announcement disclaimer",
    "comment": "comment comments reply replies respond discussion disqus thread reactions feedback reviews",
    "menu": "menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar tabs topbar masthead header footer foot copyright legal skip search sitemap languages",
    "side": "sidebar side aside related recommended recommendations share sharing social widget widgets tags trending popular more latest rail teaser",
}
_JUNK = {w: k for k, ws in JUNK.items() for w in ws.split()}
_CONTENT = set("article content post entry story main body articlebody text".split())
_TAG_JUNK = {"nav": "menu", "footer": "menu", "header": "menu", "menu": "menu", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice"}
KINDS = ("ad", "notice", "comment", "menu", "side", "form")
#: Words that other blocks than main text are written with.
CUES = set(
    "cookie cookies consent accept agree subscribe subscribers newsletter sign login register account password advertisement sponsored sponsor offer offers sale buy shop store discount "
    "deal deals free order copyright rights reserved privacy terms contact imprint sitemap comment comments reply replies replied says wrote posted related recommended share tweet follow "
    "search menu home next previous more read also popular trending kommentar kommentare antworten datenschutz impressum anzeige abonnieren angebot kaufen commentaire commentaires "
    "répondre abonnez publicité achetez comentario comentarios responder suscríbete publicidad aviso compra".split()
)
#: Of these, words of headings after which no main text comes.
SECTIONS = set("comment comments reply replies related recommended popular trending kommentare antworten commentaires comentarios".split())
TEXT_FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "loose", "cues", "after_cue")
FEATURES = (*TEXT_FEATURES, "in_article", "in_content", "in_junk", *KINDS)


def _ends(page: str, name: str) -> dict[int, int]:
    """Where each tag of the name that has its end tag starts, and where that end tag ends."""
    out: dict[int, int] = {}
    begun: list[int] = []
    for m in _SKIPPED[name].finditer(page):
        if not m[1]:
            if m[0][-2] != "/":
                begun.append(m.start())
        elif begun:
            out[begun.pop()] = m.end()
    return out


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """(text, features) of every block that has text, in page order."""
    out: list[tuple[str, list[float]]] = []
    page, at = page or "", 0
    stack: list[tuple[str, str | None, bool, bool]] = []  # name, kind of junk, article, content
    text: list[str] = []
    linked: list[str] = []
    anchor, tag, skipped, after_cue = 0, "", "", False
    ends: dict[str, dict[int, int]] = {}
    open_: Counter[str | None] = Counter()  # containers by name, and in the same way kinds, articles and contents as "kind ", "article " and "content "

    def count(box: tuple[str, str | None, bool, bool], by: int) -> None:
        open_[box[0]] += by
        open_[f"{box[1] or ''} "] += by
        open_["article "] += by * box[2]
        open_["content "] += by * box[3]

    def close() -> None:
        nonlocal text, linked, after_cue
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            n, k = words.count(" ") + 1, len(html.unescape(" ".join(linked)).split())
            heading = tag[:1] == "h" and tag[1:].isdigit()
            cues = sum(w in CUES for w in _WORDS.findall(words.lower())) / n
            if heading or n <= 3:
                begins = 2 * sum(w in SECTIONS for w in _WORDS.findall(words.lower())) >= n
                after_cue = begins if heading else after_cue or begins
            own = [open_[f"{kind} "] > 0 for kind in KINDS]
            loose = tag in ("", "div", "body", "section", "span", "td")
            out.append((words, [n, min(1.0, k / n), 0, 0, 0, 0, heading, tag in ("li", "dt", "dd"), loose, cues, after_cue, open_["article "] > 0, open_["content "] > 0, any(own), *own]))
        text, linked = [], []

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            if not skipped:
                text.append(piece)
                if anchor:
                    linked.append(piece)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _RAW_END and not m[1]:
            if m[3].rstrip()[-1:] != "/":
                at = _RAW_END[name].search(page, at).end()
            continue
        if name in _SKIPPED:
            if m[1]:
                skipped = "" if name == skipped else skipped
            elif m[3].rstrip()[-1:] != "/":
                if name not in ends:
                    ends[name] = _ends(page, name)
                if m.start() in ends[name]:
                    at = max(at, ends[name][m.start()])
                elif not skipped:
                    skipped = name
            continue
        if name in _BLOCK or name in _BOX and name not in ("span", "a"):
            skipped = ""
        if name == "a":
            anchor = 0 if m[1] else 1
        if name == "br":
            text.append(" ")
        if name in _BLOCK:
            close()
            tag = "" if m[1] else name
        if name in _BOX:
            if m[1]:
                at_box = len(stack) - 1 if open_[name] else -1
                while at_box >= 0 and stack[at_box][0] != name:
                    at_box = -1 if name in ("span", "a") and stack[at_box][0] not in ("span", "a") else at_box - 1
                if at_box >= 0:
                    if name not in ("span", "a"):
                        anchor = 0
                    for box in stack[at_box:]:
                        count(box, -1)
                    del stack[at_box:]
            else:
                says = [w for g in _HINTS.findall(m[3]) for w in _SPLIT.split("".join(g).lower()) if w] if "=" in m[3] else []
                article = name in ("article", "main")
                kind = _TAG_JUNK.get(name)
                if name == "header" and open_["article "]:
                    kind = None
                content = not _CONTENT.isdisjoint(says)
                kind = kind or (None if name in ("article", "main", "body", "html") else next((_JUNK[w] for w in says if w in _JUNK), None))
                if name in ("span", "a") and (name == "a" or kind is None):
                    continue
                if name == "li" and stack and stack[-1][0] == "li":
                    count(stack.pop(), -1)
                stack.append((name, kind, article, content and kind is None))
                count(stack[-1], 1)
    if at < len(page) and not skipped:
        text.append(page[at:])
    close()
    for i, (_, f) in enumerate(out):
        if i:
            f[2], f[3] = out[i - 1][1][:2]
        if i + 1 < len(out):
            f[4], f[5] = out[i + 1][1][:2]
    return out


#: Labelled pages: each block is written as 'M' or 'J' (main or junk), a bar, and its markup; the label is not part of the page.
#: In each page _LONG and _MID stand for sentences; every page is learned from at each pair of lengths in VARIANTS.
_LONG = "The harbour was built in the last century, and the town has kept most of the stone quays that the first masons laid there."
_MID = "Boats still come in with the tide, but fewer each year."
_A = '<a href="/x">'
LABELLED = (
    f"""J|<nav><ul><li>{_A}Home</a></li>|J|<li>{_A}News</a></li></ul></nav>|J|<div class="ad">Great offers on summer shoes, today only in our store.</div>|M|<article><h1>The old harbour</h1>|M|<p><b>{_LONG}<br>|M|<p>{_MID}</p>|M|<p>So.</p>|M|<p>{_LONG} {_A}More</a> on that.</p></article>|J|<footer>&copy; harbour.example &middot; All about us.</footer>""",
    f"""J|<header><div class="logo">Daily Tide</div>|J|<form action="/s">Search the site</form></header>|J|<div id="cookie-notice">We use cookies to make this site better for you. {_A}Fine</a></div>|M|<main><h1>Tides</h1>|M|<p>{_MID}</p>|M|<ul><li>Spring tides are high.</li>|M|<li>Neap tides are low.</li></ul>|M|<blockquote>{_LONG}</blockquote></main>|J|<aside><h3>Related</h3>|J|<p>{_LONG}</p>|J|<ul><li>{_A}Ten boats to see</a></li></ul></aside>|J|<footer>{_LONG}</footer>""",
    f"""J|<div class="menu">{_A}One</a> {_A}Two</a> {_A}Three</a></div>|M|<div class="content"><h2>Of nets</h2>|M|<div>{_LONG}</div>|M|<p>{_MID}</p>|J|<div class="advert">{_MID}</div>|M|<p>{_LONG}</p></div>|J|<div class="comments"><h3>Comments</h3>|J|<p>{_LONG}</p>|J|<p>Nice.</p></div>|J|<div class="footer">Imprint</div>""",
    f"""J|<div>{_A}Home</a> | {_A}Boats</a> | {_A}Nets</a></div>|M|<h1>Knots that every sailor should know</h1>|M|<p>{_LONG}</p>|M|<p>{_LONG} {_MID}</p>|M|<p>{_MID}</p>|J|<p>{_A}Next page</a></p>|J|<p>{_A}Contact</a> {_A}Terms</a></p>""",
    f"""J|<nav>{_A}Start</a></nav>|M|<article><header><h1>Sails</h1></header>|M|<p>{_LONG}</p>|J|<aside class="ad">{_MID}</aside>|M|<p>{_MID}</p>|J|<form>Sign up for letters about boats and more of that kind.</form>|M|<h2>Masts</h2>|M|<p>Of oak.</p>|J|<section class="comments"><p>{_LONG}</p>|J|<p>First!</p></section></article>|J|<div class="sidebar"><p>{_MID}</p></div>|J|<footer><p>{_MID}</p></footer>""",
    f"""J|<div class="newsletter">Get our letter each week, free.</div>|M|<article><p>{_MID}</p>|M|<p>{_A}The mole</a> {_A}and the pier</a></p>|M|<table><tr><td>High water</td>|M|<td>06:12</td></tr></table></article>|J|<div class="social">Share this</div>|J|<div class="related">{_LONG}</div>""",
    f"""M|<body><p>{_LONG}</p>|M|<p>{_LONG} {_LONG}</p>|J|<div class="promo">{_LONG}</div>|M|<p>{_MID} {_LONG}</p>|J|<div class="consent">{_MID}</div></body>""",
    f"""J|<div>{_A}Home</a> {_A}Boats</a> {_A}Contact</a></div>|J|<div>We use cookies to make this site better. Accept all cookies or read our privacy terms.</div>|M|<h1>The mole</h1>|M|<p>{_LONG}</p>|M|<p>{_MID}</p>|M|<p>{_LONG} {_MID}</p>|J|<div>Sponsored: summer shoes on sale, buy them in our shop today.</div>|M|<p>{_LONG}</p>|J|<h3>Comments</h3>|J|<p>Anna: {_MID}</p>|J|<p>Nice, thank you. {_A}Reply</a></p>|J|<div>Copyright harbour.example, all rights reserved. {_A}Terms</a></div>""",
    f"""<table><tr>J|<td>{_A}Start</a></td>|J|<td>{_A}All harbours of the coast</a></td></tr><tr>|M|<td>{_LONG}</td></tr>|M|<tr><td>{_LONG} {_MID}</td></tr><tr>|M|<td>{_MID}</td></tr></table>|J|<div>{_A}Next</a> {_A}Previous</a></div>|J|<div>Contact us or read our terms and privacy notice.</div>""",
    f"""J|<div>{_A}News</a></div>|J|<div>{_A}Weather</a></div>|J|<div>{_A}Search</a></div>|M|<div>{_LONG}</div>|M|<div>{_LONG} {_LONG}</div>|J|<div>Sign up for our newsletter: free, each week.</div>|M|<div>{_MID} {_LONG}</div>|M|<h2>After the storm</h2>|M|<div>{_MID}</div>|J|<h2>Related</h2>|J|<div>{_A}Ten boats that came back</a></div>|J|<p>{_LONG} {_A}Read more</a></p>|J|<div>{_A}About</a> {_A}Imprint</a> Copyright 2020</div>""",
    f"""J|<p>{_A}Home</a> / {_A}Tides</a> / {_A}Tables of tides</a></p>|M|<h1>Neap tides</h1>|M|<p>{_MID}</p>|M|<ul><li>High water at noon.</li>|M|<li>Low water at six.</li></ul>|M|<p>{_LONG}</p>|J|<p>Advertisement</p>|J|<p>Great deals: order two nets and get one free, only in our store.</p>|M|<p>{_LONG}</p>|J|<p>{_A}Share</a> {_A}Tweet</a> {_A}Follow us</a></p>|J|<h4>3 comments</h4>|J|<p>Ben says: {_LONG}</p>|J|<p>Carl replied: {_MID}</p>|J|<p>Login or register to post a comment.</p>""",
    f"""J|<div>{_A}Alpha</a> {_A}Beta</a> {_A}Gamma</a> {_A}Delta</a></div>|M|<p>{_LONG}</p>|M|<p>{_LONG}</p>|M|<blockquote>{_MID}</blockquote>|M|<p>{_MID} {_A}the quay</a> {_LONG}</p>|M|<p>Yes.</p>|M|<p>{_LONG}</p>|J|<ul><li>{_A}The old port</a></li>|J|<li>{_A}A new pier</a></li>|J|<li>{_A}Of gulls</a></li></ul>|J|<div>Imprint {_A}Contact</a></div>""",
    f"""J|<div>Subscribe to our newsletter for free offers.</div>|J|<div>{_A}Menu</a></div>|M|<div><h1>Sails and masts</h1>|M|{_LONG}</div>|M|<p>{_MID}</p>|M|<p>{_LONG}</p>|J|<p>Read also: {_A}The rope walk</a></p>|M|<p>{_MID} {_LONG}</p>|J|<div>Reply</div>|J|<div>Dora wrote: {_MID}</div>|J|<div>{_A}Privacy</a> {_A}Contact</a></div>""",
    f"""J|<nav>{_A}Start</a></nav>|M|<article><h1>Shop signs of the old town</h1>|M|<p>Read more. Free offer.</p>|M|<p>{_LONG}</p>|M|<p>All rights reserved.</p>|M|<p>Buy, sign, and order.</p>|M|<p>{_MID}</p></article>|J|<footer>All rights reserved. {_A}Terms</a></footer>""",
    f"""J|<header>{_A}Home</a></header>|M|<main><article><h1>Home</h1>|M|<p>{_MID}</p>|M|<p>Related to this, the store and its terms: more to follow.</p>|M|<p>Log in, it said.</p>|J|<aside>{_MID}</aside>|J|<form>Sign up</form>|M|<p>{_LONG}</p></article></main>|J|<div class="footer">Privacy</div>""",
    f"""J|<ul><li>{_A}A</a></li>|J|<li>{_A}B</a></li></ul>|M|<div id="main"><p>Yes.</p>|M|<p>{_LONG}</p>|M|<li>{_MID}</li></div>|J|<div id="footer">{_A}Imprint</a> {_LONG}</div>|J|<div>{_A}Top</a></div>""",
)


#: Main text may hold a few of the words in CUES too.
_CUED = "She wrote in spring that the harbour had twice as much rope in store as the year before, and that those who had read of it there would like to see the boats along the shore."
VARIANTS = ((_LONG, _MID), (f"{_LONG} {_CUED}", _CUED), (_CUED, f"{_CUED} {_MID} {_LONG}"), (f"{_LONG} {_LONG} {_LONG}", _LONG), (_MID, "Calm sea."), (f"{_MID} {_LONG}", f"{_LONG} {_MID}"))


def labelled_blocks(pages: tuple[str, ...] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in (p.replace(_LONG, "\0").replace(_MID, "\1").replace("\0", a).replace("\1", b) for p in pages for a, b in VARIANTS):
        parts = re.split(r"(?:^|\|)([MJ])\|", page)[1:]
        marks = parts[::2]
        got = blocks("".join(parts[1::2]))
        if len(got) != len(marks):
            raise ValueError(f"{len(marks)} labels for {len(got)} blocks")
        x += [f for _, f in got]
        y += [m == "M" for m in marks]
    return np.array(x, float), np.array(y, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int):
    """A binary tree by Gini impurity: (feature, threshold, low side, high side), or a leaf's share of main text. Of equal splits the first
    feature's and its lowest is taken."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            n = low.sum()
            if n < least or len(y) - n < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            cost = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, f, t)
    if best is None:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, f: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
    return tree


@dataclass(frozen=True)
class HtmlParams:
    labelled: tuple[str, ...] = LABELLED
    depth: int = 10
    least: int = 1
    #: Features that the tree may use.
    features: tuple[str, ...] = FEATURES


def main_text(page: str | None, tree) -> str:
    return "\n\n".join(t for t, f in blocks(page) if decide(tree, f) >= 0.5)


def extract(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    x, y = labelled_blocks(p.labelled)
    tree = grow(x * np.isin(FEATURES, p.features), y, p.depth, p.least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256, column="html"):
            texts = [main_text(h, tree) for h in part["html"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": part["page_id"], "url": part["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kinds = {k: pages.schema[k].dataType.simpleString() for k in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
