"""URL filters: allow and block rules, then a logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled table, which is a parameter. Rules name a host and the beginning of a path; a rule fits
its host and all subdomains, and the longest fitting rule decides. Where no rule fits, the model does.

A null url, or one without '://', has an empty host and path; its verdict is allow. Repeated rows are judged alone, other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: (verdict, host, path) of the rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: The labelled table: hosts and paths of unwanted sites (1) and of ordinary ones (0).
LABELLED = tuple(
    (f"https://{u}", y)
    for y, names in (
        (1, """cheap-pills.example.com/en/12 www.cheap-pills.net/buy blog.cheap-meds.example.net/en/order pills-online.com/de/4 buy-viagra.example.org/en/1 casino-win.com/en/3
            m.casino-win.example.com/es/44 casino-royal.org/fr/9 online-casino.example.net/bonus casino-slots.com/en/77 free-bets.example.org/en/5 www.free-bets.org/fr/61
            bets-now.example.com/de/31 sports-bet.com/es/7 spam-farm.example.net/en/18 blog.spam-farm.com/de/90 link-farm.example.org/en/2 adult-x.net/en/33
            m.adult-x.example.com/fr/8 adult-chat.com/x xxx-videos.example.net/en/6 porn-tube.com/watch/3 sexcams.example.org/en/20 ads-track.com/en/66
            www.ads-track.example.com/de/5 ad-server.net/click clicktrack.example.net/r/1 popunder-ads.org/en/9 tracker-pixel.example.org/p payday-loans.com/en/4
            quick-loan.example.com/apply replica-watches.com/en/8 cheap-rolex.example.net/de/3 free-ringtones.org/fr/5 warez-download.example.org/en/1 cracked-apps.com/es/2
            torrent-warez.example.com/en/0 lottery-winner.net/claim work-from-home-cash.example.net/en/7 get-rich-fast.net/de/6 miracle-diet.example.org/en/11 weight-loss-pills.org/es/3
            escort-girls.example.com/en/5 poker-bonus.com/fr/7 slots-jackpot.example.net/en/3 essay-mill.com/order crypto-doubler.example.org/en/1 free-iphone-prize.com/win"""),
        (0, """ththan.example.net/en/960 www.therti.example.org/en/334/ blog.theren.example.net/en/455 thering.example.com/en/328/ m.therou.example.com/fr/474.html ththly.example.org/de/777 tionsh.example.net/es/533 thersh.example.org/fr/12
            ererin.example.com/en/41 ononti.example.org/de/83 haented.example.net/en/5.html www.enanor.example.com/fr/301 lestre.example.org/fr/22 eaument.example.net/fr/6 schein.example.net/en/19 dieung.example.org/de/480
            thehe.example.com/en/81 tionor.example.com/en/307 m.ontion.example.com/de/55 www.thereas.example.com/es/9 hestat.example.com/en/640.html ingble.example.com/fr/2 andthe.example.com/en/16 ntor.example.com/de/712
            theor.example.net/en/4 tiones.example.org/en/93 ouand.example.net/fr/820 blog.enthes.example.com/en/58/ atwhe.example.org/es/37 lyere.example.com/en/903 thinand.example.com/es/71 therof.example.com/en/250
            cionos.example.com/fr/64 quelas.example.net/es/700 city-library.org/en/catalogue news.daily-herald.com/en/2021 www.university.edu/en/course/3 blog.gardening.org/en/roses docs.python.org/en/library wiki.history.net/de/1848
            museum-berlin.net/en/ausstellung recipes.kitchen.com/fr/tarte weather.gov/en/forecast science-journal.org/en/vol/8 forum.cycling.net/es/rutas maps.hiking.org/fr/alpes school-district.org/en/calendar www.opera-house.com/fr/saison
            local-paper.net/en/sports health.clinic.org/en/flu train-times.com/de/fahrplan books.publisher.net/en/novel open-data.org/en/sets art-gallery.com/es/obras bird-watching.org/en/43 street-food.net/fr/lyon
            music-theory.com/en/chords chess-club.org/de/turnier parliament.gov/en/debates farm-shop.com/en/eggs trackandfield.org/en/results adulteducation.edu/en/evening water-works.net/es/5 pillow-makers.com/fr/lin betteridge.org/en/51 castle-tours.com/de/88"""),
    )
    for u in names.split()
)


@dataclass(frozen=True)
class UrlParams:
    rules: tuple[tuple[str, str, str], ...] = RULES
    labelled: tuple[tuple[str, int], ...] = LABELLED
    grams: tuple[int, ...] = (3, 4, 5)
    bits: int = 15
    path_weight: float = 0.3
    ridge: float = 0.001
    steps: int = 600
    threshold: float = 0.5


def parse(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def rule_for(host: str, path: str, rules: tuple[tuple[str, str, str], ...]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits. Every end of the host after a dot is tried."""
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def features(host: str, path: str, p: UrlParams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of host and path, ends marked, digits alike; and their values, in all of length 1 for the host and
    `path_weight` for the path, since a path alone seldom tells."""
    at, value = [], []
    digits = str.maketrans("123456789", "000000000")
    for tag, text, weight in (("h", host, 1.0), ("p", path, p.path_weight)):
        text = f"^{text.lower().translate(digits)}$"
        own = {xxhash.xxh32_intdigest(f"{tag}{text[i : i + n]}") % (1 << p.bits) for n in p.grams for i in range(len(text) - n + 1)}
        at += sorted(own)
        value += [weight / max(len(own), 1) ** 0.5] * len(own)
    return np.array(at, np.int64), np.array(value)


class UrlModel:
    """Logistic regression with ridge, by gradient steps from zero: the same table gives the same model."""

    def __init__(self, p: UrlParams):
        self.p = p
        x = np.zeros((len(p.labelled), 1 << p.bits))
        for i, (u, _) in enumerate(p.labelled):
            np.add.at(x[i], *features(*parse(u), p))
        y = np.array([y for _, y in p.labelled], float)
        use = np.flatnonzero(x.any(axis=0))
        x, v, bias = x[:, use], np.zeros(len(use)), 0.0
        for _ in range(p.steps):
            e = 1 / (1 + np.exp(-(bias + x @ v))) - y
            v -= 4.0 * (x.T @ e / len(y) + p.ridge * v)
            bias -= 1.0 * e.mean()
        self.w, self.bias = np.zeros(1 << p.bits), float(bias)
        self.w[use] = v

    def score(self, host: str, path: str) -> float:
        at, value = features(host, path, self.p)
        return float(1 / (1 + np.exp(-(self.bias + self.w[at] @ value))))


def judge(pages: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (the model's probability of an unwanted site)."""
    model = UrlModel(p)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url in b["url"].to_pylist():
                host, path = parse(url)
                fit, s = rule_for(host, path, p.rules), model.score(host, path)
                verdict = fit[1] if fit else "block" if host and s >= p.threshold else "allow"
                rows.append((host, path, fit[0] if fit else None, verdict, s))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_pydict({"page_id": b["page_id"]} | {k: pa.array(v, pa.string()) for k, v in zip(("host", "path", "rule", "verdict"), cols[:4], strict=True)} | {"score": pa.array(cols[4], pa.float64())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
