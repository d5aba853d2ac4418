"""URL filter: explicit rules, then logistic regression on hashed character n-grams of host and path.

The model is trained from the small labelled table below (or another of that
form), on the driver, by full gradient steps from zero, so it is the same each
time. It is a vector of ``BUCKETS`` weights, which is broadcast with the rules.
Rules are looked up by the host and each domain that it is under, so any number
of them costs the same. Scoring is one narrow Arrow pass over the url column.

Defined results. A null url, or one without ``://``, has empty host and path;
no rule fits and it is allowed. Very long urls are judged whole. Rules of equal
length are taken in the order of their text. Repeated rows are judged each; an
empty table gives an empty result; columns of the caller are kept, and one that
is named like an output gets underscores before its name.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, table

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
THRESHOLD = 0.5
STEPS = 20_000
RATE = 4.0
DECAY = 1e-5

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Labelled urls, 1 to block: invented hosts of the kinds that block lists and directories name, under reserved names.
LABELLED = """
1 http://royal-casino.invalid/slots/welcome-bonus
1 https://www.lucky-slots.invalid/jackpot
1 http://pokerroom.invalid/play/holdem
1 https://online-roulette.invalid/spin
1 http://m.blackjack-vip.invalid/tables/3
1 https://bet-on-sports.invalid/odds/today
1 http://livebetting.invalid/football
1 https://www.bookie-offers.invalid/free-bet
1 http://gamble-now.invalid/register
1 https://casino-bonus-codes.invalid/list
1 http://discount-pills.invalid/order/12
1 https://www.pharmacy-no-prescription.invalid/buy
1 http://weight-loss-pills.invalid/miracle
1 https://cheapmeds.invalid/cart
1 http://generic-tablets.invalid/shop/blue
1 https://steroids-shop.invalid/buy-online
1 http://hot-girls-cam.invalid/live
1 https://www.xxx-movies.invalid/watch/77
1 http://adultdating.invalid/join
1 https://sexy-singles.invalid/chat
1 http://free-porn-tube.invalid/video/5
1 https://nude-pics.invalid/gallery
1 http://escort-listing.invalid/city/4
1 https://payday-cash.invalid/apply
1 http://instant-loans.invalid/approval
1 https://bad-credit-ok.invalid/loan
1 http://get-rich-quick.invalid/system
1 https://earn-money-home.invalid/join-now
1 http://crypto-doubler.invalid/deposit
1 https://forex-signals-pro.invalid/win
1 http://replica-handbags.invalid/sale
1 https://fake-watches.invalid/luxury/9
1 http://cheap-jerseys-outlet.invalid/buy
1 https://www.warez-download.invalid/crack/keygen
1 http://serial-keys.invalid/crack
1 https://torrent-free-movies.invalid/download
1 http://click-tracker.invalid/redirect?to=x
1 https://adserver.invalid/banner/300x250
1 http://popunder-ads.invalid/serve.js
1 https://tracking-pixel.invalid/collect
1 http://affiliate-clicks.invalid/go/991
1 https://seo-backlinks.invalid/buy-links
1 http://link-exchange.invalid/submit
1 https://doorway-pages.invalid/keyword/cheap
1 http://spam-comments.invalid/post
1 https://content-spinner.invalid/farm
1 http://win-a-prize.invalid/claim
1 https://free-gift-cards.invalid/survey
1 http://you-have-won.invalid/lottery
1 https://account-verify-login.invalid/update/password
1 http://secure-bank-login.invalid/confirm
1 https://phishing-kit.invalid/download
1 http://malware-payload.invalid/exe
1 https://virus-warning.invalid/call-now
0 http://www.citylibrary.invalid/catalogue
0 https://publiclibrary.invalid/opening-hours
0 http://mountainweather.invalid/forecast/north
0 https://www.localnews.invalid/politics/2
0 http://morningpaper.invalid/culture/review
0 https://gardenclub.invalid/roses/pruning
0 http://www.vegetable-garden.invalid/tomatoes
0 https://homecooking.invalid/recipes/soup
0 http://bakersguild.invalid/bread/rye
0 https://historymuseum.invalid/exhibits/bronze-age
0 http://www.naturalhistory.invalid/fossils
0 https://artgallery.invalid/painters/dutch
0 http://citytheatre.invalid/programme
0 https://www.symphony.invalid/concerts/spring
0 http://folkmusic.invalid/songs/41
0 https://physics-department.invalid/lectures/optics
0 http://www.chemistry.invalid/elements/iron
0 https://biology-notes.invalid/cells
0 http://mathsociety.invalid/journal/12
0 https://stateuniversity.invalid/courses
0 http://primaryschool.invalid/timetable
0 https://www.teachers.invalid/lessons/fractions
0 http://openencyclopedia.invalid/article/river
0 https://dictionary.invalid/word/harbour
0 http://grammar.invalid/verbs/irregular
0 https://www.translation.invalid/phrases
0 http://parliament.invalid/debates/2019
0 https://ministry-of-health.invalid/vaccines
0 http://www.citycouncil.invalid/minutes
0 https://courts.invalid/rulings/88
0 http://hospital.invalid/wards/visiting
0 https://nursing.invalid/training
0 http://www.railways.invalid/timetables/east
0 https://harbourferry.invalid/crossings
0 http://hikingtrails.invalid/routes/lake
0 https://www.travelnotes.invalid/portugal/lisbon
0 http://birdwatching.invalid/species/heron
0 https://astronomy.invalid/planets/saturn
0 http://www.oceanography.invalid/currents
0 https://softwaredocs.invalid/manual/install
0 http://compiler.invalid/reference/types
0 https://www.databases.invalid/tutorial/joins
0 http://openmaps.invalid/tiles
0 https://statistics-office.invalid/tables/population
0 http://agriculture.invalid/wheat/yield
0 https://www.forestry.invalid/pine
0 http://architecture.invalid/bridges/stone
0 https://woodworking.invalid/joints/dovetail
0 http://knitting.invalid/patterns/scarf
0 https://www.chessclub.invalid/games/openings
0 http://swimming.invalid/pool/hours
0 https://cyclingclub.invalid/rides/sunday
0 http://www.football-results.invalid/league/3
0 https://philosophy.invalid/essays/ethics
0 http://poetry.invalid/sonnets/18
0 https://www.bookreviews.invalid/novels
1 https://m.grand-casino.invalid/en/12
1 http://vegas-casino.test/de/promo
1 https://blog.bets-today.test/fr/9
1 http://bet-tips.invalid/es/31
1 https://www.free-spins.test/en/4
1 http://win-cash.test/fr/claim
1 https://diet-pills.test/de/77
1 http://cheap-viagra.test/en/order
1 https://m.cheap-loans.test/es/5
1 http://adult-video.test/fr/18
1 https://www.adult-toys.test/de/shop
1 http://x-rated.invalid/en/8
1 https://ads-exchange.test/en/bid
1 http://track-clicks.test/de/1
1 https://banner-ads.invalid/fr/22
1 http://link-farm.test/en/index
1 https://article-farm.invalid/es/19
1 http://spam-blog.test/de/6
1 https://spamlinks.invalid/fr/101
1 http://free-ringtones.test/es/download
0 https://m.school-library.test/en/12
0 http://weather-station.test/de/today
0 https://blog.mountain-hut.test/fr/9
0 http://theatre-tickets.invalid/es/31
0 https://www.thornton.test/en/4
0 http://northern-heritage.test/fr/history
0 https://otherthings.test/de/77
0 http://station-road.test/en/order-of-service
0 https://m.nationaltrust.test/es/5
0 http://brotherhood.invalid/fr/18
0 https://www.threshold.test/de/essays
0 http://wheat-and-honey.invalid/en/8
0 https://education.test/en/bid-for-funds
0 http://trees-and-leaves.test/de/1
0 https://thinkers.invalid/fr/22
0 http://arthurian.test/en/index
0 https://inheritance.invalid/es/19
0 http://athens-notes.test/de/6
0 https://fourthestate.invalid/fr/101
0 http://wherewithal.test/es/reading
0 https://www.somethingelse.example/en/240
0 http://blog.motherland.example/de/377
0 https://m.anotherhand.example/fr/512
0 http://northeast.example/es/803
"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


class Rules:
    """Of the rules that fit a host and path the longest: its text and verdict."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.of: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for verb, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
            host, slash, rest = text.partition("/")
            self.of[host].append((slash + rest, text, verb))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while at >= 0:
            for start, text, verb in self.of.get(host[at:], ()):
                if path.startswith(start):
                    if best[0] is None or (-len(text), text) < (-len(best[0]), best[0]):
                        best = text, verb
                    break
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


def buckets(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of all character n-grams of host and path, ends marked. Each of the two has the same length as a vector."""
    out, values = [], []
    for kind, text in ((b"h", host), (b"p", path)):
        if text:
            data = b"^" + text.encode() + b"$"
            grams = [zlib.crc32(kind + data[i : i + n]) for n in GRAMS for i in range(len(data) - n + 1)]
            out += grams
            values += [len(grams) ** -0.5] * len(grams)
    return np.asarray(out, np.int64) % BUCKETS, np.asarray(values, np.float32)


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def train(labelled: Sequence[tuple[int, str]]) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    x = np.zeros((len(labelled), BUCKETS), np.float32)
    for i, (_, url) in enumerate(labelled):
        np.add.at(x[i], *buckets(*_parts(url)))
    y = np.array([label for label, _ in labelled], np.float32)
    # the weights are always a mixture of the rows, so the steps are taken on the mixture
    alike, mixture, bias = x @ x.T, np.zeros(len(y), np.float32), np.float32(0)
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(alike @ mixture + bias))) - y
        mixture -= RATE * (error / len(y) + DECAY * mixture)
        bias -= RATE * error.mean()
    return x.T @ mixture, float(bias)


def labelled_table(text: str = LABELLED) -> list[tuple[int, str]]:
    return [(int(a), b) for a, b in (line.split() for line in text.strip().splitlines())]


_OUT = ["host", "path", "rule", "verdict", "block_score"]


def score(model: tuple[np.ndarray, float], host: str, path: str) -> float:
    """The probability that the url is one to block."""
    weights, bias = model
    at, values = buckets(host, path)
    return float(1 / (1 + np.exp(-(weights[at] @ values + bias))))


def judge(pages: DataFrame, keep: list[str], url: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[int, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` with host, path, rule, verdict, block_score (the model's)."""
    shared = pages.sparkSession.sparkContext.broadcast((train(labelled or labelled_table()), Rules(rules)))
    names = [f"c{i}" for i in range(len(keep))]
    host, path = host_and_path(F.col(url))

    def run(batches):
        model, known = shared.value
        for batch in batches:
            of, verdicts, scores = [], [], []
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rule, verdict = known.find(h, p)
                own = score(model, h, p)
                of.append(rule)
                verdicts.append(verdict or ("block" if h and own >= threshold else "allow"))
                scores.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", *names, *_OUT[2:]])

    rows = pages.select(host.alias("host"), path.alias("path"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    out = rows.mapInArrow(run, f"host string, path string, {schema}rule string, verdict string, block_score double")
    return out.select(*names, *_OUT).toDF(*kept(keep, _OUT), *_OUT)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), ["page_id"])
