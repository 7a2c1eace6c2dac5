"""URL filter: host/path rules, and logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled URL table (a fixed list, or a bounded
DataFrame collected once), and compiled into one Spark column: scoring uses built-in functions only.

Defined results: a null URL, or one without ``://``, has an empty host and an empty path; no rule
fits an empty path, and its score is the model's bias.  Repeated URLs are judged alike.  Extra
columns of the input are not read.  An empty table gives an empty result.  A label table with one
class or no rows raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path prefix); the longest one that fits decides.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The labelled URL table: hosts and paths as a list of unwanted sites and one of ordinary sites name them, by kind.
UNWANTED = {
    "medicines": "bestrxonline.com/viagra-discount genericmeds24.biz/order/cialis canadianpharmacy.info/cheap-pills pharmacystore.net/buy-now buytabletsonline.org/no-prescription dietpills.biz/lose-weight-fast cheapmeds.net/order onlinepharmacy.biz/pills weightlosspills.com/offer pillsdirect.info/shop steroidshop.org/buy discountdrugs.net/no-rx",
    "gambling": "vegascasino.com/slots/bonus onlinepokerroom.net/play sportsbetting.info/odds luckyjackpot.biz/win/claim casinobonus.org/free-spins bet-now.com/live bingoonline.net/sign-up casinoroyale.biz/jackpot slotmachines.net/spin betting-tips.org/today winbigcasino.com/register pokerbets.info/tables onlinecasino.org/bonus-code footballbets.com/live-odds",
    "adult": "xxxvideos.net/free adultcams.com/live hotsexchat.biz/girls nudepics.info/gallery pornhost.net/tube/free escortsdating.com/tonight sexdates.com/join freeporn.org/videos livesexcams.net/chat adultdating.info/meet",
    "advertising": "adserver.net/banner/click ads.popunder.com/redirect clicktracker.biz/pixel.gif tracking.adnetwork.com/beacon bannerads.info/show affiliatelinks.net/go/offer adclick.biz/track popads.net/serve tracker.info/pixel ads.server.org/banner clickbank-offers.com/hop trackingads.com/conversion",
    "fraud": "winaniphone.com/claim-prize paypal-login-secure.info/verify account-update.biz/signin freegiftcards.net/survey cryptodouble.com/invest instantloans.info/apply getrichquick.biz/now lotterywinner.org/claim freeiphone.org/win prizewinner.biz/claim-now verify-bank.info/login easymoney.com/work-from-home paydayloans.org/cash bitcoinprofit.net/join",
    "copies": "crackedsoftware.net/keygen warezdownload.org/serial freemovies.biz/watch-online torrentz.info/full-hd replicawatches.com/rolex-cheap fakedesigner.net/bags freedownload.biz/crack pirated.org/movies serialkeys.net/free cheapwatches.info/replica streamfree.net/episodes",
    "link trading": "linkfarm.biz/backlinks seospam.net/submit articlespinner.info/rewrite buyfollowers.com/likes freetraffic.org/hits guestpost.biz/cheap-links spamlinks.org/post contentfarm.net/articles seofarm.com/links bulkemail.biz/spam cheaptraffic.info/visitors linkexchange.net/add autoblog.org/spun",
}
WANTED = {
    "news": "dailynews.com/politics/2021/05 theherald.co.uk/world/story tribune.org/opinion/letters morningpost.net/economy gazette.org/weather localpaper.com/sport/results lemonde-info.fr/societe nachrichten.de/wirtschaft elpais-noticias.es/cultura",
    "reference": "encyclopedia.org/wiki/Mathematics dictionary.net/define/word openmaps.org/city/park wikibooks.org/history thesaurus.com/synonym statistics.gov/tables/census bibliothek.de/katalog enciclopedia.es/articulo",
    "teaching": "university.edu/physics/research school.org/pupils/calendar college.ac.uk/courses/biology lectures.net/theory/notes academy.org/library/thesis institute.de/forschung ecole.fr/enseignement universidad.es/facultad",
    "government": "parliament.gov/bills/42 ministry.gov/health/report cityhall.org/council/minutes court.gov/decisions transport.gov/roads mairie.fr/services ayuntamiento.es/tramites",
    "culture": "museum.org/exhibitions/ancient theatre.com/season/tickets orchestra.org/concerts filmarchive.net/catalogue gallery.org/painters poetry.net/authors musee.fr/collection literatura.es/autores",
    "science and health": "astronomy.org/observations hospital.org/patients/visit chemistry.net/elements nature-journal.com/articles geology.org/rocks medicine.edu/anatomy forschung.de/ergebnisse",
    "technology": "docs.python-guide.org/tutorial/functions kernel-notes.net/patches github-pages.io/project/readme forum.linuxhelp.org/thread/1021 engineering.blog.com/databases standards.org/rfc/793 softwarearchive.net/manual",
    "home and travel": "gardening.org/roses recipes.com/bread/sourdough travelguide.net/mountains/paths railways.org/timetable weather.com/forecast knitting.net/patterns cuisine.fr/recettes wandern.de/routen",
    "people": "blog.thewriter.net/2019/03/letters johnsmith.com/about familyhistory.org/names photographer.net/portfolio neighbours.org/meeting carpenter.com/workshop together.org/volunteers",
    "trade": "bookshop.com/novels hardware.net/tools furniture.org/chairs bakery.com/opening-hours insurance.net/contact bank.com/branches bicycle.org/repairs stationery.net/paper",
}
LABELLED = tuple((f"https://{u}", y) for y, kinds in ((1, UNWANTED), (0, WANTED)) for urls in kinds.values() for u in urls.split())


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)).otherwise(F.lit(""))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null without one.

    A rule fits its host and every subdomain if the path starts with the rule's path.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


class NgramLogistic:
    """Logistic regression on counts of hashed character n-grams of ``host + path``."""

    def __init__(self, n: tuple[int, ...] = (2, 3, 4, 5), dims: int = 4096, epochs: int = 150, rate: float = 0.5, l2: float = 1e-4):
        self.n, self.dims, self.epochs, self.rate, self.l2 = n, dims, epochs, rate, l2
        self.weights, self.bias = [0.0] * dims, 0.0

    def features(self, text: str) -> Counter:
        text = f"^{text}$"
        found = Counter(self.slot(text[i : i + n]) for n in self.n for i in range(len(text) - n + 1))
        total = math.sqrt(sum(found.values())) or 1.0
        return Counter({k: v / total for k, v in found.items()})

    def slot(self, gram: str) -> int:
        return int(hashlib.md5(gram.encode()).hexdigest()[:6], 16) % self.dims

    @staticmethod
    def split(url: str) -> str:
        rest = url.partition("://")[2] if "://" in url else ""
        rest = rest.partition("#")[0].partition("?")[0]
        host, slash, path = rest.partition("/")
        return host.translate(str.maketrans(UPPER, LOWER)) + slash + path

    def fit(self, labelled: Iterable[tuple[str, int]]) -> NgramLogistic:
        rows = [(self.features(self.split(u)), y) for u, y in labelled]
        if len({y for _, y in rows}) < 2:
            raise ValueError("labelled URLs of both classes are needed")
        for epoch in range(self.epochs):
            step = self.rate / (1 + epoch / 20)
            for x, y in rows:
                p = 1 / (1 + math.exp(-self.bias - sum(self.weights[k] * v for k, v in x.items())))
                for k, v in x.items():
                    self.weights[k] -= step * ((p - y) * v + self.l2 * self.weights[k])
                self.bias -= step * (p - y)
        return self

    def score(self, text: Column) -> Column:
        """The model as a column expression over ``host + path``."""
        table = F.split(F.lit(",".join(f"{w:.9g}" for w in self.weights)), ",").cast("array<double>")
        text = F.concat(F.lit("^"), text, F.lit("$"))
        size = F.length(text)
        none = F.array().cast("array<string>")
        runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
        grams = F.concat(*(F.when(size >= n, runs(n)).otherwise(none) for n in self.n))
        total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.element_at(table, (F.conv(F.substring(F.md5(g.cast("binary")), 1, 6), 16, 10).cast("int") % self.dims + 1)))
        count = F.greatest(F.size(grams), F.lit(1))
        return 1 / (1 + F.exp(-(total / F.sqrt(count) + self.bias)))


def judge(pages: DataFrame, url: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, labelled: Iterable[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, the model's score and the verdict (allow or block)."""
    model = NgramLogistic().fit(labelled)
    host, path = host_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "_rule_says": verdict, "url_score": model.score(F.concat("host", "path"))})
    says = F.when(F.col("url_score") >= threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("_rule_says", says)).drop("_rule_says")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    from rankloom.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
