"""URL filter: host and path rules, and for the rest a logistic regression on hashed character n-grams.

Everything is built-in expressions: the n-grams of host and path are hashed to a fixed number of
buckets, and the score is the sum of their weights.  The weights come from ``pyspark.ml`` on a small
labelled URL table, in the same buckets: addresses written by hand, and ``MADE`` made by rule.  A made
address has a host and a path drawn apart, of the same forms for both labels; what is blocked has words of
``BAD`` in either or both, what is allowed has common words or syllables that mean nothing.  Two of
``HELD`` made addresses are not trained on; the intercept is lowered until at most ``FALSE_BLOCKS`` of the allowed ones
among them are blocked, so an address that the model knows nothing of is let through.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, has no
n-grams and is allowed; rules with an empty host fit nothing; of rules of one length the first listed
wins; urls of any length are read as a whole; repeated rows each get the same row; an empty table gives no
rows; columns beside the id and ``url`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, GRAMS = 1 << 16, (3, 4, 5)
PENALTY, ROUNDS = 0.002, 60

# The labelled URL table that the classifier is trained on, written by hand from what such
# addresses commonly look like; none is taken from a table that it judges.
BLOCKED = (
    "http://online-casino-jackpot.test/slots/free-spins", "https://betting-bonus.invalid/sports-betting", "http://www.luckypoker.test/texas-holdem/play-now", "https://royal-vegas-slots.invalid/welcome-bonus",
    "http://crazy-roulette.test/?ref=88", "https://sportsbook-odds.invalid/live-betting", "http://bingo-jackpots.test/win-big", "https://lotto-winners.invalid/claim-prize",
    "http://cheapviagra.test/buy-viagra-online", "https://discount-pharmacy.invalid/cialis-no-prescription", "http://rx-pills-online.test/order/tramadol", "https://diet-pills-fast.invalid/lose-weight",
    "http://weightloss-miracle.test/burn-fat-now", "https://hair-loss-cure.invalid/special-offer", "http://male-enhancement.test/pills/buy", "https://steroids-shop.invalid/cheap",
    "http://xxxvideos.test/free-porn", "https://hot-singles.invalid/adult-dating", "http://sexcams-live.test/nude-girls", "https://escort-service.invalid/vip-escorts", "http://pornclips.test/xxx/movies", "https://adult-webcam.invalid/sex-chat",
    "http://payday-loans-fast.test/apply-now", "https://quick-cash-advance.invalid/no-credit-check", "http://debt-relief-now.test/get-cash", "https://make-money-online.invalid/earn-5000-a-week",
    "http://bitcoin-doubler.test/invest", "https://crypto-giveaway.invalid/free-btc", "http://forex-robot.test/instant-profit", "https://get-rich-quick.invalid/secret-system",
    "http://replica-watches.test/rolex-cheap", "https://fake-handbags.invalid/louis-vuitton-outlet", "http://cheap-jerseys.test/wholesale", "https://designer-outlet-sale.invalid/90-off",
    "http://free-iphone-winner.test/claim-now", "https://you-have-won.invalid/prize/verify", "http://account-verify-login.test/paypal/secure-update", "https://secure-bank-login.invalid/confirm-password",
    "http://free-download-crack.test/keygen/serial", "https://warez-torrents.invalid/full-version-crack", "http://cheap-backlinks.test/buy-links", "https://seo-link-farm.invalid/submit-link/page-9",
    "http://link-exchange-spam.test/directory/add-url", "https://blogspam-network.invalid/spun-content", "http://click-farm.test/buy-followers", "https://buy-likes-cheap.invalid/instagram-followers",
    "http://spam-mailer.test/bulk-email", "https://popup-ads-farm.invalid/redirect", "http://parked-domains.test/search-ads", "https://essay-writing-cheap.invalid/buy-essay-now",
)
ALLOWED = (
    "https://www.citylibrary.test/catalogue/novels", "http://museum.history.invalid/exhibitions/roman-coins", "https://www.university.test/departments/physics", "http://research.institute.invalid/papers/2019/climate.pdf",
    "https://journal.biology.test/articles/cell-division", "http://www.observatory.invalid/news/comet", "https://docs.programming.test/tutorial/functions.html", "http://wiki.linguistics.invalid/wiki/Phoneme",
    "https://forum.gardening.test/topic/4411-tomato-plants", "http://blog.cooking.invalid/2021/03/bread-recipe", "https://www.recipes.test/soups/lentil", "http://travel.mountains.invalid/guides/hiking-trails",
    "https://www.weather.test/forecast/tomorrow", "http://news.daily.invalid/politics/election-results", "https://www.gazette.test/sport/football-report", "http://archive.newspaper.invalid/1987/05/12",
    "https://www.parliament.test/bills/education", "http://www.ministry.invalid/health/vaccination", "https://statistics.office.test/tables/population", "http://www.court.invalid/judgments/2015/112",
    "https://www.school.test/parents/calendar", "http://kindergarten.invalid/about", "https://courses.online.test/mathematics/algebra-1", "http://lecture.notes.invalid/calculus/chapter-3",
    "https://www.hospital.test/patients/visiting-hours", "http://clinic.invalid/services/dentistry", "https://health.encyclopedia.test/asthma", "http://www.nutrition.invalid/vitamins",
    "https://code.repository.test/project/readme", "http://developer.handbook.invalid/api/reference", "https://bugs.tracker.test/issue/1024", "http://packages.index.invalid/simple/numpy",
    "https://www.orchestra.test/concerts/season", "http://theatre.invalid/programme/hamlet", "https://gallery.art.test/paintings/landscape", "http://poems.collection.invalid/authors/k",
    "https://www.railway.test/timetable", "http://airport.invalid/arrivals", "https://maps.geography.test/rivers", "http://www.zoo.invalid/animals/elephant",
    "https://birds.field-guide.test/species/robin", "http://www.oceanography.invalid/tides", "https://astronomy.club.test/meetings", "http://chess.society.invalid/openings/sicilian",
    "https://www.bookshop.test/history/middle-ages", "http://bakery.invalid/opening-hours", "https://knitting.patterns.test/scarf", "http://woodwork.workshop.invalid/joints",
    "https://family.genealogy.test/surnames/b", "http://www.philosophy.invalid/essays/reason",
)
# Words of addresses to block, and of others.
BAD = (
    "casino", "poker", "slots", "jackpot", "roulette", "betting", "sportsbook", "bingo", "lotto", "blackjack", "viagra", "cialis", "pharmacy", "pills", "tramadol", "steroids", "weightloss", "enhancement",
    "xxx", "porn", "sex", "nude", "escort", "webcam", "hot-singles", "adult-dating", "payday-loans", "cash-advance", "no-credit-check", "debt-relief", "get-rich", "earn-money", "bitcoin-doubler", "free-btc", "forex-robot",
    "crypto-giveaway", "replica", "rolex", "fake-handbags", "outlet-sale", "free-iphone", "you-won", "claim-prize", "account-verify", "login-confirm", "crack", "keygen", "warez", "torrents", "serial", "backlinks", "link-farm",
    "buy-followers", "buy-likes", "bulk-email", "spam", "popup-ads", "click-farm", "essay-writing", "win-big", "free-spins", "bonus-code",
)
COMMON = (
    "library", "museum", "school", "university", "physics", "history", "garden", "recipes", "travel", "weather", "news", "gazette", "parliament", "health", "clinic", "music", "orchestra", "theatre", "gallery", "railway", "airport",
    "maps", "zoo", "birds", "tides", "chess", "books", "bakery", "knitting", "wood", "family", "philosophy", "journal", "research", "papers", "wiki", "forum", "docs", "code", "project", "tracker", "package", "course", "lecture",
    "calendar", "contact", "about", "article", "topic", "category", "tag", "archive", "product", "service", "team", "city", "river", "mountain", "sport", "football", "market", "office", "studio", "design", "photo", "video", "radio",
    "science", "nature", "energy", "water", "house", "kitchen", "hotel", "farm", "village", "church", "bank", "law", "press", "review", "story", "kids", "games", "cars", "bike", "ocean", "forest", "winter", "summer",
)
MADE, HELD, FALSE_BLOCKS = 6000, 4, 0.02
LABELLED = (*((url, 1) for url in BLOCKED), *((url, 0) for url in ALLOWED))
#: Rules of the query: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def parts(url):
    """Host (A-Z lower-cased) and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(kind: str, text, n: int):
    """The buckets of the n-grams of a text; its characters are parted once, so that a long text is read once."""

    def hashed(chars):
        starts = F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.concat(*[F.get(chars, i + k) for k in range(n)])), F.lit(BUCKETS)).cast("int"))

    return F.when(F.length(text) >= n, F.get(F.transform(F.array(F.split(text, "")), hashed), 0)).otherwise(F.array().cast("array<int>"))


def buckets_of(host, path):
    """The distinct buckets of the character n-grams of host and path."""
    found = [grams(kind, text, n) for kind, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$")))) for n in GRAMS]
    return F.when((host == "") & (path == ""), F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(*found)))


def made_urls(spark: SparkSession, n: int = MADE):
    """``n`` addresses by rule (i, url, label), half of them to block; row i is the same in every session."""
    i = F.col("id")

    def draw(name: str, of: int):
        return F.pmod(F.xxhash64(F.lit(name), i), F.lit(of)).cast("int")

    def pick(name: str, options):
        return F.get(F.array(*map(F.lit, options)), draw(name, len(options)))

    def syllables(name: str):
        some = F.concat(*[F.concat(pick(f"{name}c{k}", ("b", "br", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "sh", "t", "th", "tr", "v", "w", "z")), pick(f"{name}v{k}", ("a", "e", "i", "o", "u", "ai", "ou", "en", "on", "ti"))) for k in range(4)])
        return F.substring(some, F.lit(1), 3 + draw(f"{name}n", 7))

    def plain(name: str):
        return F.when(draw(f"{name}k", 5) < 3, syllables(name)).otherwise(pick(f"{name}w", COMMON))

    def either(name: str, bad):
        joined = F.concat(pick(f"{name}b", BAD), F.when(draw(f"{name}j", 3) == 0, F.concat(F.lit("-"), plain(f"{name}x"))).otherwise(F.lit("")))
        before = F.concat(F.when(draw(f"{name}p", 4) == 0, F.concat(plain(f"{name}y"), F.lit("-"))).otherwise(F.lit("")), joined)
        return F.when(bad, before).otherwise(F.concat(plain(f"{name}o"), F.when(draw(f"{name}q", 4) == 0, F.concat(F.lit("-"), plain(f"{name}r"))).otherwise(F.lit(""))))

    bad, where = i % 2 == 1, draw("where", 3)  # bad words in the host, in the path or in both
    host = F.concat(
        pick("front", ("", "", "www.", "www.", "m.", "blog.", "shop.", "news.", "en.", "cdn.", "my.")), either("host", bad & (where != 1)),
        F.when(draw("second", 2) == 0, pick("domain", (".example", ".sample", ".site", ".web"))).otherwise(F.lit("")), pick("top", (".com", ".net", ".org", ".info", ".test", ".invalid")),
    )
    number = draw("number", 9999).cast("string")
    word = either("path", bad & (where != 0))
    path = (
        F.when(bad & (where != 0), F.concat(pick("in", ("/", "/en/", "/de/", "/p/", "/2021/03/")), word, pick("out", ("", "/", ".html", "/page"))))
        .when(draw("form", 4) == 0, F.concat(pick("lang", ("/en/", "/de/", "/fr/", "/es/", "/a/", "/item/", "/")), number, pick("ending", ("", ".html", "/"))))
        .when(draw("form", 4) == 1, F.concat(F.lit("/"), word, F.lit("/"), number))
        .when(draw("form", 4) == 2, F.concat(pick("in2", ("/en/", "/", "/2019/11/")), word, pick("out2", ("", "/", ".html"))))
        .otherwise(pick("short", ("", "/", "/index.html", "/about")))
    )
    return spark.range(0, n, 1, 1).select(F.col("id").alias("i"), F.concat(pick("scheme", ("http://", "https://")), host, path).alias("url"), bad.cast("double").alias("label"))


def train(spark: SparkSession, labelled=LABELLED, made: int = MADE) -> tuple[list[float], float]:
    """Bucket weights and intercept; an address is blocked if its logit is not negative."""
    table = F.array(*[F.struct(F.lit(url).alias("url"), F.lit(float(label)).alias("label")) for url, label in labelled])
    by_hand = spark.range(1).select(F.explode(table).alias("r")).select(F.lit(None).cast("long").alias("i"), "r.url", "r.label")
    rows = by_hand.unionByName(made_urls(spark, made))
    held = F.coalesce(F.col("i") % HELD == 0, F.lit(False)) | F.coalesce(F.col("i") % HELD == 1, F.lit(False))
    own = rows.select("label", held.alias("held"), buckets_of(*parts(F.col("url"))).cast("array<string>").alias("own"))
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "own", "features").setBinary(True).transform(own)
    model = LogisticRegression(maxIter=ROUNDS, regParam=PENALTY, standardization=False).fit(vectors.where("not held").select("label", "features"))
    weights, intercept = [float(x) for x in model.coefficients.toArray()], float(model.intercept)
    if not made:
        return weights, intercept
    known = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    logit = F.aggregate(F.col("own"), F.lit(intercept), lambda total, b: total + F.element_at(known, b.cast("int") + 1))
    allowed = own.where("held and label = 0").agg(F.percentile(logit, 1 - FALSE_BLOCKS).alias("edge")).first().edge
    return weights, intercept - max(0.0, allowed + 1e-9)


_trained: dict[str, tuple[list[float], float]] = {}


def trained(spark: SparkSession) -> tuple[list[float], float]:
    """The model, trained once an application: its labelled table is always the same."""
    key = spark.sparkContext.applicationId
    if key not in _trained:
        _trained[key] = train(spark)
    return _trained[key]


def rule_for(host, path, rules=RULES):
    """The rule that fits and is longest, as a struct of its text and verdict."""
    chain = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        if not rule_host:
            continue
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = chain.when(fits, found)
    return chain


def judge(pages: DataFrame, model: tuple[list[float], float], rules=RULES, id_column: str = "page_id") -> DataFrame:
    weights, intercept = model
    host, path = parts(F.col("url"))
    split = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # a constant: one weight per bucket, whatever the input
    logit = F.aggregate(buckets_of(F.col("host"), F.col("path")), F.lit(intercept), lambda total, b: total + F.element_at(table, b + 1))
    scored = split.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).withColumn("block_score", F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(0.0)).otherwise(1 / (1 + F.exp(-logit))))
    verdict = F.coalesce("found.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select(id_column, "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.round("block_score", 6).alias("block_score"))


def filter_urls(pages: DataFrame) -> DataFrame:
    return judge(pages, trained(pages.sparkSession))
