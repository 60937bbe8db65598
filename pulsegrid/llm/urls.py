"""URL filter: host and path rules first, else a logistic regression on hashed character n-grams of host and path.

The regression is fitted by Spark on :data:`LABELLED`, a small table of labelled urls that are split like those of pages, and applied with SQL functions. The
threshold is set on urls of hosts that took no part in fitting. Few n-grams weigh little, so short urls stay near the prior, which allows.

Results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the regression on an
empty text, which the table names as allowed; a very long url is read whole; rows are judged one by one, so repeated rows and null ids need no treatment; a score equal to the threshold blocks; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Interaction
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import literal_array

# Verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

BUCKETS = 1024
GRAMS = (3, 4)
REGULAR = 0.002
#: A url of fewer n-grams weighs as if it had so many, so that little evidence stays little.
LEAST_GRAMS = 24
#: The score from which a url is blocked: of the labelled urls that took no part in fitting (:func:`held_out_scores`), at most :data:`FALSE_BLOCKS` of the ordinary ones reach it.
THRESHOLD, FALSE_BLOCKS = 0.6, 0.015
#: Labelled urls: "block" for spam, scams, gambling and adult pages. Made up for this table; no url of a corpus is among them.
LABELLED = """
block https://www.luckyspin-casino.bet/slots/free-spins
block http://royal-poker-room.com/holdem/bonus
block https://online-roulette24.net/play/real-money
block http://megabet-sports.io/odds/football/live
block https://jackpot-city-slots.co/welcome-bonus?aff=991
block http://betting-tips-daily.info/sure-win-picks
block https://vegas-blackjack.club/deposit/bonus-code
block http://bingo-cash-prizes.biz/join-now
block https://1xwin-promo.xyz/register/free-bet
block http://hotxxxvideos.tube/watch/8812.html
block https://www.freesexcams.live/rooms/blonde
block http://adult-webcam-chat.net/girls/online
block https://nude-teens-gallery.xxx/pics/22
block http://pornstar-clips.club/hd/free
block https://escort-service-city.com/girls/vip
block http://milf-dating-tonight.com/signup
block https://hookup-local-singles.net/join/free
block http://erotic-massage-girls.biz/book
block https://camgirls-naked.io/private-show
block http://buy-viagra-online-cheap.com/order/50mg
block https://canadian-pharmacy-pills.net/cialis/generic
block http://no-prescription-meds.biz/buy/xanax
block https://cheap-tramadol-online.info/checkout
block http://weight-loss-miracle-pills.com/order-now
block https://male-enhancement-secret.net/free-trial
block http://steroids-shop24.com/buy/testosterone
block https://keto-burn-fat-fast.xyz/special-offer
block http://cheap-replica-rolex.store/sale/submariner
block https://fake-designer-bags.net/louis-vuitton/cheap
block http://replica-watches-outlet.biz/discount/80
block https://nike-shoes-outlet-cheap.shop/sale?off=90
block http://get-rich-quick-system.com/secret-method
block https://earn-money-from-home-fast.net/signup/now
block http://double-your-bitcoin.cc/invest
block https://crypto-giveaway-elon.live/claim
block http://forex-robot-profits.biz/buy
block https://binary-options-millionaire.com/deposit
block http://free-iphone-winner.info/claim-prize
block https://you-won-gift-card.xyz/claim/1000
block http://lottery-winner-notice.com/prize/claim.php
block https://free-robux-generator.club/verify
block http://payday-loans-instant-cash.com/apply
block https://bad-credit-loan-approved.net/fast-cash
block http://secure-paypa1-login.com/verify/account
block https://appleid-verify-account.info/signin/update
block http://bank-security-alert.xyz/confirm/password
block https://netflix-billing-update.cc/login.php
block http://account-suspended-verify.top/ebay/signin
block https://webmail-quota-upgrade.tk/login
block http://download-crack-keygen.net/photoshop/serial
block https://warez-full-version.org/torrent/windows-activator
block http://free-mp3-torrents.biz/download.exe
block https://game-hacks-cheats.club/aimbot/free-download
block http://driver-updater-free.info/setup.exe
block https://your-pc-infected-call.xyz/alert.html
block http://cheap-backlinks-seo.net/buy/10000-links
block https://buy-instagram-followers.co/cheap/5000
block http://traffic-bot-clicks.biz/buy-traffic
block https://article-spinner-links.info/directory/submit
block http://guest-post-links-cheap.com/order
block https://essay-writing-cheap.biz/buy-essay
block http://buy-fake-diploma.net/order/degree
block https://psychic-love-spells.info/order/spell
block http://miracle-cure-cancer.biz/secret-remedy
block https://hot-russian-brides.com/join/free
block http://free-proxy-unblock-porn.net/list
block https://spam-mailer-lists.com/buy/emails
block http://win-big-slots.top/spin?ref=77
block https://click-here-prize.club/winner/today
block http://xxx-adult-toys-cheap.store/sale
block https://mega-discount-pharmacy.top/viagra/offer
block http://sexy-singles-near-you.info/chat
block https://casino-no-deposit-bonus.xyz/free/50-spins
block http://instant-loan-no-check.top/apply/now
block https://hack-facebook-password.net/free-tool
block http://cheap-cigarettes-online.biz/order
allow https://www.city-library.org/catalogue/new-books
allow https://news.morningherald.com/2023/05/local-election-results
allow http://www.stmarys-school.edu/admissions/dates.html
allow https://physics.northuniversity.edu/research/papers/quantum-optics.pdf
allow https://docs.openparser.dev/guide/getting-started
allow https://wiki.gardeners.org/wiki/Tomato_blight
allow http://blog.annasbakery.com/sourdough-for-beginners
allow https://www.railwaymuseum.org.uk/visit/opening-times
allow https://github-mirror.dev/project/issues/142
allow https://www.health.gov/conditions/asthma/treatment
allow https://weather.coastguard.gov/forecast/shipping
allow http://forum.cyclists.net/thread/winter-tyres
allow https://journal.ecology.org/article/10/forest-soils
allow https://www.parliament.gov/bills/2021/water-act
allow https://recipes.familykitchen.com/lentil-soup
allow http://www.villagechoir.org/concerts/spring
allow https://support.printerworks.com/manuals/model-210
allow https://www.hospital-trust.org/departments/cardiology
allow https://archive.history.edu/letters/1862/index.html
allow https://www.theatre-royal.co.uk/programme/hamlet
allow https://store.bookhouse.com/authors/jane-austen
allow http://www.chess-club.org/rules/openings
allow https://maps.hikingtrails.org/route/lake-circuit
allow https://www.nationalpark.gov/wildlife/birds
allow https://stats.census.gov/tables/population/2020
allow https://developer.webplatform.org/docs/css/grid
allow https://www.opera-house.org/season/tickets
allow http://students.college.edu/timetable/autumn
allow https://www.farmersmarket.org/vendors/vegetables
allow https://astronomy.observatory.edu/gallery/nebula.html
allow https://travel.islandguide.com/beaches/north-coast
allow https://www.kidsmuseum.org/education/workshops
allow https://www.legal-aid.org/advice/housing
allow http://poetry.magazine.org/poems/winter-evening
allow https://www.biology-online.edu/cells/mitosis
allow https://podcast.sciencehour.com/episodes/ocean-currents
allow https://www.localbank.com/branches/contact
allow https://www.airline-timetable.com/flights/status
allow https://www.musicschool.org/lessons/violin
allow https://charity.cleanwater.org/projects/wells
allow https://www.fishing-harbour.org/tides/june
allow http://www.parish-council.gov/minutes/2019-04
allow https://papers.linguistics.edu/abstracts/vowel-shift
allow https://www.furniture-makers.com/oak-tables
allow https://blog.datasystems.dev/posts/hash-joins
allow https://www.dentist-practice.com/opening-hours
allow https://www.botanical-garden.org/collections/orchids
allow https://www.sportscentre.org/swimming/lessons
allow https://reference.chemistry.edu/elements/iron
allow https://www.trainjourney.com/routes/alps
allow https://community.openmaps.org/diary/entry/44
allow http://www.woodworkers.net/articles/dovetail-joints
allow https://www.youth-orchestra.org/auditions
allow https://news.technologyreview.net/robots/factory
allow https://www.water-utility.com/billing/help
allow https://www.film-archive.org/silent-era/comedies
allow https://economics.institute.edu/working-papers/trade
allow https://www.veterinary-clinic.com/pets/vaccination
allow https://www.language-school.com/courses/spanish
allow https://cooking.dailypaper.com/recipes/apple-pie
allow https://www.fireservice.gov/safety/smoke-alarms
allow https://www.bicycle-repair.org/guides/brakes
allow https://www.artgallery.org/exhibitions/impressionists
allow https://www.mathforum.edu/problems/geometry/17
allow https://philosophy.university.edu/entries/kant
allow https://www.coffee-roasters.com/beans/ethiopia
allow https://www.knitting-patterns.org/scarves/cable
allow https://www.mountain-rescue.org/advice/avalanche
allow https://www.electricians-union.org/members/news
allow https://www.baby-names.org/origins/latin
allow https://code.compilers.dev/tutorial/lexer
allow https://www.museum-of-trams.org/collection
allow https://www.planetary-society.org/missions/mars
allow https://www.seedbank.org/varieties/barley
allow https://www.court-records.gov/forms/appeal.pdf
allow https://www.hotel-riverside.com/rooms/prices
""".strip().splitlines()

#: Ordinary hosts and paths, and hosts and paths of the blocked kinds: each host stands with some of the paths.
HOSTS = """
news.dailycourier.co.uk sport.eveningpost.com www.weatherwatch.org en.openencyclopedia.org de.openencyclopedia.org code.forgehub.com gist.forgehub.com www.questionboard.com www.videohouse.com
www.linuxweekly.net packages.distro.org docs.frameworks.io api.maptiles.org www.europa-council.eu www.ministry.gov.uk www.stadt-freiburg.de www.mairie-lyon.fr www.ayuntamiento.es
www.lemonde-local.fr www.tageszeitung.de www.elperiodico-digital.es shop.stationery.com www.supermarket.co.uk www.carparts.de www.bikeshop.nl www.gardenstore.com www.bankofcommerce.com
www.insurance-group.com www.telecom-help.com mail.postoffice.net www.parcel-tracking.com www.jobs-board.org www.real-estate-listings.com www.hotel-booking.com www.airport-info.com
www.metro-transit.org www.university-press.edu cs.westcollege.edu www.high-school.edu www.medical-journal.org www.patient-info.org www.pharmacy-council.gov www.charity-run.org
www.football-league.com www.tennis-results.com www.chessboard.org www.board-games.com www.movie-reviews.com www.album-reviews.net www.radio-public.org www.photo-club.org
blog.travelnotes.com blog.smallkitchen.net blog.parenting.org m.forumtalk.net wiki.strategy-games.org www.genealogy.org www.astronomers.org www.climate-data.org data.statistics.gov
www.lawfirm-partners.com www.architects.org www.plumbers-guild.co.uk www.wine-merchant.com www.cheese-makers.fr www.beer-brewing.org www.dating-history-museum.org www.casino-royale-film-review.com
www.sexual-health-clinic.org www.drug-safety.gov www.loan-calculator.edu www.lottery-commission.gov www.poker-rules-museum.org status.cloudhost.com cdn.webfonts.net static.images.org
blog.tonder.example.com www.thalen.example.org m.anster.example.net erith.example.com therlan.example.org www.shandor.example.com m.oristan.example.com blog.wherand.example.net ingthe.example.com
enthal.example.org www.ediron.example.net m.hathin.example.org blog.reran.example.com onthed.example.com www.thinger.example.org tiander.example.net m.thatho.example.com isthen.example.com
""".split()
PATHS = """
/ /index.html /about /contact /news /news/2021/11/03/budget /news/world /sport/football /sport/results /wiki/Main_Page /wiki/History_of_glass /de/853/ /en/323.html /fr/584 /es/751 /en/12/
/blog/2020/05/first-steps /blog/archive /articles/1482 /article/how-bridges-are-built /questions/48213/sort-a-list /org/repo /org/repo/issues/12 /project/tree/main/src /docs/latest/install
/docs/api/reference /download/latest /downloads/manual.pdf /files/report-2019.pdf /images/logo.png /products/chairs /products/12345 /category/books /cart /account /login /search /help /faq
/privacy /terms /events/2022 /calendar /team /careers /press /research/publications /courses/autumn /library/catalogue /recipes/bread /travel/italy /music/reviews /film/1964 /science/biology
/health/vaccines /weather/today /maps/region /timetable /tickets /prices /reviews/cameras /forum/thread/881 /user/profile /tags/history /2018/07/ /a/b/c /x
""".split()
BAD_HOSTS = """
ads-track.clicks.com free-bets.promo.com www.casino-bonus.net slots.winbig.org poker.cash-games.com best-viagra.pills.com xxx.hotvideos.com adult.livecams.net porn.tubehd.org
www.free-casino-spins.com sexchat.girls.com cheap-pills.rx.net www.bet-now.club bonus.jackpots.io win-prizes.lucky.com click-ads.popunder.net track.adserver.biz banner-ads.network.com
spam-links.seo.biz buy-followers.social.com payday-cash.loans.com crypto-double.invest.top phishing-login.bank.tk verify-paypal.account.cc warez.cracks.ru keygen.serials.net torrents.free-movies.to
escorts.cityguide.xxx nude-pics.gallery.com hot-dates.tonight.com milf.cams.club replica-bags.outlet.store fake-watches.sale.shop diploma.buyfast.biz weight-loss.miracle.info forex-signals.rich.com
ads-banner.example.net casino-slots.example.org cheap-loans.example.com adult-cams.example.com best-bets.example.org win-cash.example.net track-clicks.example.com pills-store.example.org
www.casino-night.example.com m.ads-server.example.com free-spins.example.net sex-dates.example.org bets-live.example.com click-track.example.net free-xxx.example.com ads-pop.example.org
""".split()
BAD_PATHS = """
/ /free-bonus /join/now /spin/win /click?id= /deposit /buy/cheap /live/girls /watch/xxx /order/pills /promo/casino /claim/prize /verify/login /crack/download /en/323.html /de/853/ /ads/banner /sale/90-off
""".split()
#: A url without host or path says nothing: allowed, by rows of their own.
LABELLED += ["allow nourl"] * 4 + [f"allow http://{x}" for x in ("intranet", "localhost/", "a.b", "net", "example.com", "x.org/1")]
LABELLED += [f"allow https://{h}{PATHS[(5 * i + 23 * j) % len(PATHS)]}" for i, h in enumerate(HOSTS) for j in range(4)]
LABELLED += [f"block http://{h}{BAD_PATHS[(5 * i + 7 * j) % len(BAD_PATHS)]}" for i, h in enumerate(BAD_HOSTS) for j in range(4)]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of host and path, with marks at both ends of the host."""
    text = F.concat(F.lit("^"), host, F.lit("$"), path)

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(size))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*(of(size) for size in GRAMS))


def labelled(spark: SparkSession, rows: Sequence[str]) -> DataFrame:
    """``label`` (1: block), ``host`` and ``path`` of labelled urls, split as the urls of pages are."""
    table = F.array(*(F.struct(F.lit(float(r.split()[0] == "block")).alias("label"), F.lit(r.split()[1]).alias("url")) for r in rows))
    return spark.range(1).select(F.inline(table)).select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def _weight() -> Column:
    return F.greatest(F.size("g"), F.lit(LEAST_GRAMS))


@functools.lru_cache(16)
def fit(spark: SparkSession, rows: tuple[str, ...] = tuple(LABELLED)) -> tuple[tuple[float, ...], float]:
    """Weights and intercept; the labelled table has a fixed number of rows."""
    tokens = labelled(spark, rows).withColumn("g", grams(F.col("host"), F.col("path"))).select("label", (F.lit(10.0) / _weight()).alias("scale"), F.col("g").cast("array<string>").alias("g"))
    counts = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "g", "counts").transform(tokens)
    counted = Interaction(inputCols=["scale", "counts"], outputCol="features").transform(counts).select("label", "features")
    model = LogisticRegression(regParam=REGULAR, maxIter=60).fit(counted)
    return tuple(float(w) for w in model.coefficients), float(model.intercept)


def score(weights: Sequence[float], intercept: float) -> Column:
    """The chance that a page with grams ``g`` is to be blocked."""
    table = literal_array(weights, "double")
    return F.lit(1.0) / (1 + F.exp(-(F.aggregate("g", F.lit(0.0), lambda a, g: a + F.element_at(table, g + 1)) / _weight() * 10 + intercept)))


def held_out_scores(spark: SparkSession, folds: int = 5) -> list[tuple[int, float]]:
    """Label and score of every labelled url by a model that has not seen its host, over all folds of hosts."""
    hosts = sorted({r["host"] for r in labelled(spark, LABELLED).select("host").distinct().collect()})  # rows of the labelled table
    fold = {h: i * 7919 % folds for i, h in enumerate(hosts)}
    of = [fold[r["host"]] for r in labelled(spark, LABELLED).collect()]
    said = []
    for k in range(folds):
        model = fit(spark, tuple(r for r, f in zip(LABELLED, of, strict=True) if f != k))
        rest = labelled(spark, [r for r, f in zip(LABELLED, of, strict=True) if f == k]).withColumn("g", grams(F.col("host"), F.col("path")))
        said += [(int(r["label"]), r["p"]) for r in rest.select("label", score(*model).alias("p")).collect()]
    return said


def chosen_threshold(scores: Sequence[tuple[int, float]], false_blocks: float = FALSE_BLOCKS) -> float:
    """The least score, in hundredths, that no more than this part of the ordinary urls reaches."""
    ordinary = [p for y, p in scores if not y]
    return next(t / 100 for t in range(1, 101) if sum(p >= t / 100 for p in ordinary) <= false_blocks * len(ordinary))


def held_out_quality(spark: SparkSession, folds: int = 5, threshold: float = THRESHOLD) -> tuple[float, float]:
    """Precision and recall of blocking labelled urls whose host took no part in fitting, over all folds."""
    said = [(y, p >= threshold) for y, p in held_out_scores(spark, folds)]
    right = sum(y == 1 and p for y, p in said)
    return right / max(1, sum(p for _, p in said)), right / max(1, sum(y == 1 for y, _ in said))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Verdict and text of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the regression's ``score`` for blocking."""
    chance = score(*fit(pages.sparkSession))
    split = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    scored = split.withColumn("g", grams(F.col("host"), F.col("path"))).select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("r"), chance.alias("score"))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", learned).alias("verdict"), "score")
