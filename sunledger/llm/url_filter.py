"""URL verdicts by host and path rules, else by logistic regression on hashed character n-grams.

Everything runs in SQL functions. The model is fitted on a small table of labelled URLs, given below; its
coefficients, one for each hash bucket, become an array literal of the scoring expression.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger.storage import materialize

#: Above the number of distinct n-grams of the labelled table, so that few of them share a bucket.
BUCKETS = 8192
GRAMS = (3, 4)
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path); a rule fits its host and all subdomains if the path starts with its path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

#: The labelled table: (host, path, 1 for block). Kinds of sites that a text corpus leaves out (medicine and goods by
#: mass mail, betting, adult pages, loans, advertising, link farms, malware, pirated copies) and ordinary ones. Hosts and
#: paths are made up by kind; none is taken from a given table. Numbered paths stand on both sides alike: they say nothing.
LABELLED = [
    ("buy-pills-online.example", "/order", 1), ("m.pills-shop.example", "/en/7.html", 1), ("discount-pharmacy.example", "/viagra", 1),
    ("cheap-viagra.example", "/", 1), ("no-prescription-meds.example", "/fr/731", 1), ("diet-pills-sale.example", "/de/617", 1),
    ("best-bets.example", "/odds", 1), ("sports-bets-live.example", "/es/352", 1), ("casino-bonus.example", "/slots", 1),
    ("online-casino.example", "/en/poker", 1), ("www.jackpot-slots.example", "/win", 1), ("poker-free.example", "/bonus", 1),
    ("bet-win-cash.example", "/en/641", 1), ("adult-video.example", "/xxx", 1), ("adult-dating-hot.example", "/de/14", 1),
    ("xxx-cams.example", "/live", 1), ("hot-sex-cams.example", "/adult", 1), ("porn-x.example", "/videos", 1),
    ("www.sexy-girls-xxx.example", "/en/854", 1), ("cheap-loans.example", "/apply", 1), ("quick-loan-cash.example", "/en/8", 1),
    ("payday-credit-now.example", "/fr/52", 1), ("win-free-prize.example", "/claim", 1), ("free-gift-card.example", "/es/226", 1),
    ("click-bait-ads.example", "/ads/track", 1), ("ad-server-track.example", "/pixel", 1), ("banner-ads.example", "/de/44", 1),
    ("popup-ads-tracker.example", "/click", 1), ("seo-backlinks.example", "/buy", 1), ("link-farm-seo.example", "/en/319/", 1),
    ("spam-links.example", "/fr/3/", 1), ("mail-spam-list.example", "/es/33", 1), ("buy-traffic-cheap.example", "/en/472", 1),
    ("warez-crack.example", "/keygen", 1), ("torrent-free.example", "/download", 1), ("serial-keygen.example", "/de/3", 1),
    ("malware-download.example", "/exe", 1), ("replica-watches.example", "/shop", 1), ("cheap-replica.example", "/bags", 1),
    ("fake-designer-sale.example", "/fr/2.html", 1), ("miracle-weight-loss.example", "/order", 1), ("crypto-doubler-win.example", "/invest", 1),
    ("news.daily.example", "/fr/3/", 0), ("blog.garden.example", "/en/7.html", 0), ("m.recipes.example", "/de/44", 0),
    ("library.example", "/es/9", 0), ("www.museum.example", "/en/5/", 0), ("university.example", "/research", 0),
    ("docs.software.example", "/guide", 0), ("history.example", "/en/1", 0), ("www.science.example", "/fr/2.html", 0),
    ("m.travel.example", "/de/3", 0), ("school.example", "/courses", 0), ("music.example", "/concerts", 0),
    ("forum.bicycle.example", "/topic", 0), ("wiki.birds.example", "/page", 0), ("hospital.example", "/health", 0),
    ("parliament.example", "/laws", 0), ("blog.kitchen.example", "/en/78", 0), ("radio.example", "/archive", 0),
    ("mathematics.example", "/theorem", 0), ("www.city.example", "/council", 0), ("books.example", "/novel", 0),
    ("www.harbour.example", "/es/352", 0), ("mountain.example", "/en/641", 0), ("m.painter.example", "/de/617", 0),
    ("www.village.example", "/fr/731", 0), ("blog.chemist.example", "/en/319/", 0), ("theatre.example", "/es/226", 0),
    ("orchestra.example", "/en/854", 0), ("blog.teacher.example", "/en/472", 0), ("observatory.example", "/stars", 0),
    ("www.farmers.example", "/market", 0), ("railway.example", "/timetable", 0), ("open-data.example", "/tables", 0),
    ("old-town-history.example", "/fr/52", 0), ("www.river-walks.example", "/de/14", 0), ("local-news.example", "/en/90", 0),
    ("m.language-school.example", "/es/33", 0), ("community-choir.example", "/en/27", 0), ("bakery.example", "/bread", 0),
    ("archaeology.example", "/digs", 0), ("www.gardeners.example", "/en/12", 0), ("insects.example", "/fr/8", 0),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``,
    ``#`` or the end. Both are empty for null or without ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text (host and path joined) and its verdict; null if none fits. Of rules of one
    length, the first of the list wins. The list is part of the program, so its size is bounded."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    name = F.coalesce(*(F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ordered)), F.lit(None).cast("string"))
    verdict = F.coalesce(*(F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ordered)), F.lit(None).cast("string"))
    return name, verdict


def gram_buckets(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets (0..buckets-1) of the character n-grams of host and path, each distinct n-gram once."""

    def grams(text: Column, n: int) -> Column:
        last = F.greatest(F.length(text) - (n - 1), F.lit(0))
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>")
        )

    framed = [F.concat(F.lit("<"), host, F.lit(">")), F.concat(F.lit("|"), path, F.lit("|"))]
    found = F.array_distinct(F.concat(*(grams(text, n) for text in framed for n in GRAMS)))
    return F.transform(found, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int"))


def fit(spark: SparkSession, labelled=LABELLED, buckets: int = BUCKETS) -> tuple[float, list[float]]:
    """Intercept and one coefficient per bucket, from labelled (host, path, 0/1) rows. The table is small by
    contract: it is laid out densely."""
    rows = spark.createDataFrame(labelled, "host string, path string, label int").coalesce(1)
    # Stored, or the n-grams would be found anew for every bucket.
    rows = materialize(rows.select(gram_buckets(F.col("host"), F.col("path"), buckets).alias("found"), "label"), "url-grams")
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.array_contains("found", b.cast("int")).cast("int").cast("double"))
    data = rows.select(array_to_vector(dense).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(regParam=0.02, standardization=False, maxIter=60).fit(data)
    return float(model.intercept), [float(w) for w in model.coefficients]


def score(host: Column, path: Column, intercept: float, weights: list[float]) -> Column:
    """Probability of ``block``. An empty URL has only the frame's n-grams."""
    # One literal, folded once; a literal for each weight makes planning slow.
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(gram_buckets(host, path, len(weights)), F.lit(float(intercept)), lambda held, b: held + F.element_at(table, b + 1))
    return 1 / (1 + F.exp(-total))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row. Null urls have empty host and path and are judged by the
    method; repeated rows are judged alike; other columns are left out."""
    intercept, weights = fit(pages.sparkSession, labelled)
    parts = host_and_path(F.col("url"))
    cut = pages.select("page_id", "url").select("page_id", parts[0].alias("host"), parts[1].alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    scored = cut.select(
        "page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), score(F.col("host"), F.col("path"), intercept, weights).alias("score")
    )
    method = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
