"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained here from a small labelled URL table (``LABELLED``, or one of at most ``MAX_LABELLED`` rows): plain
gradient descent over all rows at once, as one expression over one row. Scoring adds up weights in the row. There is no
Python on the executors.

Defined cases: a null url, or one without ``://``, has empty host and path, and the model scores the empty string; an
empty path fits no rule; of rules of one length the first listed wins; repeated rows are judged alike; columns beyond
page_id and url are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule); a rule is a host and what the path starts with.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

BUCKETS, NGRAMS, EPOCHS, RATE, DECAY, MAX_LABELLED = 512, (3, 4), 80, 2.0, 0.002, 2000

# A small labelled URL table; 1 is to be blocked.
WANTED = (
    "https://www.city-library.net/catalogue/en/1204", "https://news.harbour-times.com/en/politics/2291.html", "https://docs.widgets.dev/guide/start",
    "http://blog.gardening-notes.net/es/tomates", "https://university.edu/courses/physics/lecture-3", "https://museum.example.net/fr/expositions/77",
    "https://m.weather-today.com/de/berlin", "http://www.recipes-daily.com/en/soup/31", "https://wiki.open-maps.net/en/bridges",
    "https://journal.medicine-review.com/articles/2201.html", "http://school.example.com/en/timetable/8", "https://www.rail-travel.net/fr/horaires/12",
    "https://blog.kitchen-tales.com/en/bread/4", "https://archive.history-society.net/en/letters/991", "https://m.local-paper.example.net/de/sport/55",
    "http://forum.woodwork.net/en/thread/3310", "https://www.birdwatch.example.com/es/aves/9", "https://science.example.net/en/stars/412",
    "https://www.theatre-guide.com/fr/pieces/61", "https://code.example.dev/docs/reference", "https://www.chess-club.net/en/games/88",
    "http://www.mountain-walks.com/de/touren/14", "https://books.example.com/en/reviews/205", "https://www.public-health.net/en/advice/16",
)
UNWANTED = (
    "http://spam-links.biz/en/1", "https://www.link-farm.example.net/en/27", "http://cheap-pills.shop/buy/now", "https://casino-bonus.win/free/spins",
    "http://free-money.click/en/offer?id=3", "https://adult-cams.xxx/live/1", "http://www.spam-network.com/de/404", "https://farm-of-links.net/es/82",
    "http://bet-big.casino/en/slots/9", "https://win-prizes.click/claim", "http://pills-online.shop/en/viagra", "https://www.spamfarm.net/fr/18",
    "http://seo-spam.biz/en/backlinks/7", "https://hot-deals.click/en/offer/55", "http://porn-tube.xxx/watch/12", "https://poker-bonus.casino/en/join",
    "http://download-crack.biz/en/keygen/4", "https://www.get-rich.win/en/fast/2", "http://farm-spam.net/en/3001", "https://loan-offer.click/en/cash/6",
    "http://spam-blog.example.com/en/22", "https://slots-free.casino/es/91", "http://replica-watches.shop/en/cheap/5", "https://www.farm-links.biz/de/17",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(u).alias("url"), F.lit(label).alias("label")) for label, urls in enumerate((WANTED, UNWANTED)) for u in urls]
    return spark.range(1).select(F.inline(F.array(*rows)))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1))


def bucket_of(text: Column, n: int, mark: str) -> Callable[[Column], Column]:
    return lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int")


def features() -> Column:
    """Bucket numbers of the n-grams of host and path, each marked with where it comes from."""
    parts = []
    for name, mark in (("host", "h"), ("path", "p")):
        text = F.concat(F.lit("^"), F.col(name), F.lit("$"))
        for n in NGRAMS:
            count = F.length(text) - (n - 1)
            grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), bucket_of(text, n, mark))
            parts.append(F.when(count >= 1, grams).otherwise(F.array().cast("array<int>")))
    return F.concat(*parts)


def length_of(found: Column) -> Column:
    return F.sqrt(F.greatest(F.size(found), F.lit(1)))


def score(weights: Column, found: Column) -> Column:
    """The log-odds: a bias (the last weight) and the n-grams' weights over the root of their number."""
    total = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.get(weights, i))
    return F.get(weights, F.lit(BUCKETS)) + total / length_of(found)


def train(labelled: DataFrame) -> list[float]:
    """BUCKETS weights and a bias. The labelled table (url, label) is small by contract: at most MAX_LABELLED rows are used."""
    rows = with_parts(labelled.filter("label is not null").orderBy(F.xxhash64("url")).limit(MAX_LABELLED))
    examples = rows.select(F.struct(F.col("label").cast("double").alias("y"), features().alias("f")).alias("e"))
    # Counts per bucket once, so that a step needs no search; examples in a defined order, so that sums are the same.
    one = examples.agg(F.array_sort(F.collect_list("e")).alias("es"))
    dense = lambda e: F.struct(
        e["y"].alias("y"), e["f"].alias("f"),
        F.transform(F.sequence(F.lit(0), F.lit(BUCKETS)), lambda b: F.when(b == BUCKETS, 1.0).otherwise(F.size(F.filter(e["f"], lambda i: i == b)) / length_of(e["f"]))).alias("x"),
    )
    one = one.select(F.transform("es", dense).alias("es"))

    def step(w: Column, _: Column) -> Column:
        errors = F.transform("es", lambda e: F.struct((F.lit(1.0) / (F.lit(1.0) + F.exp(-score(w, e["f"]))) - e["y"]).alias("d"), e["x"].alias("x")))
        # The array of one element binds the errors, which are then computed once a step.
        moved = F.transform(F.array(errors), lambda es: F.transform(w, lambda v, j: v * (1 - RATE * DECAY) - F.lit(RATE) * F.aggregate(es, F.lit(0.0), lambda a, e: a + e["d"] * F.get(e["x"], j)) / F.greatest(F.size(es), F.lit(1))))
        return F.get(moved, F.lit(0))

    start = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    return list(one.select(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), start, step)).first()[0])


def fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(slash + path))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's log-odds of every row."""
    weights = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    longest = sorted(rules, key=lambda r: -len(r[1]))
    rule = reduce(lambda a, r: F.when(fits(r[1]), F.lit(r[1])).otherwise(a), reversed(longest), F.lit(None).cast("string"))
    verdict = reduce(lambda a, r: F.when(F.col("rule") == r[1], F.lit(r[0])).otherwise(a), longest, F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow")))
    scored = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("f", features())
    scored = scored.withColumn("log_odds", score(F.lit(weights), F.col("f"))).withColumn("rule", rule)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("log_odds", 6).alias("log_odds"))
