import math

import pytest
import xxhash
from pyspark.sql import functions as F
from tallyforge.llm import urls

URLS = [
    "http://Sub.Example.ORG/en/17?x#y", "https://example.org/es/", "https://notexample.com/fr/", "http://a.example.com/fr/1", "http://b.com/de/x", "ftp://org/", "http://org", "no scheme", "", None,
    "http://x.org?q=/es/", "https://host.net/a#b://c", "HTTP://ÄB.Net/Ä", "://h/p", "http://example.org/en/1", "http://spam-farm.biz/en/9", "http://" + "a" * 5000 + "/" + "b" * 5000,
]


def brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = path = ""
    for i, c in enumerate(rest):
        if c in "/?#":
            host, tail = rest[:i], rest[i:]
            path = tail.split("?")[0].split("#")[0]
            break
    else:
        host = rest
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], "x", 1)], "page_id long, url string, host string, label int")
    return urls.judge(pages).collect()


def test_parts_and_rules(judged):
    assert len(judged) == len(URLS) + 1
    for r in judged:
        host, path, best = brute(URLS[r["page_id"] or 0])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1] if best else None)
        assert r["verdict"] == (best[0] if best else "block" if r["log_odds"] > 0 else "allow")


def test_scores_are_those_of_the_trained_weights(spark, judged):
    w = urls.train(urls.labelled_urls(spark))
    assert len(w) == urls.BUCKETS + 1

    def gram(mark, text):
        spark_hash = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(mark.encode(), 42))
        return (spark_hash - 2**64 if spark_hash >= 2**63 else spark_hash) % urls.BUCKETS

    for r in judged:
        found = [gram(m, t[i : i + n]) for m, t in (("h", f"^{r['host']}$"), ("p", f"^{r['path']}$")) for n in urls.NGRAMS for i in range(len(t) - n + 1)]
        assert r["log_odds"] == pytest.approx(w[-1] + sum(w[i] for i in found) / math.sqrt(max(1, len(found))), abs=1e-5)


def test_held_out_accuracy(spark):
    labelled = urls.labelled_urls(spark).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(4))).withColumn("page_id", F.monotonically_increasing_id())
    right = total = 0
    for fold in range(4):
        test = labelled.filter(F.col("fold") == fold)
        found = urls.judge(test.select("page_id", "url"), labelled.filter(F.col("fold") != fold).select("url", "label"), ()).join(test, "page_id").collect()
        right += sum((r["log_odds"] > 0) == bool(r["label"]) for r in found)
        total += len(found)
    assert total == len(urls.WANTED) + len(urls.UNWANTED) and right / total >= 0.7


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
