"""URL rules against plain Python, and the trees on held-out URLs."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clicktrail.llm import urls
from clicktrail.llm.queries import URL_RULES
from tests.llm.conftest import CLASHING

ODD = [
    None,
    "",
    "no scheme.com/en/",
    "http://",
    "HTTP://WWW.EXAMPLE.COM/en/x",
    "http://a.example.com/en/",
    "http://a.example.com/EN/",
    "http://a.example.com",
    "http://x.net/es/1?a=b/c#d",
    "http://x.net?p=/es/",
    "http://x.net#/fr/",
    "http://notexample.com/en/1",
    "https://com/",
    "ftp://x://y.net/fr/",
    "http://ünï.example.org/ä?" + "q=1&" * 3000,
]


def plain(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    head = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = head.partition("/")
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def pages_of(spark, given):
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in urls.FEATURES})


def check(rows, pages):
    wanted = {r.page_id: plain(r.url) for r in pages.collect()}
    for r in rows:
        host, path, rule, verdict = wanted[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert len(rows) == pages.count()


def test_odd_rows(spark):
    pages = pages_of(spark, ODD + ODD[:5])
    check(urls.judge(pages, URL_RULES).collect(), pages)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    check(urls.judge(pages, URL_RULES).collect(), pages)


def test_nothing_to_learn_from(spark):
    pages = pages_of(spark, ["http://a.org/x", None])
    assert {r.verdict for r in urls.judge(pages, URL_RULES).collect()} == {"allow"}
    only = pages_of(spark, ["http://a.net/fr/x", "http://a.org/x"])
    assert {r.verdict for r in urls.judge(only, URL_RULES).collect()} == {"block"}
    assert urls.judge(pages_of(spark, ["x"]).limit(0), URL_RULES).collect() == []


@pytest.fixture(scope="module")
def labelled(spark):
    seen = urls.lexical(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url"))
    _, verdict = urls.rule_for(F.col("host"), F.col("path"), URL_RULES)
    return seen.withColumn("label", (verdict == "block").cast("int")).filter("label is not null")


def test_held_out_urls(labelled):
    test = F.col("page_id") % 4 == 0
    scored = urls.train(labelled.filter(~test)).score(labelled.filter(test))
    right, n = scored.agg(F.count_if((F.col("score") >= 0.5) == (F.col("label") == 1)), F.count("*")).first()
    assert right / n > 0.9


def test_features(spark):
    row = urls.lexical(pages_of(spark, ["https://a-1.example.com/p/q22.html?x=1&y=2#z"])).first()
    assert (row.depth, row.labels, row.params, row.query_length, row.has_fragment, row.secure, row.hyphens) == (2, 2, 2, 7, 1, 1, 1)
    assert (row.tld, row.domain, row.first_step, row.file_type) == ("com", "example.com", "p", "html")
    assert row.digit_ratio == pytest.approx(5 / row.length)
    assert urls.lexical(pages_of(spark, ["aabb"])).first().entropy == pytest.approx(1.0)


def test_entropy_is_that_of_the_characters_at_every_length(spark):
    def bits(text):
        return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0

    letters = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))
    given = ["", "a", "http://aB1.org/x?y=22", *(f"http://{'aBc1207' * n}.org/{'Qz-93' * n}" for n in (100, 400, 2000)), f"http://{letters}.org/{letters}"]
    for r in urls.lexical(pages_of(spark, given)).collect():
        assert r.entropy == pytest.approx(bits(r.url)) and r.host_entropy == pytest.approx(bits(r.host))
