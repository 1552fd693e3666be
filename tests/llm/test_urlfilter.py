import re

import pytest
from pyspark.sql import functions as F
from quillspark.llm import urlfilter
from quillspark.llm.queries import LISTED_URLS, URL_RULES, url_entries

URLS = [
    "http://a.example.org/es/1", "http://example.org/es", "https://EXAMPLE.org/en/123?x=1", "https://www.example.org/en/99",
    "http://x.com/fr/1", "http://com/de/7#t", "http://y.z.com/de/", "http://q.net/de/1", "http://notexample.org/es/2",
    "mailto:x", None, "", "http://", "http://org", "ftp://casino-win.example.net/en/1", "http://casino-win.example.com/fr/1",
    "http://a.b.c.d.e.f.org/x://y", "http://é.org/ß", "http://casino-win.example.com", "http://casino-win.example.com?x=1",
    "https://me@www.Casino-Win.example.com.:443#a", "http://casino-win.example.com:8080/", "http://example.org:80/es/1", "://", "http:///es/",
]


def named(host, rule):
    return host if rule else re.sub(r"\.$", "", re.sub(r":(80|443)?$", "", re.sub(r"^[^@]*@", "", host)))


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (rule, len(h + p), h + p, v)
        for rule, entries in ((True, URL_RULES), (False, [(*x, "block") for x in LISTED_URLS]))
        for h, p, v in entries
        if host and (named(host, rule) == h or named(host, rule).endswith("." + h)) and (path or ("" if rule else "/")).startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[2] if best and best[0] else None, best[3] if best else "allow"


@pytest.mark.parametrize("bound", [10, 0])
def test_verdicts(spark, monkeypatch, bound):
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", bound)
    pages = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in enumerate(URLS + URLS)], "page_id int, url string, host string, hit_url string, URL_verdict int")
    out = urlfilter.filter_urls(pages, url_entries(spark)).collect()
    assert len(out) == 2 * len(URLS) and out[0].__fields__ == ["page_id", "url", "host", "hit_url", "url_verdict"]
    for r in out:
        assert tuple(r.url_verdict) == expected(r.url), r.url
        assert (r.host, r.hit_url) == ("x", "y")


@pytest.mark.parametrize("blocks", [1_000_000, 100])
def test_bloom_has_no_false_negatives(spark, monkeypatch, blocks):
    monkeypatch.setattr(urlfilter, "FILTER_BLOCKS", blocks)
    keys = spark.range(5000).select(F.xxhash64("id").alias("key_hash"))
    bits, n = urlfilter.bloom_filter(keys, 5000)
    mask, word = urlfilter._mask(F.col("key_hash")), F.get("bits", urlfilter._block(F.col("key_hash"), n))
    probe = lambda df: df.crossJoin(bits).where(word.bitwiseAND(mask) == mask).count()
    assert probe(keys) == 5000
    assert blocks == 100 or probe(spark.range(10000, 60000).select(F.xxhash64("id").alias("key_hash"))) < 2500


def test_nulls_ties_and_a_very_long_url(spark):
    entries = spark.createDataFrame(
        [("A.org", "/x", "allow", True), ("a.org", "/x", "block", True), (None, "/", "block", True), ("b.org", None, "block", False), ("c.org", "/", None, False)],
        "host string, path string, verdict string, is_rule boolean",
    )
    urls = ["http://a.org/x" + "y" * 1_000_000, "http://b.org/", "http://c.org/", "http://" + "s." * 20_000 + "a.org/x", None]
    out = urlfilter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), entries).orderBy("page_id").collect()
    assert [r.url_verdict.verdict for r in out] == ["block", "allow", "allow", "block", "allow"]


def test_no_python_on_the_main_path(spark):
    pages = spark.range(1).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"))
    plan = urlfilter.filter_urls(pages, url_entries(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_empty(spark):
    entries = url_entries(spark)
    pages = spark.createDataFrame([], "page_id int, url string")
    assert urlfilter.filter_urls(pages, entries).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id int, url string")
    assert urlfilter.filter_urls(one, entries.limit(0)).first().url_verdict.verdict == "allow"
