"""URL rules against a plain reading of them, and against SQL."""

import re

import pytest

from checks.compare import connect, difference, spark_result, sql_result
from specloom.llm import url_filter
from specloom.llm.queries import SQL, URL_RULES, op5_url_filters
from specloom.llm.url_filter import Rule, filter_urls

RULES = [
    *URL_RULES, Rule("ads.example.com/", "block"), Rule("/*track", "block"), Rule("shop.test/a*/b", "allow"),
    Rule("shop.test/a*/c.", "block"), Rule("org/fr/x", "block"), Rule("a-b.test/p+q/", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.net/x", "https://anet/x", "http://example.net/en/1",
    "http://www.example.net/EN/1", "http://example.net/en", "http://x.example.com/de/?q#f", "http://q.org/fr/x", "http://q.org/fr",
    "http://user@a.net:80/", "http://a.net:80/", "http://ads.example.com?x=/de/", "http://h.test/deep/track.gif", "ftp://h/trackless",
    "http://shop.test/a1/b", "http://shop.test/a1/c.d", "http://shop.test/a/x/b/c.", "http://a-b.test/p+q/", "http://a.b.test/p+q/",
    "a://b://c.net/", "http://ünet.net/é?", "http://a.net/line\nfeed", "http://" + "sub." * 3000 + "net/" + "p/" * 3000,
    "http://example.com/de/", "http://example.com/de/",
]


def judged(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"(?s)[^/?#]*", rest).group()
    path = re.match(r"(?s)[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule in RULES:
        where, _, prefix = rule.pattern.partition("/")
        pattern = ".*".join(map(re.escape, ("/" + prefix).split("*")))
        if (not where or host == where or host.endswith("." + where)) and re.match(f"(?s){pattern}", path):
            fits.append((-len(rule.pattern), rule.pattern, rule.verdict))
    _, pattern, verdict = min(fits, default=(0, None, "allow"))
    return host, path, pattern, verdict


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_longest_rule_that_fits(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    rows = [(i if i != 6 else None, u, "x", "y", 1) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, token string, rule int")
    found = sorted(map(tuple, filter_urls(pages, RULES).collect()), key=repr)
    assert found == sorted(((i, *judged(u)) for i, u, *_ in rows), key=repr)


def test_nothing_to_judge(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in filter_urls(pages, [], "block").collect()] == [(1, "a.net", "/", None, "block")]
    assert filter_urls(pages.limit(0), RULES).collect() == []


def test_rules_keep_only_tokens_with_both_ends_fixed():
    assert Rule("example.net/en/", "allow").tokens() == {"h:example", "h:net", "p:en"}
    assert Rule("org/fr/x", "block").tokens() == {"h:org", "p:fr"} and Rule("/*track", "block").tokens() == set()


def test_query_agrees_with_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = spark_result(op5_url_filters(spark, sf_dir))
    assert difference(found, sql_result(connect(sf_dir), SQL["op5_url_filters"])) is None
