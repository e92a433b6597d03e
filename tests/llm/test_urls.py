import random
import re

from cleanlake.llm.url_filter import RULES, judge_urls, op1_url_filter

URLS = [
    None, "", "no scheme example.com/en/", "http://example.com", "http://example.com/", "HTTPS://EXAMPLE.com/en/x",
    "http://www.Example.com/en/a/b?x=/es/#y", "http://xexample.com/en/", "http://a.b.example.com/en/", "ftp://net/es/",
    "http://example.net/es", "http://example.net/es/", "http://example.org/en/", "http://com/", "http://example.com?/en/",
    "http://example.com#/en/", "http://example.com/EN/", "http://example.com//en/", "x://y://example.com/en/",
    "http://example.com/en/" + "a/" * 3000, "http://" + "a." * 2000 + "com/en/", "http://.com/", "http://com./",
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [
        (len(h) + len(p), len(h), v, h + p)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def check(spark, rules):
    rows = [(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, short string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = judge_urls(pages, frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, rules), r.url[:80]


def test_rules_of_the_query(spark):
    check(spark, list(RULES))


def test_any_rules(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "net", "example.net", "b.example.com"]
    paths = ["/", "/e", "/en", "/en/", "/en/a", "/en/a/", "/es/", "/en/a/a/a/a"]
    for _ in range(3):
        rules = {(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(8)}
        check(spark, [(h, p, v) for (h, p), v in rules.items()])


def test_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert judge_urls(pages, rules).count() == 0
    pages = spark.createDataFrame([(1, "http://example.com/en/")], "page_id long, url string")
    row = judge_urls(pages, rules.limit(0), default="block").first()
    assert (row.rule, row.verdict) == (None, "block")


def test_whole_table(spark):
    rows = op1_url_filter(spark, "/root/testdata/sf0.001").collect()
    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id], RULES)
