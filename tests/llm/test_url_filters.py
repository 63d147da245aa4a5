import re

from corvine.llm.url_filters import HOST_RULES, PATTERNS, judge_urls

URLS = [
    None, "", "no scheme example.net/en/", "http://example.net", "http://example.net/", "HTTP://A.Example.NET/en/x", "http://a.example.net/EN/x", "https://example.com/de/1?x",
    "https://badexample.com/de/1", "https://x.org/fr/", "https://org/fr/?a", "https://www.net?x/en/", "http://a.b/c://d.net/en/", "://x.net/a", "http://u@x.net:80/", "https://z.net/",
    "https://a.com/casino/x", "https://casino.com/help/casino-addiction", "https://a.com/casinos", "https://a.com/user/login?x=1", "https://ads.x.io/p", "https://wiki.a.com/login",
    "https://a.com/p?page=12345", "https://a.com/calendar/2020/1", "https://a.com/download/x.EXE", "https://a.com/\npath?q#f", "https://ü.net/de/",
]


def brute(url):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for v, r in HOST_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2], None
    for verdict in ("allow", "block"):
        for p in PATTERNS:
            if p.verdict == verdict and re.search(p.regex, low):
                return host, path, None, verdict, p.name
    return host, path, None, "allow", None


def test_odd_urls(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in judge_urls(df).collect())
    assert got == sorted((i, *brute(u)) for i, u, *_ in rows)


def test_whole_table_and_few_candidates(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = judge_urls(pages).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert all((r.host, r.path, r.rule, r.verdict, r.pattern) == brute(urls[r.page_id]) for r in out)
    assert sum(r.n_candidates for r in out) < 6 * len(out)


def test_ad_servers_are_fetched_by_token(spark):
    urls = ["https://ads.x.io/p", "http://adserver.a/", "http://doubleclick.net.io/x", "http://loads.x.io/", "http://x.io/ads.html"]
    got = [(r.pattern, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [("ad server", "block")] * 3 + [(None, "allow")] * 2 == [brute(u)[:2:-1] for u in urls]


def test_urls_without_tokens_of_rules_fetch_none(spark):
    assert all(p.tokens for p in PATTERNS)
    assert judge_urls(spark.createDataFrame([(1, "http://x.io/y"), (2, None)], "page_id long, url string")).where("n_candidates > 0").count() == 0


def test_patterns_hold_their_tokens():
    for u in filter(None, URLS):
        for p in PATTERNS:
            if re.search(p.regex, u.lower()):
                assert set(p.tokens) <= set(re.findall("[a-z0-9]+", u.lower()))


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
