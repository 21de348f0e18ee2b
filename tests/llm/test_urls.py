from docloom.llm.queries import URL_RULES
from docloom.llm.url_filter import judge_urls

URLS = [
    None, "", "no scheme", "http://net", "http://net/", "HTTP://A.Example.NET/en/1", "http://a.example.net/fr/1?x=/en/", "http://example.com/de/x", "http://xexample.com/de/x",
    "ftp://u.org/fr/", "http://u.org/fr", "http://mynet/", "http://a.b.example.com/en/9#f", "a://b://c/d",
]


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(h, p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, u) for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    rows = judge_urls(pages, URL_RULES).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_mined_rules_follow_the_labels(spark):
    urls = [f"http://s{i}.example.net/{'ads' if i % 2 else 'fr'}/{i}" for i in range(60)] + [f"http://s{i}.shop.org/fr/{i}" for i in range(60)]
    urls += ["http://new.com/ads/1", "http://new.com/fr/2", "http://other.com/zz"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(pages, [("net", "/", "block"), ("org", "/fr/", "allow")]).collect()}
    assert got[120].verdict == "block" and got[120].mined == "path0:ads" and got[120].confidence == 1.0
    assert got[122].verdict == "allow" or got[122].mined
