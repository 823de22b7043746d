from tessera.llm import url_filter

URLS = [
    (1, None, None), (2, "no scheme", 1), (3, "", None), (4, "http://A.Example.NET/en/1?x#y", 0), (5, "http://evilexample.net/en/1", None),
    (6, "https://example.com/de/7", None), (7, "https://a.example.com/DE/7", None), (8, "http://x.org/fr/", None), (9, "http://x.org", None),
    (10, "http://h.com//a///b?q", None), (11, "http://h.com/1/2/3/4/5/6/7/8/9", None), (12, "http://net", 1), (13, "ftp://b.net/x#a?b", 1), (13, "ftp://b.net/x#a?b", 1),
]


def rule_of(host, path):
    best = None
    for verdict, r in url_filter.RULES:
        d, _, p = r.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (verdict, r)
    return best


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    return host, tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string, bad int")
    got = url_filter.judge(df, url_filter.RULES, bad_col="bad").collect()
    assert len(got) == len(URLS)
    by = {u[0]: u[1] for u in URLS}
    for r in got:
        host, path = split(by[r["page_id"]])
        want = rule_of(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (want[1] if want else None)
        assert not want or r["verdict"] == want[0]


def test_tree_generalises_blocks_and_merges(spark):
    rows = [(i, f"http://h.example/{'spam' if i % 2 else 'news'}/{chr(97 + i % 26)}x{i}/page", int(i % 2)) for i in range(400)]
    rows += [(1000 + i, f"http://h.example/{s}/{i}", 0) for i in range(40) for s in ("p", "q")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), [], bad_col="bad").toPandas()
    assert set(got[got.page_id < 1000].template) == {"/spam/*/page", "/news/*/page"}
    assert set(got[got.template == "/spam/*/page"].verdict) == {"block"}
    assert set(got[got.template != "/spam/*/page"].verdict) == {"allow"}
    assert set(got[got.page_id >= 1000].template) == {"/+/*"}


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([], "page_id long, url string, bad int")
    assert url_filter.judge(df, url_filter.RULES, bad_col="bad").count() == 0
    got = url_filter.judge(spark.createDataFrame(URLS, "page_id long, url string, bad int"), []).collect()
    assert {r["verdict"] for r in got} == {"allow"}
