import pytest

from tollbook.llm import url_filters as u

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://example.com/EN/", "http://a.b.example.com/en/1?q=1#f",
    "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net", "http://x.com?/", "http://x.com#/", "ftp://x.com:80/a", "http://u@x.com/a", "a://b://c.com/", "http://x.com/é/\n/z",
]
RULES = [*u.RULES, ("", "/ads/", "block"), ("shop.org", "/*/cart", "block"), ("shop.org", "/a.b/", "allow"), ("shop.org", "/a+b/", "block"), ("a-b.io", "", "block"), ("x.com", "/b", "allow"), ("x.com", "/b", "block"), (None, None, "block")]
MORE = ["http://z.org/ads/1", "http://shop.org/x/y/cart", "http://shop.org/cart", "http://shop.org/a.b/", "http://shop.org/aXb/", "http://shop.org/a+b/", "http://q.a-b.io", "http://x.com/bbb"]


def judged(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in rules:
        if h is None and p is None:
            continue
        parts, at, fits = p.split("*"), 0, path.startswith(p.split("*")[0])
        for part in parts:
            at = path.find(part, at)
            fits, at = fits and at >= 0, at + len(part)
        if fits and (h == "" or host == h or host.endswith("." + h)):
            best = min(filter(None, [best, (-len(h + p), v != "block", h + p, v)]))
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("most", [10**6, 0], ids=["broadcast", "salted"])
def test_like_trying_every_rule(spark, monkeypatch, most):
    monkeypatch.setattr(u, "BROADCAST_RULES", most)
    urls = (URLS + MORE) * 2
    pages = spark.createDataFrame([(i // 2, x, "extra", "mine") for i, x in enumerate(urls)], "page_id long, url string, Rule string, key string")
    got = u.apply_rules(pages, u.rule_table(spark, RULES)).collect()
    assert len(got) == len(urls) and got[0].key == "mine"
    want = [(i // 2, x, *judged(x, RULES)) for i, x in enumerate(urls)]
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got], key=key) == sorted(want, key=key)


def test_rarest_token_is_the_key(spark):
    pages = spark.createDataFrame([(i, f"http://a{i}.example.com/en/") for i in range(5)], "page_id long, url string")
    host, path = u.host_and_path(pages["url"])
    index = {r.rule: r.key for r in u.rule_index(u.rule_table(spark, [("example.com", "/fr/", "block"), ("com", "/", "allow")]), pages.select(host.alias("host"), path.alias("path"))).collect()}
    assert index == {"example.com/fr/": "fr", "com/": "com"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.apply_rules(none, u.rule_table(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    assert [r.verdict for r in u.apply_rules(one, u.rule_table(spark, [])).collect()] == ["allow"]


def test_hosts_with_spaces(spark):
    urls = ["https://bad host.example.com/en/x", "https://a b.net/es/1", "https://x.com /b", "https:// /ads/1", "https://q\n.a-b.io/ x/", "http://x y/z.com/ads/"]
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.apply_rules(pages, u.rule_table(spark, RULES)).collect()}
    assert got == {i: judged(x, RULES) for i, x in enumerate(urls)}
    assert got[0][3] == "block"
