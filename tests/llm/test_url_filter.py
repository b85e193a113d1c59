from rankloom.llm import url_filter as uf

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b.org", "/fr/x"), ("allow", "a.b.org", "/fr/x"), ("block", "q.org", "/pre")]
URLS = ["http://x.example.net/en/1", "http://Example.NET/de/", "https://example.com/de/x?y#z", "http://example.com", "http://my.org/fr/", None, "", "no-scheme.net/", "http://a.b.org/fr/xyz",
        "http://net/", "http://internet/", "http://q.org/prefix/a", "http://s.q.org/pre", "http://q.org/p", "a://b://net/", "http://u@net:80/", "http://net?x", "http://x.net/" + "seg/" * 5000]


def brute(url, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count("."), len(p), a == "block", h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_trie_and_join_agree_with_brute_force(spark):
    rows = [(i if i % 5 else None, u, "clash") for i, u in enumerate(URLS + URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    want = sorted(map(str, (brute(u) for u in URLS + URLS)))
    got = uf.filter_urls(df, RULES)
    assert sorted(str((r.host, r.path, r.rule, r.verdict)) for r in got.collect()) == want
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    for most in (100, 2):
        got = uf.filter_urls(df, rules, max_broadcast_rules=most)
        assert sorted(str((r.host, r.path, r.rule, r.verdict)) for r in got.collect()) == want


def test_empty(spark):
    assert uf.filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
