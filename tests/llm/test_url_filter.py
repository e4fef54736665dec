import random

from auditspark.llm import url_filter as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "", "block"), ("b", "/x", "allow"), ("B", "/X/y", "block"), (None, "/", "block"), ("c", None, "block")]


def split(url):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = lambda s, ends: s[: min([s.find(e) for e in ends if e in s] or [len(s)])]
    host = cut(rest, "/?#")
    return "".join(c.lower() if c.isascii() else c for c in host), cut(rest[len(host) :], "?#")


def judged(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def run(spark, urls, rules, **how):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = U.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **how)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def plain(rules):
    return [(h.lower(), p or "", v) for h, p, v in rules if h is not None]


def test_against_all_rules_one_by_one(spark, monkeypatch):
    rng = random.Random(2)
    labels, parts = ["a", "b", "c", "net", "org", "example", "com", "xnet"], ["en", "de", "fr", "x", "X", "y", ""]
    urls = ["http://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + rng.choice(["", "/", "?q=/en/", "#/fr/"]) + "/".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(400)]
    urls += [None, "", "no scheme/net/", "://", "HTTP://EXAMPLE.NET/en/x?y", "http://example.net/EN/", "http://net", "http://É.NET/", "a://b://c", "http://user@net:80/", "http://net/a\nb", "http://" + "a." * 300 + "net/" + "d/" * 300]
    want = {i: judged(u, plain(RULES)) for i, u in enumerate(urls)}
    assert run(spark, urls, RULES) == want
    monkeypatch.setattr(U, "BROADCAST_BYTES", 0)  # rules joined by shuffle
    assert run(spark, urls, RULES) == want


def test_ties_between_rules(spark):
    rules = [("ab", "/c", "allow"), ("b", "/cd", "block"), ("x.ab", "", "block"), ("ab", "/c", "block")]
    for i, url in enumerate(["u://x.ab/c/", "u://ab/c", "u://x.ab/z"]):
        assert run(spark, [url], rules)[0] == judged(url, rules), i


def test_no_rules_no_rows_repeats_and_clashing_columns(spark):
    assert run(spark, ["http://net/"], [(None, "/", "block")], default="block") == {0: ("net", "/", None, "block")}
    assert run(spark, [], RULES) == {}
    pages = spark.createDataFrame([(1, "http://a.net/", "h", 5), (1, "http://a.net/", "h", 5), (2, None, None, 6)], "page_id long, url string, HOST string, n int")
    out = U.judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert out.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict"]
    assert sorted(tuple(r) for r in out.collect() if r.url) == [(1, "http://a.net/", 5, "a.net", "/", "net/", "block")] * 2 and out.count() == 3
