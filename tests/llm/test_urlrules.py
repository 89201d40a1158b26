import random

from trackfold.llm import urlrules

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        cut = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        path = tail[:cut]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_equals_brute_force(spark):
    rng = random.Random(0)
    hosts = ["example.com", "EXAMPLE.net", "a.b.example.org", "notexample.com", "com", "net", "x.net.", "", "é.com", "ex.ample.com"]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x=1", "/de/8#y", "/de/", "/DE/8", "/es/é", "//en/", "?/en/", "#://com/en/"]
    urls = [f"{rng.choice(['http', '', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(500)] + [None, "", "no scheme/en/", "://", "http://com/en/" + "x" * 100_000, "http://" + "a." * 5000 + "com/en/1"]
    rules = [*RULES, ("b.example.org", "/", "allow"), ("org", "/es/", "allow"), ("com", "/en/", "block")]
    pages = spark.createDataFrame([(k // 2, u, "z", k) for k, u in enumerate(urls)], "page_id long, url string, host string, n long")
    got = {r.n: (r.host, r.path, r.rule, r.verdict) for r in urlrules.with_verdict(pages, rules).collect()}
    strict = {(h, p): v for h, p, v in rules}
    strict["org", "/es/"] = "block"
    assert got == {k: brute(u, [(h, p, v) for (h, p), v in strict.items()]) for k, u in enumerate(urls)}
    kept = urlrules.allowed(pages, rules)
    assert kept.columns == pages.columns
    assert sorted(r.n for r in kept.collect()) == sorted(k for k, v in got.items() if v[3] == "allow")


def test_no_python_in_the_plan_and_empty_inputs(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    plan = urlrules.with_verdict(pages, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert urlrules.with_verdict(pages.limit(0), RULES).count() == 0
    assert [r.verdict for r in urlrules.with_verdict(pages, []).collect()] == ["allow"]


def test_many_rules_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.createDataFrame([(1, "http://a.com/en/"), (2, "http://example.net/de/81")], "page_id long, url string")
        out = urlrules.with_verdict(pages, RULES)
        assert sorted(r.verdict for r in out.collect()) == ["block", "block"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_allowed_pages_keep_columns_of_any_name(spark):
    names = "page_id long, url string, __url string, host string, path int, rule int, verdict string, page int"
    pages = spark.createDataFrame([(1, "http://a.com/en/", "own", "h", 1, 2, "v", 3), (2, "http://b.org/", "own", "h", 1, 2, "v", 3)], names)
    out = urlrules.allowed(pages, RULES)
    assert out.columns == pages.columns
    assert [tuple(r) for r in out.collect()] == [(2, "http://b.org/", "own", "h", 1, 2, "v", 3)]
