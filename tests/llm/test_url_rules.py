from grainflow.llm import queries
from grainflow.llm.url_rules import judge_urls
from tests.llm.helpers import SF, spark_rows, sql_rows

RULES = [("com/en/", "block"), ("Example.com/en/7", "allow"), ("net/de/", "allow"), ("bare.org", "block"), ("com/en/", "allow"), (None, "block"), ("net/", "block"), ("x.com/en/", None)]
URLS = [
    "http://A.Example.COM/en/785?x", "http://example.com/en/8", "https://x.com/en/", "https://x.com/en", "http://net/de/1", "http://a.net", "http://a.net/", "no scheme",
    None, "://", "http://q.bare.org", "http://notbare.org/", "a://b?c://com/en/", "http://com/en/#a", "http://" + "a." * 3000 + "net/de/" + "x" * 9000, "http://x.com/en/",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for rule, action in RULES:
        if rule is not None and action is not None:
            h, slash, p = rule.lower().partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append((len(rule), rule.lower(), action))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, digest int, rule string")
    rules = spark.createDataFrame(RULES, "rule string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate([*URLS, URLS[0]])}
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_sql(spark):
    assert spark_rows(queries.op6_url_rules(spark, SF)) == sql_rows(queries.ORACLE_SQL["op6_url_rules"])
