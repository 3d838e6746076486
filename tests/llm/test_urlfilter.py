"""URL filter against a plain rule by rule search."""

from tests.conftest import SMALL
from threadmill.llm import queries, urlfilter
from tools.check_oracle import duck, rows_of

URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/", "https://example.com/en/x?y#z", "https://a.example.com/EN/x", "https://www.example.com/en/x",
    "https://b.www.example.com/en/", "https://notexample.com/en/", "http://x.net/es/1", "http://net/es/1", "http://x.net/es", "http://x.net/it/", "ftp://x.net/fr/?://com/", "http://a..b.net/fr/", "http://example.com?/en/", "http://.com/",
    "http://Ä.com/en/", "x\nhttp://y.com/\nen/", "http://" + "a." * 3000 + "net/es/" + "b/" * 3000,
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def judge(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    return urlfilter.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()


def test_urls(spark):
    got = judge(spark, URLS, urlfilter.RULES)
    assert len(got) == len(URLS)
    for r in got:
        assert tuple(r)[1:] == plain(URLS[r["page_id"]], urlfilter.RULES), URLS[r["page_id"]]


def test_other_rules(spark):
    """Prefixes that end inside a directory, equal rules, a null rule, no rules."""
    rules = [("b.com", "/pa", "block"), ("com", "", "allow"), ("COM", "/path/long", "block"), ("com", "/path/long", "allow"), (None, "/", "block")]
    known = [(h.lower(), p, v) for h, p, v in rules if h and (p, v) != ("/path/long", "allow")]
    urls = ["http://a.b.com/path", "http://b.com/p", "http://c.com/path/longer", "http://c.com", "http://c.org/"]
    for r in judge(spark, urls, rules):
        assert tuple(r)[1:] == plain(urls[r["page_id"]], known)
    assert {r["verdict"] for r in judge(spark, urls, rules[4:])} == {"allow"}
    assert judge(spark, [], rules) == []


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "http://x.net/es/")] * 2 + [(1, "http://x.net/es/")] * 3, "page_id long, url string")
    got = urlfilter.filter_urls(df, spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")).collect()
    assert sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in got) == [(0, "net/es/", "block")] * 2 + [(1, "net/es/", "block")] * 3


def test_query_against_sql(spark):
    df = queries.op2_url_filter(spark, SMALL)
    cur = duck(SMALL).execute(queries.ORACLES["op2_url_filter"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
