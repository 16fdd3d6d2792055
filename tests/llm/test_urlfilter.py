import re

import duckdb

from panelscope.llm import urlfilter as uf

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/1", "http://a.example.com/en", "http://blog.net/es/5?x=1", "http://net/fr/#a",
    "http://notnet/es/", "http://x.com", "http://x.com/", "http://x.com?y", "https://spam-farm.org/a", "https://spamfarm.org/", "http://a.org/poker", "http://a.org/poker/casino",
    "http://a.org/poker-poker", "http://casino.poker.org/", "http://a.org/pokers/casinos", "http://a.org/xporn", "http://a.org/porn", "http://a.org/?q=PORN&a=b://c/", "http://u:p@h.org:80/é/poker",
    "cheap", "cheap-pills", "cheap-pills-cheap", "http://É.NET/es/xxx", "a\nb://c.net/fr/\nxxx", "http://a.org/" + "poker/" * 5000, "a://b://c.com/d", "http://.com/",
]


def slow(url):
    """(host, path, rule, verdict, n_strict, n_soft, n_soft_distinct) by the definitions."""
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    rest = (url or "").partition("://")[2]
    host = lower(re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(host) :])[0]
    fit = [(h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
    n = {t: len(re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", lower(url or ""))) for t in uf.VOCABULARY}
    strict = sum(c for t, c in n.items() if uf.VOCABULARY[t] >= 1)
    soft = [c for t, c in n.items() if c and uf.VOCABULARY[t] < 1]
    return host, path, rule, verdict or ("block" if strict or len(soft) >= 2 else "allow"), strict, sum(soft), len(soft)


def test_odd_urls_equal_definitions_and_sql(spark, sf):
    rows = list(enumerate(URLS)) + [(0, None), (None, "http://a.org/xxx")]
    pages = spark.createDataFrame([(i, u, "kept", 1) for i, u in rows], "page_id long, url string, html string, Rule int")
    got = uf.judge(pages)
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict", "n_strict", "n_soft", "n_soft_distinct", "weight"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r["rule"], r.verdict, r.n_strict, r.n_soft, r.n_soft_distinct) == slow(r.url), r.url
    d = sf(pages=pages)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet/*.parquet'")
    out = uf.op12_url_filter(spark, d)
    want = con.execute(uf.sql())
    assert out.columns == [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want.fetchall()))


def test_query_equals_sql_on_the_given_pages(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    got = sorted(map(tuple, uf.op12_url_filter(spark, d).collect()))
    assert got == sorted(con.execute(uf.sql()).fetchall())
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_own_rules_and_terms(spark):
    pages = spark.createDataFrame([("http://a.b.c/x/y",), ("http://b.c/x",), ("http://c/",), ("http://d/one-two",), ("http://d/two-three",)], "url string")
    rules = [("c", "/x/y", "block"), ("a.b.c", "/x", "allow"), ("B.c", "", "block"), ("b.c", "", "allow")]
    got = [(r["rule"], r.verdict, r.weight) for r in uf.judge(pages, rules, {"one": 0.1, "one-two": 0.2, "three": 2.0, "two": 0.1}, 3).collect()]
    assert got == [("a.b.c/x", "allow", 0.0), ("b.c", "block", 0.0), (None, "allow", 0.0), (None, "block", 0.4), (None, "block", 2.1)]
    assert [r.verdict for r in uf.judge(pages, [], {}).collect()] == ["allow"] * 5


def test_empty_table(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
