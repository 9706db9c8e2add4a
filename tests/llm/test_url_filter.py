import re

import pytest
from pyspark.sql import functions as F

from ferrule.llm.queries import RULES
from ferrule.llm.url_filter import judge_urls

URLS = [
    None, "", "example.com/en/", "http://", "http://com", "http://com/", "HTTP://WWW.EXAMPLE.COM/en/x", "http://example.com/en", "http://example.com/en/", "http://a.example.com/en/?q=/de/", "http://b.www.example.com/en/1",
    "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/fr?/es/", "http://x.net#/es/", "http://net/es/", "ftp://.net/es/", "x://y.net./es/", "http://x.net:80/es/", "a://b://c.net/es/",
    "http://É.com/", "//com/", "http://x.net//es/", "http://x.net/es/" + "a/" * 5000, "http://" + "a." * 5000 + "net/fr/", "http://x\ny.com/\n?", "http://x.net/ES/",
]
MORE = [("net", "/e", "block"), ("net", "/es/1", "allow"), ("x.net", "/", "allow"), ("com", "/", "block"), ("", "", "block"), ("org", "", "block"), ("d.org", "/a/b", "allow"), ("d.org", "/a/bc", "block")]


def brute(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, 0, None, default)
    return host, path, best[3], best[4]


@pytest.mark.parametrize("rules", [RULES, RULES + MORE, []])
@pytest.mark.parametrize("most", [1 << 20, -1])
def test_the_longest_rule_holds(spark, rules, most):
    urls = URLS + ["http://d.org/a/bcd", "http://e.d.org/a/b/c", "http://org", "http://d.org/a", "http://x.net/e", "http://x.net/es/12"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("de", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, table, most_bytes=most).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_whole_table_by_both_ways(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    table = spark.createDataFrame(RULES + MORE, "host string, path string, verdict string")
    one, two = ({(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, table, most_bytes=n).collect()} for n in (1 << 20, -1))
    assert one == two == {(r.page_id, *brute(r.url, RULES + MORE)) for r in pages.collect()}


def test_repeated_rows_clashing_names_and_no_rows(spark):
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://a.net/es/", "x", 1), (None, "http://a.net/es/", "x", 1)], "page_id long, url string, host string, _out int")
    for most in (1 << 20, -1):
        rows = judge_urls(pages, table, default="block", most_bytes=most)
        assert [tuple(r) for r in rows.select("page_id", "_out", "host", "rule", "verdict").collect()] == [(None, 1, "a.net", "net/es/", "block")] * 2
        assert sorted(rows.columns) == sorted(["page_id", "url", "_out", "host", "path", "rule", "verdict"])
        assert judge_urls(pages.where(F.lit(False)), table, most_bytes=most).count() == 0
    assert judge_urls(spark.createDataFrame([(1, "x")], "page_id long, url string"), table, default="block").first().verdict == "block"
