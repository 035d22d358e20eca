import random
from collections import Counter

import pytest

from millrace.llm import urlfilter as u


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        host = rest[: min(ends)] if ends else rest
        rest = rest[len(host) :]
        ends = [rest.find(c) for c in "?#" if c in rest]
        path = rest[: min(ends)] if ends else rest
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for h, p, v in rules:
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), p, v, h + p))
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else default


def run(spark, urls, rules, **options):
    pages = spark.createDataFrame([(k, x, "c", "d") for k, x in urls], "page_id bigint, url string, host string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in u.judge(pages, table, **options).collect())


URLS = [
    None, "", "no scheme", "http://", "http://Example.NET", "http://example.net/", "http://a.b.example.net/en/x?y#z", "https://notexample.net/en/", "http://example.net/en", "http://example.net?/en/",
    "http://x.org/fr/", "http://org/fr/1", "http://org./fr/", "http://u@example.com:80/de/", "http://example.com/de/a", "http://sub.example.com/de/a#b", "ftp://a://b/c", "http://ÄB.net/x", "http://com/de/", "http://.net/", "http://a..net/q", "x\n://example.net/en/\nq",
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_the_given_rules(spark):
    urls = list(enumerate(URLS)) + [(None, URLS[5]), (4, URLS[4])]
    assert run(spark, urls, RULES) == Counter((k, *brute(x, RULES)) for k, x in urls)


@pytest.mark.parametrize("seed", range(3))
def test_many_nested_rules_and_a_hot_host(spark, monkeypatch, seed):
    monkeypatch.setattr(u, "STRETCH_ROWS", 40)
    draw = random.Random(seed)
    labels = ["a", "b", "ab", "net", "x-y", "a0"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randint(1, 5)))
    path = lambda: "/" + "/".join(draw.choice(["", "p", "q", "pq"]) for _ in range(draw.randint(0, 3)))
    rules = [(host(), path(), draw.choice(["allow", "block"])) for _ in range(120)] + [("", "/p", "block"), ("a.net", "", "block"), ("a.net", "", "block")]
    urls = [(k, f"http://{host()}{path()}?z") for k in range(900)] + [(1000 + k, f"http://hot.a.net{path()}") for k in range(500)]
    assert run(spark, urls, rules, default="unknown") == Counter((k, *brute(x, rules, "unknown")) for k, x in urls)


def test_empty_tables_and_null_rules(spark):
    urls = list(enumerate(URLS))
    assert run(spark, urls, [(None, "/", "block"), ("net", None, "block"), ("net", "/", None)]) == Counter((k, *brute(x, [])) for k, x in urls)
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert u.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
    long = "http://" + "a." * 5000 + "net/" + "p/" * 50_000
    assert run(spark, [(1, long)], RULES) == Counter([(1, *brute(long, RULES))])


def test_path_rules_of_one_host_nest():
    draw = random.Random(5)
    paths = sorted({"/" + "".join(draw.choice("ab/") for _ in range(draw.randint(0, 8))) for _ in range(300)})
    host = u.HostRules("k")
    for p in paths:
        host.add(p, (len(p),))
    for _ in range(500):
        asked = "/" + "".join(draw.choice("ab/c") for _ in range(draw.randint(0, 12)))
        want = max((len(p) for p in paths if asked.startswith(p)), default=None)
        got = host.longest(asked)
        assert (got and got[0]) == want


def test_rows_that_repeat_are_spread_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(u, "STRETCH_ROWS", 100)
    pages = spark.range(4000).selectExpr("cast(1 as bigint) page_id", "'http://hot.example.net/en/x' url")
    out = u.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    sizes = [r["count"] for r in out.withColumn("p", __import__("pyspark").sql.functions.spark_partition_id()).groupBy("p").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500 and {r.rule for r in out.distinct().collect()} == {"example.net/en/"}
