import random
import re

import pytest

from botlens.llm import queries, urlfilter
from tests.oracle_check import canon, duck

SF = "/root/testdata/sf0.001"


def brute(url, rules, listed):
    at = url.find("://") if url else -1
    rest = url[at + 3:] if at >= 0 else ""
    host, path = re.match("([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = lambda h: host and (host == h or host.endswith("." + h))
    found = []
    for key, kind in rules:
        h, p = re.match("([^/]*)(.*)", key, re.S).groups()
        if fits(h) and path.startswith(p):
            found.append((len(key), len(h), kind, key))
    if found:
        _, _, kind, key = max(found)
        return host, path, key, kind
    return host, path, None, "block" if any(fits(h) for h in listed) else "allow"


def urls():
    rng = random.Random(12)
    hosts = ["org", "example.org", "a.Example.ORG", "b.a.example.org", "xexample.org", "free-bets.example.net", "m.ads-x.com", "com",
             "example.com", "", "é.com", "example.org:80", "x.casino.com", "adsense.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/en/2", "/fr/a", "/de/", "/ES/", "//", "/é/"]
    out = [f"{rng.choice(['http', 'HTTPS', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/x#y', '#f', '?'])}"
           for _ in range(600)]
    return out + [None, "", "no scheme", "a:/b", "://", "http://", "http://a://b/c", "http://" + "a." * 3000 + "com/fr/x", out[0]]


RULES = queries.URL_RULES


def lists(spark, rules, hosts):
    rows = rules + [(h, "listed") for h in hosts]
    return spark.createDataFrame(rows, "key string, kind string")


@pytest.mark.parametrize("bits", [1 << 24, 0])
def test_matches_brute_force(spark, monkeypatch, bits):
    """By the cascade, and by the join that takes over when a level would be too long."""
    monkeypatch.setattr(urlfilter, "MAX_BITS", bits)
    rows = [(None if i == 5 else i, u, "x", i) for i, u in enumerate(urls())]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, keys int")
    hosts = ["free-bets.example.net", "ads-x.com", "org", "never.seen"]
    got = urlfilter.judge(pages, lists(spark, RULES, hosts), ["page_id"]).collect()
    want = [(repr(i), *map(repr, brute(u, RULES, hosts))) for i, u, *_ in rows]
    assert sorted(tuple(map(repr, r)) for r in got) == sorted(want)


def test_cascade_is_exact_on_many_keys(spark):
    rng = random.Random(3)
    keys = [(f"k{i}", rng.random() < 0.2) for i in range(5000)]
    levels = urlfilter.cascade(spark.createDataFrame(keys, "key string, listed boolean"))
    assert 1 < len(levels) < 10
    got = spark.createDataFrame(keys, "key string, listed boolean")
    from pyspark.sql import functions as F
    wrong = got.filter(urlfilter.member(levels, F.col("key")) != F.col("listed")).count()
    assert wrong == 0
    # the size follows the listed keys
    assert sum(x.bits for x in levels) < 30 * sum(x for _, x in keys)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = lists(spark, RULES, []).limit(0)
    assert [tuple(r) for r in urlfilter.judge(pages, none, ["page_id"]).collect()] == [(1, "a.com", "/x", None, "allow")]
    assert urlfilter.judge(pages.limit(0), lists(spark, RULES, ["a.com"]), ["page_id"]).collect() == []


def test_registered_query_is_native_and_matches(spark):
    df = queries.queries()["op2_url_filters"](spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    res = duck(SF).execute(queries.oracle_sql()["op2_url_filters"])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in res.description], res.fetchall())
