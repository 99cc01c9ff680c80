"""URL filter: parts of urls, rules, shrinkage and bound against plain arithmetic, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsframe.llm import urlfilter
from oddsframe.llm.queries import URL_RULES

URLS = [
    ("https://A.Example.ORG/en/1?q=/x", "a.example.org", "/en/1", "example.org/en/1", "allow"),
    ("http://example.org/es/5#top", "example.org", "/es/5", "example.org/es/", "block"),
    ("http://badexample.org/es/5", "badexample.org", "/es/5", "org/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.com/fr/7", "x.com", "/fr/7", "com/fr/", "allow"),
    ("http://x.org", "x.org", "", None, "allow"),  # no path, so it does not start with the rule's
    ("ftp://É.com?x", "É.com", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("no scheme.org/es/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://x.com#/de/", "x.com", "", None, "allow"),
    ("http://me@y.com:80/en/" + "z" * 50_000, "me@y.com:80", "/en/" + "z" * 50_000, None, "allow"),
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(k, u[0], "clash", "clash") for k, u in enumerate(URLS)], "page_id long, url string, host string, fit string")
    none = spark.createDataFrame([], "host string, bad int")
    rows = {r["page_id"]: r for r in urlfilter.judge(pages, none, URL_RULES).collect()}
    assert [(rows[k]["host"], rows[k]["path"], rows[k]["rule"], rows[k]["verdict"]) for k in range(len(URLS))] == [u[1:] for u in URLS]
    assert urlfilter.judge(pages.where("false"), none, URL_RULES).collect() == []
    assert {r["rule"] for r in urlfilter.judge(pages, none, []).collect()} == {None}


def test_families(spark):
    want = {
        "a.b.example.org": ("example.org", "org"), "example.org": ("example.org", "org"), "org": ("org", "org"), "x.shop.co.uk": ("shop.co.uk", "co.uk"),
        "co.uk": ("co.uk", "uk"), "10.0.0.1": ("10.0.0.1", ""), "me@x.y.com:80": ("y.com", "com"), "": ("", ""), "a.co.com": ("co.com", "com"),
    }
    domain, suffix = urlfilter.family(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in rows} == want


@pytest.mark.parametrize("a,b", [(3.0, 9.0), (40.0, 10.0), (200.0, 150.0), (5000.0, 1000.0), (12.5, 0.8)])
def test_bound_is_near_the_quantile(spark, a, b):
    want = np.quantile(np.random.default_rng(1).beta(a, b, 400_000), 0.05)
    got = spark.createDataFrame([(a, b)], "a double, b double").select(F.expr(urlfilter.lower_bound(urlfilter.Z)).alias("x")).first()["x"]
    assert abs(got - want) < 0.02


def outcomes(spark):
    """Good hosts of one domain, a bad domain with a host of few pages, and a host of few pages elsewhere."""
    counts = {f"h{k}.good.com": (40, 2 + k % 3) for k in range(20)} | {f"h{k}.bad.net": (40, 36 + k % 3) for k in range(20)}
    counts |= {"new.bad.net": (1, 1), "new.good.com": (1, 1), "none.bad.net": (0, 0), "big.good.com": (2000, 1900)}
    rows = [(h, 1 if k < bad else 0) for h, (n, bad) in counts.items() for k in range(n)] + [("none.bad.net", None)] * 3
    return counts, spark.createDataFrame(rows, "host string, bad int")


def test_hosts_are_judged_by_their_family_until_they_have_a_record(spark):
    counts, df = outcomes(spark)
    rows = {r["host"]: r for r in urlfilter.reputations(df).collect()}
    assert {h: (r["n"], r["bad"]) for h, r in rows.items()} == counts
    assert rows["big.good.com"]["bad_bound"] > 0.9  # its own pages outweigh its family
    assert rows["new.bad.net"]["bad_bound"] > rows["new.good.com"]["bad_bound"]
    assert rows["none.bad.net"]["bad_share"] > 0.6 > rows["new.good.com"]["bad_share"]
    assert all(rows[f"h{k}.bad.net"]["bad_bound"] >= 0.5 > rows[f"h{k}.good.com"]["bad_bound"] for k in range(20))
    assert urlfilter.reputations(df.where("false")).collect() == []


def test_shrinkage_is_the_stated_formula(spark):
    counts, df = outcomes(spark)
    def above(children, parent):  # name: (n, bad); correlation, and counts of the parents
        raw = {}
        for c, (n, k) in children.items():
            was = raw.get(parent(c), (0, 0))
            raw[parent(c)] = (was[0] + n, was[1] + k)
        each = [(n, k, raw[parent(c)][1] / raw[parent(c)][0]) for c, (n, k) in children.items() if n > 1]
        rho = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in each) / sum(n * (n - 1) * m * (1 - m) for n, k, m in each)
        rho = min(max(round(rho, 6), urlfilter.LEAST_RHO), urlfilter.MOST_RHO)
        out = {}
        for c, (n, k) in children.items():
            worth = n / (1 + (n - 1) * rho) if n > 1 else n
            was = out.get(parent(c), (0, 0))
            out[parent(c)] = (was[0] + worth, was[1] + (k / n * worth if n else 0))
        return rho, out

    def shrink(children, rho, mean):
        return {c: (k + (1 / rho - 1) * mean(c)) / (n + 1 / rho - 1) for c, (n, k) in children.items()}

    in_hosts, domains = above(counts, lambda h: h.split(".", 1)[1])
    in_domains, suffixes = above(domains, lambda d: d.split(".")[-1])
    in_suffixes, total = above(suffixes, lambda s: "")
    n, k = (sum(c[i] for c in suffixes.values()) for i in (0, 1))
    top = shrink(suffixes, in_suffixes, lambda s: (k + 0.5) / (n + 1))
    middle = shrink(domains, in_domains, lambda d: top[d.split(".")[-1]])
    hosts = shrink(counts, in_hosts, lambda h: middle[h.split(".", 1)[1]])
    got = {r["host"]: r["bad_share"] for r in urlfilter.reputations(df).collect()}
    assert got == pytest.approx(hosts, abs=1e-9)


def test_outcomes_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/12.html?x=9"), (2, "http://a.com/en/13/"), (3, "http://b.com/"), (4, None), (5, "http://a.com/" + "9" * 40), (2, "http://a.com/en/13/")], "page_id long, url string")
    labels = spark.createDataFrame([(12, 1, 0), (12, 0, None), (13, None, None), (None, 0, 1), (14, 0, 1)], "doc_id long, quality int, toxic int")
    rows = sorted(((r["host"], r["bad"]) for r in urlfilter.page_outcomes(pages, labels).collect()), key=repr)
    assert rows == sorted([("a.com", 1), ("a.com", None), ("a.com", None), ("b.com", None), ("", None), ("a.com", None)], key=repr)
