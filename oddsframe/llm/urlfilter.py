"""URL filter: rules first, then the reputation of the host, in built-in functions only.

A labelled page is one good or bad outcome of its host.  Outcomes are counted per host, registered domain and suffix,
and shares of bad pages are shrunk from the top down: a suffix towards the share of all pages, a domain towards its
suffix, a host towards its domain.  How strongly is learnt at every level from how much the children of one parent
differ (beta-binomial moments): children that differ no more than chance are pulled to their parent almost whole.
A host's share then has a beta posterior; the host is blocked where the lower bound of that posterior reaches `limit`,
so a host of few labelled pages is judged by its family, and is allowed as long as the evidence leaves room.  The bound
is taken on the log-odds from their exact mean, variance and skewness; it is within 0.02 of the quantile.

Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; path: from there to `?`, `#` or end.  A url
that is null or has no `://` has empty host and path; all such pages share one host.  A user name and a port do not
count for domain and suffix; an address of four numbers is its own domain, without suffix.  A rule fits its host and
all subdomains if the path starts with the rule's; the longest rule wins, of equally long ones that with the longer
host.  Repeated rows count each time and come out each.  No rows, no output; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from oddsframe.llm.shared import keep

LIMIT, Z = 0.5, 1.645  # blocked where the bad share is above LIMIT with 95 %
LEAST_RHO, MOST_RHO = 1e-4, 0.5  # correlation of two outcomes of one child; a parent weighs as much as 1 / rho - 1 pages
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: second labels below which domains are registered
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "mil", "ne", "net", "or", "org")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def family(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    second = F.get(labels, n - 2)
    two = (n > 2) & (F.length(F.get(labels, n - 1)) == 2) & second.isin(*SECOND_LEVEL)
    last = F.when(two, 2).otherwise(1)
    address = name.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    suffix = F.when(address, "").otherwise(F.array_join(F.slice(labels, n - last + 1, last), "."))
    domain = F.when(address | (n <= last), name).otherwise(F.array_join(F.slice(labels, n - last, last + 1), "."))
    return domain, suffix


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; rules as (verdict, `host/path`)."""
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    parts = [(rule.split("/", 1)[0], rule, verdict) for verdict, rule in rules]
    parts.sort(key=lambda p: (-len(p[1]), -len(p[0]), p[2] != "block"))
    known = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(r[len(h) :]).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for h, r, v in parts])
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, F.lit(0))


def digamma(x: str) -> str:
    """SQL of the logarithmic derivative of the gamma function, by its series behind six steps."""
    y = f"({x} + 6.0)"
    steps = " - ".join(f"1.0 / ({x} + {k}.0)" for k in range(6))
    return f"(ln({y}) - 0.5 / {y} - 1.0 / (12.0 * pow({y}, 2)) + 1.0 / (120.0 * pow({y}, 4)) - 1.0 / (252.0 * pow({y}, 6)) - {steps})"


def trigamma(x: str) -> str:
    y = f"({x} + 6.0)"
    steps = " + ".join(f"1.0 / pow({x} + {k}.0, 2)" for k in range(6))
    return f"(1.0 / {y} + 0.5 / pow({y}, 2) + 1.0 / (6.0 * pow({y}, 3)) - 1.0 / (30.0 * pow({y}, 5)) + 1.0 / (42.0 * pow({y}, 7)) + {steps})"


def tetragamma(x: str) -> str:
    y = f"({x} + 6.0)"
    steps = " + ".join(f"1.0 / pow({x} + {k}.0, 3)" for k in range(6))
    return f"(-1.0 / pow({y}, 2) - 1.0 / pow({y}, 3) - 0.5 / pow({y}, 4) + 1.0 / (6.0 * pow({y}, 6)) - 1.0 / (6.0 * pow({y}, 8)) - 2.0 * ({steps}))"


def lower_bound(z: float) -> str:
    """SQL of the lower bound of a share with posterior Beta(a, b)."""
    variance = f"({trigamma('a')} + {trigamma('b')})"
    skewed = f"{(z * z - 1) / 6!r} * ({tetragamma('a')} - {tetragamma('b')}) / {variance}"
    return f"1.0 / (1.0 + exp({digamma('b')} - {digamma('a')} + {z} * sqrt({variance}) - {skewed}))"


def correlation(children: DataFrame) -> float:
    """How alike the outcomes of one child are beyond its parent's `mean`, by the moments of beta-binomial counts."""
    chance = "mean * (1 - mean)"
    sums: Row = children.where("n > 1").agg(F.expr(f"sum(pow(bad - n * mean, 2) - n * {chance})"), F.expr(f"sum(n * (n - 1) * {chance})")).first()
    rho = round(sums[0] / sums[1], 6) if sums[1] else MOST_RHO
    return min(max(rho, LEAST_RHO), MOST_RHO)


def summed(children: DataFrame, parent: str, *keys: str) -> tuple[float, DataFrame]:
    """Correlation in children, and the counts of their parents.

    Outcomes of one child repeat each other, so n of them tell as much about the parent as n / (1 + (n - 1) * rho)
    independent ones: a child with a third of all pages doesn't stand for its family.
    """
    means = children.groupBy(parent).agg((F.sum("bad") / F.sum("n")).alias("mean"))
    rho = correlation(children.join(means, parent))
    worth = F.when(F.col("n") > 1, F.col("n") / (1 + (F.col("n") - 1) * rho)).otherwise(F.col("n")).cast("double")
    share = F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0)
    return rho, children.groupBy(parent, *keys).agg(F.sum(worth).alias("n"), F.sum(share * worth).alias("bad"))


def shrunk(children: DataFrame, rho: float) -> DataFrame:
    """Beta parameters a, b of every child, shrunk to its parent's `mean`."""
    weight = 1 / rho - 1
    prior = F.lit(weight) * F.col("mean")
    return children.withColumns({"a": F.col("bad") + prior, "b": F.col("n") - F.col("bad") + F.lit(weight) - prior})


def reputations(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad, bad_share, bad_bound) from (host, bad); bad is 0, 1, or null where a page has no label."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    domain, suffix = family(F.col("host"))
    hosts = keep(counts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    in_hosts, domains = summed(hosts, "domain", "suffix")
    domains = keep(domains, "domains")
    in_domains, suffixes = summed(domains, "suffix")
    suffixes = keep(suffixes.withColumn("whole", F.lit("")), "suffixes")
    in_suffixes, _ = summed(suffixes, "whole")
    total = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((total[1] or 0.0) + 0.5) / ((total[0] or 0.0) + 1.0)

    def below(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        return children.join(parents.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")), key)

    suffixes = shrunk(suffixes.withColumn("mean", F.lit(overall)), in_suffixes)
    domains = shrunk(below(domains, suffixes, "suffix"), in_domains)
    judged = shrunk(below(hosts, domains, "domain"), in_hosts)
    share = (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_share")
    return judged.select("host", "n", "bad", share, F.expr(lower_bound(z)).alias("bad_bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of every page: a page carries its document's id as the last number of its path, and is bad where that
    document is labelled toxic or of quality 0; several labels of a document: bad where one is."""
    host, path = host_and_path(pages["url"])
    number = F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1)
    rows = pages.select(host.alias("host"), F.when(number != "", number).cast("long").alias("number"))
    bad = F.greatest((labels["toxic"] == 1).cast("int"), (labels["quality"] == 0).cast("int"))
    known = labels.select(labels["doc_id"].cast("long").alias("number"), bad.alias("bad")).groupBy("number").agg(F.max("bad").alias("bad"))
    return rows.join(known, "number", "left").select("host", "bad")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT, z: float = Z) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_share, bad_bound), one row a page; `outcomes` as for reputations().

    A host without any outcome, also one that `outcomes` does not name, is not blocked by reputation.
    """
    known = keep(reputations(outcomes, z), "reputations")
    host, path = host_and_path(pages["url"])
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.join(known, "host", "left")
    own = F.when(F.col("bad_bound") >= limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), F.round("bad_share", 6).alias("bad_share"), F.round("bad_bound", 6).alias("bad_bound"))
