"""URL filters: rules by host and path, and where none fits, empirical-Bayes reputation of the host.

Outcomes of labelled pages are counted a host. A beta-binomial prior goes down three levels: the suffix's rate is shrunk
towards the rate of all, the registered domain's towards its suffix's, the host's towards its domain's. How strongly is
estimated for each level from the outcomes, by the method of moments: alike children are shrunk more. A host is blocked
where it is credibly poor: the upper bound of its rate of good pages (Z standard deviations of the posterior) is below
LEAST. So hosts without labels go by their domain, and a few bad pages block no host.

Rows: a null url, or one without ://, has an empty host and path, fits no rule and is judged as a host of its own. A page
without outcome counts for nothing; a page with several counts for each. Repeated rows are judged each.
Empty tables give no rows; without any outcome the prior's rate is a half and nothing is blocked."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, heavy_keys


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
# Suffixes of two labels; any other is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: Standard deviations of the upper bound, the least rate that it may have, and the range of a prior's weight in pages.
Z, LEAST, WEIGHTS = 1.645, 0.5, (2.0, 50.0)
SALTS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to /, ? or #, in lower case (A-Z); and then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one text) and its verdict; nulls where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """A host's suffix (one of SUFFIXES, else its last label) and registered domain (one label more)."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*SUFFIXES)
    return F.when(long, two).otherwise(F.substring_index(host, ".", -1)), F.when(long, F.substring_index(host, ".", -3)).otherwise(two)


def _shrunk(level: DataFrame, above: str, out: str) -> tuple[DataFrame, float]:
    """level (n, good, above: the rate to shrink towards) with the rate `out`; and the prior's weight.

    Overdispersion r by moments: E(good - n p)^2 = n p (1 - p) (1 + (n - 1) r); the prior's weight is 1 / r - 1 pages."""
    n, p = F.col("n"), F.col(above)
    spread = n * p * (1 - p)
    a, b = level.agg(F.sum((F.col("good") - n * p) ** 2 - spread), F.sum(spread * (n - 1))).first()
    r = a / b if b else 0.0
    weight = min(WEIGHTS[1], max(WEIGHTS[0], 1 / r - 1)) if r > 0 else WEIGHTS[1]
    return level.withColumn(out, (F.col("good") + weight * p) / (n + weight)), weight


def reputations(hosts: DataFrame) -> DataFrame:
    """Rows (host, n, good, rate, bound) of hosts (host, n, good): the posterior's mean and upper bound.

    Of each level only two sums come to the driver."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = hosts.select("host", "n", "good", suffix.alias("suffix"), domain.alias("domain"))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    counts = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    suffixes = hosts.groupBy("suffix").agg(*counts).withColumn("all", F.lit(((good or 0) + 1) / ((n or 0) + 2)))
    suffixes = _shrunk(suffixes, "all", "by_suffix")[0].select("suffix", "by_suffix")
    domains = hosts.groupBy("suffix", "domain").agg(*counts).join(suffixes, "suffix")
    domains = _shrunk(domains, "by_suffix", "by_domain")[0].select("suffix", "domain", "by_domain")
    own, weight = _shrunk(hosts.join(domains, ["suffix", "domain"]), "by_domain", "rate")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + weight + 1))
    return own.select("host", "n", "good", "rate", F.least(F.lit(1.0), F.col("rate") + Z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, host_bound) of pages (page_id, url).

    outcomes (url, n, good): how many labelled pages a url has, and how many of them are good. Hosts with more than a
    thousandth of the pages are salted where pages meet the hosts' bounds."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    none = F.lit(0).cast("long")
    rows = parsed.select("host", none.alias("n"), none.alias("good")).unionByName(outcomes.select(host.alias("host"), "n", "good"))
    hosts = cut(rows.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    left, right = dealt(parsed, reputations(hosts).select("host", "bound"), heavy_keys(parsed, "host"), "host", SALTS, "page_id")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") < LEAST, "block").otherwise("allow")
    both = left.join(right, ["host", "__sp_salt"])
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.round("bound", 6).alias("host_bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes (url, n, good) of pages by labels of the documents that they show, the number that ends a page's path.

    A page is good if its document is labelled as of quality and not as toxic; a label without either counts for nothing.
    Equal urls are summed up before they meet the labels."""
    number = F.regexp_extract(host_and_path(F.col("url"))[1], r"/([0-9]{1,18})(?:[.][a-z]+)?/?$", 1)
    shown = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where(F.col("doc_id").isNotNull())
    shown = shown.groupBy("url", "doc_id").agg(F.count("*").alias("n"))
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    good = (F.coalesce(F.col("quality"), F.lit(1)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = known.select("doc_id", good.cast("long").alias("is_good"))
    return shown.join(known, "doc_id").groupBy("url").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_good")).alias("good"))
