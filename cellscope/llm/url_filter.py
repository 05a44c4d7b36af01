"""URL filter: fixed host/path rules, else empirical-Bayes host reputation.

Labelled page outcomes are counted per host, host counts roll up to registered domains and public
suffixes, and each level is shrunk towards the one above it through a beta-binomial prior whose
strength is estimated by moments from the units that have outcomes. A unit without outcomes keeps
its prior, so a new host has the reputation of its domain, a new domain that of its suffix and a
new suffix that of the whole. A host is blocked when the lower posterior bound of its bad-page rate
(the posterior mean less Z posterior deviations) exceeds a limit. DataFrame functions only.

Defined results: a null url, or one without ``://``, has empty host and path and shares the
reputation of the empty host; repeated rows are judged one by one; repeated or null label rows
count once per page (bad wins); a null id never matches a label; without labels no host is
blocked; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellscope.llm.shared import spool

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict); a rule covers its host and all subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Public suffixes of two labels, by country code and the labels used below it.
SECOND_LEVEL = {
    "uk": "co org ac gov ltd plc me net sch nhs", "au": "com net org edu gov id", "nz": "co net org ac govt", "jp": "co ne or ac go ed", "br": "com net org gov edu", "za": "co org net ac gov", "in": "co net org ac gov",
    "cn": "com net org gov edu ac", "tw": "com net org edu gov", "hk": "com net org edu gov", "kr": "co ne or ac go", "mx": "com net org edu gob", "ar": "com net org edu gob", "tr": "com net org edu gov", "il": "co org net ac gov", "sg": "com net org edu gov",
}
SUFFIXES = tuple(f"{label}.{country}" for country, labels in SECOND_LEVEL.items() for label in labels.split())
MAX_BAD_RATE = 0.3
Z = 1.645


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    tail = F.substring(after, F.length(F.regexp_extract(after, "^[^/?#]*", 0)) + 1, F.length(after))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(tail, "^[^?#]*", 0)).otherwise("")


def name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two where SUFFIXES has them; numeric hosts
    are their own."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike("^[0-9.]+$"), name).when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it, where there is one."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike("^[0-9.]+$"), name).when(two.isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _strength(units: DataFrame) -> DataFrame:
    """One row: mean bad rate ``mu`` and prior strength ``k`` by moments, clamped to 1..1000, from
    the units that have outcomes."""
    s = units.where("n > 0").agg(
        F.sum("n").cast("double").alias("N"), F.sum("bad").cast("double").alias("X"), F.count(F.lit(1)).cast("double").alias("M"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("N2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("X2"),
    )
    mu = F.coalesce(F.try_divide(F.col("X"), F.col("N")), F.lit(0.0))
    pq = mu * (1 - mu)
    spread = F.col("X2") - F.col("N") * mu * mu
    rho = F.try_divide(F.try_divide(spread, pq) - (F.col("M") - 1), F.col("N") - F.try_divide(F.col("N2"), F.col("N")) - (F.col("M") - 1))
    k = F.when(rho > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), 1 / rho - 1))).otherwise(1000.0)
    return s.select(mu.alias("mu"), F.coalesce(k, F.lit(1000.0)).alias("k"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad), n 0 where nothing is known, to (host, mean, low): posterior mean and lower
    bound of the bad rate. ``outcomes`` is read several times and should be a stored table."""
    hosts = outcomes.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrunk(df: DataFrame, prior: Column, keep: list) -> DataFrame:
        # a one-row aggregate: its size does not depend on the data
        return df.crossJoin(F.broadcast(_strength(df))).select(*keep, ((F.col("bad") + F.col("k") * prior) / (F.col("n") + F.col("k"))).alias("mean"), (F.col("n") + F.col("k")).alias("weight"))

    s = shrunk(suffixes, F.col("mu"), ["suffix"]).select("suffix", F.col("mean").alias("m_suffix"))
    d = shrunk(domains.join(s, "suffix"), F.col("m_suffix"), ["domain"]).select("domain", F.col("mean").alias("m_domain"))
    h = shrunk(hosts.join(d, "domain"), F.col("m_domain"), ["host"])
    low = F.greatest(F.lit(0.0), F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1)))
    return h.select("host", "mean", low.alias("low"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad_rate: float = MAX_BAD_RATE) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate) for every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) marks outcomes of pages by id: bad when quality is 0 or
    toxic is 1. Host statistics are aggregated, stored once, and then meet the pages again; that
    join is on host and leaves the splitting of a hot host to adaptive skew handling.
    """
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).fillna("", ["host", "path"])
    marks = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    # one row a page and host, so that a repeated page counts once; a page without a mark names its host only
    known = parsed.select("page_id", "host").distinct().join(marks, "page_id", "left")
    outcomes = spool(known.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    reputation = host_reputation(outcomes)
    judged = parsed.join(reputation, "host", "left")
    method = F.when(F.col("low") > max_bad_rate, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("mean", 6).alias("bad_rate"))
