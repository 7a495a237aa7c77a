"""URL filters: written rules first, and for the rest the reputation of the host, by empirical Bayes.

Pages with a known outcome are counted by host. A host's rate of bad pages has a beta prior centred on the rate of its
registered domain, that one on its suffix's, and that one on the rate of all pages; how much a level's groups differ
from their parents, and so how strong the prior is, is fitted to the counts by the method of moments. A host is blocked
where the lower bound of its posterior rate exceeds a threshold, so a host seen a few times is judged by its kin.
Column expressions, joins and sums only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import stored

ALLOW, BLOCK = "allow", "block"
# A host is blocked if its rate of bad pages exceeds THRESHOLD at about 95 % (Z standard deviations).
THRESHOLD, Z = 0.5, 1.645
# Bounds of the correlation of outcomes within a group; a prior weighs 1 / correlation - 1 pages.
LEAST, MOST = 0.001, 0.5
RULES_AT_MOST = 1000
LEVELS = (("suffix", None), ("domain", "suffix"), ("host", "domain"))


class Rule(NamedTuple):
    """A verdict for a host and its subdomains, where the url's path starts with `path`."""

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A to Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; NULL if none does."""
    if len(rules) > RULES_AT_MOST:
        raise ValueError(f"rules are written into the plan: {RULES_AT_MOST} at most")
    if any(rule.verdict not in (ALLOW, BLOCK) for rule in rules):
        raise ValueError("a rule allows or blocks")
    if len({rule.name for rule in rules}) < len(rules):
        raise ValueError("one verdict for a host and path")
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def domain_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """A struct of suffix and registered domain. The suffix is the last label, or the longest of `suffixes` that
    the host ends in (`co.uk`); the domain has one label more. A host of one label, or an address, is its own."""
    labels = F.split(host, r"\.")
    count = F.lit(1)
    for suffix in sorted(set(suffixes), key=lambda s: s.count(".")):
        count = F.when((host == suffix) | F.endswith(host, F.lit(f".{suffix}")), suffix.count(".") + 1).otherwise(count)

    def last(n: Column) -> Column:
        return F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n))

    address = host.rlike(r"^[0-9]+(\.[0-9]+){3}(:[0-9]*)?$")
    return F.struct(F.when(address, F.lit("")).otherwise(last(count)).alias("suffix"),
                    F.when(address, host).otherwise(last(count + 1)).alias("domain"))


def counts(hosts: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """host, domain, suffix, pages (with a known outcome) and bad, for every host of `hosts` (page_id, host).

    Outcomes (page_id, bad) are one a page first, bad if any says so; pages that repeat an id count each. Pages of one
    id and host are added up within tasks before the join.
    """
    known = outcomes.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(
        F.max(F.col("bad").cast("int")).alias("bad"))
    pages = hosts.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("pages"))
    found = pages.join(known, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages"))), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(F.col("pages") * F.col("bad")), F.lit(0)).alias("bad"))
    place = domain_of(F.col("host"), suffixes)
    return found.select("host", place["domain"].alias("domain"), place["suffix"].alias("suffix"), "pages", "bad")


def _fitted_weight(groups: DataFrame) -> float:
    """How many pages the groups' priors weigh, from their counts around `centre`; one row reaches the driver."""
    n, m = F.col("pages").cast("double"), F.col("centre")
    noise = m * (1 - m)
    # The expected sum of n (k / n - m)^2 is the sum of m (1 - m) (1 + (n - 1) r): solve for r.
    row = groups.filter("pages > 0").agg(
        (F.sum((F.col("bad") - n * m) * (F.col("bad") - n * m) / n) - F.sum(noise)).alias("over"),
        F.sum((n - 1) * noise).alias("room")).first()
    correlation = row["over"] / row["room"] if row["room"] else LEAST
    return 1 / min(max(correlation, LEAST), MOST) - 1


def reputations(hosts: DataFrame, z: float = Z) -> DataFrame:
    """host, pages, bad, rate and lower (the posterior mean of the rate of bad pages and its lower bound).

    A group's prior leaves its own pages out of its parent's, so that no page counts twice.
    """
    every = hosts.agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad")).first()
    # The rate of all pages starts from one page, half of it bad.
    up = {"up_centre": 0.5, "up_weight": 1.0, "up_pages": every["pages"] or 0, "up_bad": every["bad"] or 0}
    above = None
    for name, parent in LEVELS:
        keys = [name, parent] if parent else [name]
        groups = hosts.groupBy(*keys).agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"))
        joined = groups.join(above, parent) if parent else groups.withColumns({k: F.lit(v) for k, v in up.items()})
        centre = (F.col("up_weight") * F.col("up_centre") + F.col("up_bad") - F.col("bad")) / (
            F.col("up_weight") + F.col("up_pages") - F.col("pages"))
        level = stored(joined.select(*keys, "pages", "bad", centre.alias("centre")), f"urls-{name}")
        weight = _fitted_weight(level)
        above = level.select(
            name, F.col("centre").alias("up_centre"), F.lit(weight).alias("up_weight"), F.col("pages").alias("up_pages"),
            F.col("bad").alias("up_bad"))
    total = F.col("up_weight") + F.col("up_pages")
    rate = (F.col("up_weight") * F.col("up_centre") + F.col("up_bad")) / total
    return above.select("host", F.col("up_pages").alias("pages"), F.col("up_bad").alias("bad"), rate.alias("rate"),
                        (rate - z * F.sqrt(rate * (1 - rate) / (total + 1))).alias("lower"))


def judge(pages: DataFrame, rules: list[Rule], outcomes: DataFrame, threshold: float = THRESHOLD, z: float = Z,
          suffixes: tuple[str, ...] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, rate and lower for every row of `pages` (page_id, url).

    The longest rule that fits decides; where none does, a page is blocked if its host's lower bound exceeds
    `threshold`. `outcomes` (page_id, bad) may be empty, or name pages that are not there; no outcome at all blocks
    nothing. A url that is NULL or lacks `://` has an empty host and path, and is judged like any other host without
    outcomes. Rows repeat as given, other columns are not read, an empty table gives no rows.
    """
    url = F.col("url").cast("string")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = reputations(stored(counts(split.select("page_id", "host"), outcomes, suffixes), "urls-counts"), z)
    chosen = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.join(known.select("host", "rate", "lower"), "host", "left")
    return judged.select(
        "page_id", "host", "path", chosen["rule"].alias("rule"),
        F.coalesce(chosen["verdict"], F.when(F.col("lower") > threshold, BLOCK).otherwise(ALLOW)).alias("verdict"),
        "rate", "lower")
