"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host. A host's bad rate is a beta-binomial
posterior whose prior mean is the posterior mean of its registered domain, which is
shrunk in the same way towards its suffix, and that towards all pages. The strength of
each level's prior is estimated from how much the units of the level differ from their
parents. A page is blocked where the lower posterior bound of its host's bad rate is
above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``target`` is a host, then a path from its first slash on."""

    verdict: str
    target: str

    @property
    def host(self) -> str:
        return self.target.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.target[len(self.host):]


@dataclass(frozen=True)
class Reputation:
    """Parameters. Prior strengths are pseudo-counts and stay within [least, most].

    ``suffixes`` names suffixes of several labels (such as a second-level registry); the
    suffix of any other host is its last label. ``limit`` is the bad rate a host may
    have, ``base_rate`` the one of all pages before any outcome is seen (it weighs as two
    outcomes); ``z`` is how many posterior deviations must lie between it and the mean.
    """

    limit: float = 0.3
    base_rate: float = 0.1
    z: float = 1.645
    least: float = 2.0
    most: float = 1000.0
    suffixes: tuple[str, ...] = ()


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Of two equally long ones, a block wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.target), r.verdict == "block", r.target)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.target).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def domain_and_suffix(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Registered domain (the suffix and one label) and suffix of a host."""
    suffix = F.substring_index(host, ".", -1)
    for name in sorted(suffixes, key=len):
        suffix = F.when((host == name) | F.endswith(host, F.lit("." + name)), F.lit(name)).otherwise(suffix)
    above = F.substr(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    label = F.substring_index(above, ".", -1)
    return F.when(F.length(host) > F.length(suffix), F.concat(label, F.lit("."), suffix)).otherwise(host), suffix


def _strength(units: DataFrame, p: Reputation) -> DataFrame:
    """One row: the prior strength of a level, from units with n, bad and their parent's mean.

    The squared deviations of beta-binomial counts exceed the binomial ones by a factor
    1 + (n - 1) rho, which gives rho; the strength is 1 / rho - 1.
    """
    spread = F.col("mean") * (1 - F.col("mean"))
    seen = units.filter("n > 0")
    sums = seen.agg(F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2) / F.col("n") - spread).alias("excess"),
                    F.sum(spread * (F.col("n") - 1)).alias("room"))
    rho = F.when(F.col("room") > 0, F.col("excess") / F.col("room")).otherwise(0.0)
    bounded = F.greatest(F.lit(1 / (p.most + 1)), F.least(F.lit(1 / (p.least + 1)), rho))
    return sums.select((1 / bounded - 1).alias("k"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """One row per host of ``pages``: host, labelled, posterior_mean, posterior_low.

    ``pages`` has page_id and host; ``outcomes`` has page_id and bad (0 or 1). A page with
    several outcomes is bad if one of them is; null outcomes and ids count for nothing. A
    host without outcomes has its prior as its posterior. Without outcomes all hosts
    are at the base rate, and without pages there are no rows.
    """
    known = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"), p.suffixes)
    hosts = (pages.select("page_id", "host").join(known, "page_id", "left").groupBy("host")
             .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
             .withColumns({"domain": domain, "suffix": suffix}))
    total = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 2 * p.base_rate) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))
    parents = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(total))  # one row
    for level, child in (("suffix", "domain"), ("domain", "host")):
        shrunk = parents.crossJoin(F.broadcast(_strength(parents, p)))  # one row
        means = shrunk.select(level, ((F.col("k") * F.col("mean") + F.col("bad")) / (F.col("k") + F.col("n"))).alias("mean"))
        units = hosts if child == "host" else hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        parents = units.join(means, level)
    a = F.col("k") * F.col("mean") + F.col("bad")
    b = F.col("k") * (1 - F.col("mean")) + F.col("n") - F.col("bad")
    posterior = parents.crossJoin(F.broadcast(_strength(parents, p))).select("host", "n", a.alias("a"), b.alias("b"))  # one row
    a, b, mean = F.col("a"), F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return posterior.select("host", F.col("n").alias("labelled"), F.round(mean, 6).alias("posterior_mean"),
                            F.round(mean - p.z * deviation, 6).alias("posterior_low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), p: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict, labelled, posterior_mean, posterior_low of every page.

    Only page_id and url of ``pages`` are read, so other columns of any name do no harm.
    A null, empty or odd URL has an empty host and path, and is judged like one more
    host. Repeated rows are judged each.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    scores = host_reputation(parts, outcomes, p)
    found = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("found", found).join(scores, "host", "left")
    own = F.when(F.col("posterior_low") > p.limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"),
                         "labelled", "posterior_mean", "posterior_low")
