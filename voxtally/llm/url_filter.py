"""URL filtering: explicit rules first, then empirical-Bayes host reputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import ascii_lower

# Suffixes of two labels under which names are registered; all others have one.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au",
                      "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn", "co.in",
                      "co.za", "com.mx", "com.tr")


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a scheme."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The public suffix of a host without its port: one label, or a listed pair."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    n = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the ``(verdict, "host/path")`` rules that fits, as a struct, else NULL.

    A rule fits its host and all subdomains if the path starts with its path;
    of equally long ones the first listed wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = (((host == rule_host) | host.endswith("." + rule_host))
                & path.startswith(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def prior_strength(counts: DataFrame, n: str = "n", k: str = "k") -> Column:
    """Beta prior strength of a level, by the method of moments over its units.

    Between-unit variance in excess of binomial noise; as an aggregate of
    ``counts``, clipped to 1..1000.
    """
    total, good = F.sum(n), F.sum(k)
    p = F.try_divide(good, total)
    noise = p * (1 - p)
    spread = F.sum(F.try_divide(F.col(k) * F.col(k), F.col(n))) - good * p
    between = F.try_divide(spread - noise * (F.count(n) - 1),
                           total - F.try_divide(F.sum(F.col(n) * F.col(n)), total))
    rho = F.try_divide(between, noise)
    # without a spread to measure, units are taken to be alike
    return F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(
        F.when(rho <= 0, 1000.0).otherwise(F.try_divide(F.lit(1.0), rho) - 1), F.lit(1000.0))))


def host_reputation(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id",
                    url: str = "url", good: str = "good", z: float = 1.645) -> DataFrame:
    """One row per host: ``host, n, k, mean, upper`` of its rate of good pages.

    ``outcomes`` holds one boolean per labelled page id; NULL is unlabelled.
    The rate of a suffix is shrunk to the overall rate, that of a registered
    domain to its suffix's, that of a host to its domain's; each level's prior
    strength is estimated from the spread of its units (``prior_strength``).
    ``upper`` is the posterior mean plus ``z`` posterior standard deviations.
    Without any labels all rates are 1/2. A page listed twice counts twice.
    """
    seen = outcomes.select(F.col(page_id), F.col(good).cast("int").alias("_good"))
    hosts = stage(
        pages.select(F.col(page_id), host_of(F.col(url)).alias("host"))
        .join(seen, page_id, "left")
        .groupBy("host").agg(F.count("_good").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("k"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host"))))
    labelled = hosts.filter("n > 0")
    level = lambda key: labelled.groupBy(key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # one row each: the overall rate and the strengths of the three levels
    top = labelled.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), prior_strength(labelled).alias("s")).first()
    rate = (top["k"] / top["n"]) if top["n"] else 0.5
    strength = {"host": top["s"], **{key: level(key).agg(prior_strength(labelled).alias("s")).first()["s"]
                                     for key in ("domain", "suffix")}}

    def shrunk(n: Column, k: Column, mean: Column, s: float) -> Column:
        return (F.coalesce(k, F.lit(0)) + s * mean) / (F.coalesce(n, F.lit(0)) + s)

    suffixes = level("suffix").select("suffix", F.col("n").alias("n_s"), F.col("k").alias("k_s"))
    domains = level("domain").select("domain", F.col("n").alias("n_d"), F.col("k").alias("k_d"))
    mean_s = shrunk(F.col("n_s"), F.col("k_s"), F.lit(rate), strength["suffix"])
    mean_d = shrunk(F.col("n_d"), F.col("k_d"), mean_s, strength["domain"])
    a = F.col("k") + strength["host"] * F.col("_mean_d")
    total = F.col("n") + F.lit(strength["host"])
    mean = a / total
    return (hosts.join(suffixes, "suffix", "left").join(domains, "domain", "left")
            .withColumn("_mean_d", mean_d)
            .select("host", "n", "k", mean.alias("mean"),
                    (mean + z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("upper")))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]],
                page_id: str = "page_id", url: str = "url", good: str = "good",
                cutoff: float = 0.5, z: float = 1.645) -> DataFrame:
    """Judge every page: ``page_id, host, path, rule, verdict``.

    The longest fitting rule decides. Otherwise a page is blocked when the
    upper posterior bound of its host's good rate lies below ``cutoff``, so a
    host is blocked only on evidence. One row per input row, repeated ones
    included; a NULL url or one without ``://`` has empty host and path, which
    form a host of their own. Other columns are ignored. Empty in, empty out.
    """
    reputation = stage(host_reputation(pages, outcomes, page_id, url, good, z).select("host", "upper"))
    judged = pages.select(F.col(page_id), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    return (judged.join(reputation, "host", "left").withColumn("_found", found)
            .select(page_id, "host", "path", F.col("_found.rule").alias("rule"),
                    F.coalesce(F.col("_found.verdict"),
                               F.when(F.col("upper") < cutoff, "block").otherwise("allow")).alias("verdict")))
