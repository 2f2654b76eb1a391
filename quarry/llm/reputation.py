"""URL filters: explicit rules, else an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix. At each
level a rate's prior is a beta distribution around its parent's posterior mean; how strong it is
follows from the spread of the level's rates beyond binomial noise (method of moments). A url is
blocked if the lower posterior bound of its host's bad rate exceeds a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public suffixes of two labels, if no others are given: fixed values.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "co.in", "com.br", "com.mx", "com.cn", "com.tr")
#: Largest bad rate kept, standard deviations below the mean that count, bounds of a prior's strength.
MOST_BAD, DEVIATIONS, STRENGTHS = 0.25, 1.645, (1.0, 1000.0)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, ?, # or the end, with A-Z folded; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: of suffixes of two labels, that which the host ends with, else its last label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the public suffix and one label more, or the host if it has no more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]], part: int) -> Column:
    """Of the longest rule that fits, its action (part 0) or itself (part 1); null if none fits. A rule
    is (action, host and path); it fits its host and all subdomains, if the path starts with its own."""
    out = F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit((action, rule)[part])).otherwise(out)
    return out


def _strength(level: DataFrame) -> DataFrame:
    """One row: the overall rate, and the strength of the prior of this level's rates."""
    total = level.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("k"),
                      F.sum(F.when(F.col("n") > 0, F.col("bad") * F.col("bad") / F.col("n"))).alias("sq"))
    rate = F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0)  # without labels nothing is held bad
    spread = F.coalesce(F.col("sq") / F.col("n") - rate * rate - rate * (1 - rate) * F.col("k") / F.col("n"), F.lit(0.0))
    strength = F.when(spread > 0, rate * (1 - rate) / F.nullif(spread, F.lit(0.0)) - 1).otherwise(STRENGTHS[1])
    return total.select(rate.alias("rate"), F.greatest(F.lit(STRENGTHS[0]), F.least(F.lit(STRENGTHS[1]), strength)).alias("strength"))


def host_reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, bad, posterior, bound) for every host of outcomes (host, bad): bad is 1, 0, or null
    for a page without a label. Only counts are shuffled, summed before; a null host is left out."""
    hosts = outcomes.where("host is not null").groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")
    )
    hosts = hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    sums = lambda frame, *by: frame.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = sums(hosts, "domain", "suffix")
    suffixes = sums(domains, "suffix")

    def shrunk(level: DataFrame, prior: Column) -> DataFrame:
        told = F.broadcast(_strength(level))  # one row
        return level.crossJoin(told).withColumn("_prior", prior).withColumn(
            "posterior", (F.col("bad") + F.col("strength") * F.col("_prior")) / (F.col("n") + F.col("strength"))
        )

    up = shrunk(suffixes, F.col("rate")).select("suffix", F.col("posterior").alias("suffix_rate"))
    mid = shrunk(domains.join(up, "suffix"), F.col("suffix_rate")).select("domain", "suffix", F.col("posterior").alias("domain_rate"))
    own = shrunk(hosts.join(mid, ["domain", "suffix"]), F.col("domain_rate"))
    mean, size = F.col("posterior"), F.col("n") + F.col("strength")
    bound = mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (size + 1))
    return own.select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), "posterior", bound.alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, posterior, bound) for every row of pages. outcomes: (id, bad),
    one row at most for each id; suffixes: public suffixes of two labels. Null urls and urls without :// have an empty host and path."""
    own = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labelled = own.join(outcomes.select("id", "bad"), "id", "left")
    known = host_reputation(labelled, suffixes)
    rule = rule_of(F.col("host"), F.col("path"), rules, 1)
    action = rule_of(F.col("host"), F.col("path"), rules, 0)
    learnt = F.when(F.col("bound") > MOST_BAD, "block").otherwise("allow")
    return own.join(known, "host", "left").select(
        "id", "host", "path", rule.alias("rule"), F.coalesce(action, learnt).alias("verdict"), "posterior", "bound"
    )
