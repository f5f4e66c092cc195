"""URL filters: stated rules, and an empirical-Bayes reputation of hosts for all other urls; DataFrame functions alone.

Labelled page outcomes are counted for each host. A beta-binomial prior shrinks the rate of bad pages: that of a host
toward its registered domain, that of a domain toward its suffix, that of a suffix toward the rate of all. The strength
of each prior comes from the moments of its level. A host is blocked where the lower bound of its posterior rate is above
max_bad. A host without labelled pages has the rate of its domain, and so on upward; without any labels nothing is
blocked. Null urls and urls without :// have an empty host and path.

Levels are taken from the host without user information and port. The suffix is the last label, or the last two where
the last has two letters and the one before is in SECOND_LEVEL (so x.co.uk has the suffix co.uk); the domain is one
label more. An IP address is a domain and a suffix of its own, and so is the empty host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treescan.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (verdict, host and path)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
USER, PORT = "(?s)^.*@", ":[0-9]*$"
ADDRESS = r"^([0-9]+[.]){3}[0-9]+$|^\[.*\]$"
TWO_LABELS = f"(^|[.])(({'|'.join(SECOND_LEVEL)})[.][a-z][a-z])$"
#: The least and the largest intra-class correlation of a level.
RHO = (0.0001, 0.5)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule whose host is the host or a parent of it and whose path starts the path; null without one."""
    chain = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chain = F.when(fits, F.lit(rule)) if chain is None else chain.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if chain is None else chain


def levels_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    name = F.regexp_replace(F.regexp_replace(host, USER, ""), PORT, "")
    suffix = F.coalesce(F.nullif(F.regexp_extract(name, TWO_LABELS, 2), F.lit("")), F.regexp_extract(name, "[^.]*$", 0))
    rest = F.left(name, F.length(name) - F.length(suffix) - 1)
    domain = F.when(F.length(name) <= F.length(suffix), suffix).otherwise(F.concat(F.regexp_extract(rest, "[^.]*$", 0), F.lit("."), suffix))
    address = name.rlike(ADDRESS)
    return F.when(address, name).otherwise(domain), F.when(address, name).otherwise(suffix)


def _strength(rates: DataFrame) -> float:
    """Strength of a level's prior, of rows n, bad and m (the mean above): 1 / rho - 1 with rho from moments."""
    spread = F.col("m") * (1 - F.col("m"))
    got = rates.where("n > 0").agg(F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2 / F.col("n")).alias("s"), F.sum(spread).alias("e"), F.sum(spread * (F.col("n") - 1)).alias("d")).first()
    rho = (got["s"] - got["e"]) / got["d"] if got["d"] else 0.0
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def reputations(outcomes: DataFrame, *, max_bad: float = 0.2, z: float = 1.645) -> DataFrame:
    """outcomes: a row for each page with host and bad (1, 0, or null where not labelled) to a row for each host:
    n, bad, rate (posterior mean), low (lower bound), blocked."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = levels_of(F.col("host"))
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total["n"]:
        return hosts.select("host", "n", "bad", F.lit(0.0).alias("rate"), F.lit(0.0).alias("low"), F.lit(False).alias("blocked"))
    shrunk = lambda k: (k * F.col("m") + F.col("bad")) / (k + F.col("n"))
    suffixes = suffixes.withColumn("m", F.lit(total["bad"] / total["n"]))
    suffix_rate = suffixes.select("suffix", shrunk(_strength(suffixes)).alias("m"))
    domains = domains.join(suffix_rate, "suffix")
    domain_rate = domains.select("domain", shrunk(_strength(domains)).alias("m"))
    hosts = hosts.join(domain_rate, "domain")
    k = _strength(hosts)
    rate = shrunk(k)
    low = rate - z * F.sqrt(rate * (1 - rate) / (k + F.col("n") + 1))
    return hosts.select("host", "n", "bad", rate.alias("rate"), low.alias("low"), (low > max_bad).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", max_bad: float = 0.2, z: float = 1.645) -> DataFrame:
    """id, host, path, rule, verdict for each row of pages; outcomes as in reputations()."""
    parts = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = reputations(outcomes, max_bad=max_bad, z=z).select("host", "blocked")
    found = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(known, "host", "left")
    blocks = [r for v, r in rules if v == "block"]
    by_rule = F.when(F.col("rule").isin(blocks), F.lit("block")).otherwise(F.lit("allow")) if blocks else F.lit("allow")
    return found.select(id_col, "host", "path", "rule", F.when(F.col("rule").isNotNull(), by_rule).when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
