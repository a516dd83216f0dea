"""URL filters: fixed host and path rules, then empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (bad or not) are counted by host, and shrunk level by level: the prior of a suffix is the overall rate, of a registered domain its
suffix's posterior mean, of a host its domain's. The strength of each level's beta prior comes from the spread between its groups (method of moments for the
beta-binomial law). A host is blocked if a lower bound of its posterior rate of bad pages is above a limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, sized_join


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed rules of the contract.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels that belong to the suffix under a country's two letters.
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]
LEAST_RHO, MOST_RHO = 0.001, 0.999


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Suffix (the last label, or two under a country code) and registered domain (one label more) of a host.

    A port is left out. An address of four numbers is a domain of its own, under the suffix `address`.
    """
    host = F.regexp_replace(host, ":[0-9]*$", "")
    address = host.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    label = lambda k: F.when(n >= k, F.element_at(labels, -k)).otherwise(F.lit(""))
    two = (n >= 3) & (F.length(label(1)) == 2) & label(2).isin(SECOND)
    last = lambda k: F.substring_index(host, ".", -k)
    suffix, domain = F.when(two, last(2)).otherwise(last(1)), F.when(two, last(3)).otherwise(last(2))
    return F.when(address, F.lit("address")).otherwise(suffix), F.when(address, host).otherwise(domain)


def _strength(groups: DataFrame, prior: str) -> float:
    """Strength of the beta prior, from the spread of bad counts about n * prior. One row of sums reaches the driver."""
    v = F.col(prior) * (1 - F.col(prior))
    s = groups.agg(F.sum(F.pow(F.col("bad") - F.col("n") * F.col(prior), 2.0)).alias("s"), F.sum(F.col("n") * v).alias("a"), F.sum(F.col("n") * (F.col("n") - 1) * v).alias("b")).first()
    rho = (s["s"] - s["a"]) / s["b"] if s["b"] else MOST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad, mean, low, pages) from outcomes (host, bad; a null bad is an unlabelled page): posterior mean and lower bound.

    Every host gets a row. Pages are pre-aggregated by host, so no group is gathered.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("pages"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = materialize(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    level, prior = None, None
    for key in ("suffix", "domain", "host"):
        groups = hosts.groupBy("suffix", *(["domain"] if key != "suffix" else []), *(["host"] if key == "host" else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("pages").alias("pages"))
        above = groups.withColumn("prior", F.lit(rate)) if level is None else groups.join(level.select(*prior, F.col("mean").alias("prior")), prior)
        k = _strength(above, "prior")
        level, prior = above.withColumn("mean", (F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).withColumn("k", F.lit(k)), ["suffix", "domain"][: 1 if key == "suffix" else 2]
    size = F.col("n") + F.col("k")
    return level.select("host", "n", "bad", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("low"), "pages")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", block_above: float = 0.15, z: float = 1.645) -> DataFrame:
    """(id_col, host, path, rule, verdict, reputation) of every page.

    labels: (doc_id, quality, toxic); a page's outcome is that of the document with its id, bad if the quality is 0 or it is toxic, and
    unknown where there is none or both are null. Of several labels for an id any bad one counts.
    A rule's verdict comes first; without one, a page is blocked if the lower bound for its host is above block_above.
    Null, empty and malformed urls have an empty host and path, and that host a reputation like any other. Repeated page ids are judged row by row, each with the
    outcome of its id; a null id has none. An empty table gives an empty result. Other columns of either table are not read. Urls are read whole.
    """
    outcome = F.coalesce((F.col("quality") == 0) | (F.col("toxic") > 0), F.col("quality") == 0, F.col("toxic") > 0)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__page")).agg(F.max(outcome.cast("int")).alias("bad"))
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    outcomes = parsed.select(F.col(id_col).alias("__page"), "host").join(known, "__page", "left")
    reputation = materialize(host_reputation(outcomes, z), "reputation")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = sized_join(parsed, reputation, ["host"], "pages", pages.count())
    return judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("low") > block_above, "block").otherwise("allow")).alias("verdict"), F.col("low").alias("reputation"))
