"""URL filter: empirical-Bayes host reputation behind a list of path rules.

Labelled page outcomes (bad or not) are counted by host. A beta-binomial model shrinks them
level by level: the corpus mean is the prior of every suffix, a suffix's posterior mean the prior
of its registered domains, a domain's the prior of its hosts. Each level's prior strength is
fitted by moments from the spread of its own groups. A host is blocked when the lower posterior
bound of its bad rate (mean less ``z`` deviations) passes ``threshold``, so a host with few labels
is judged by its domain, and one without any by its suffix.

Everything is JVM-side. Pages are pre-aggregated by host before anything is shuffled, the host
table is written once, and it meets the pages in one equi-join that AQE may split where a host is
hot (both sides are plain exchanges).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: (rule, verdict): fixed values of the query's contract.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; '' for null or without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def bare_of(host: Column) -> Column:
    """The name alone, without user and port: hosts that differ in those share one reputation."""
    return F.regexp_replace(host, F.lit(r"^.*@|:[0-9]*$"), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The longest of ``suffixes`` (of several labels, like co.uk) that ends the host, else the last label."""
    out = F.substring_index(host, ".", -1)
    for s in sorted(set(suffixes), key=lambda s: (len(s), s)):
        out = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(out)
    return out


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """Registered domain: the suffix and one label more (the whole host where there is none)."""
    out = F.substring_index(host, ".", -2)
    for s in sorted(set(suffixes), key=lambda s: (len(s), s)):
        out = F.when((host == s) | host.endswith("." + s), F.substring_index(host, ".", -s.count(".") - 2)).otherwise(out)
    return out


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The longest fitting rule (value 0) or its verdict (value 1); null where none fits."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = rule[0].partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule[value])) if out is None else out.when(fits, F.lit(rule[value]))
    return F.lit(None).cast("string") if out is None else out


def _moments(groups: DataFrame) -> tuple[float, float]:
    """Mean and prior strength of a level, by moments, from its rows (n, bad)."""
    n, bad = F.col("n"), F.col("bad")
    s = groups.where("n > 0").agg(
        F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.count(F.lit(1)).alias("m"),
        F.sum(n * n).cast("double").alias("nn"), F.sum(bad * bad / n).alias("spread"),
    ).first()
    if not s["n"]:
        return 0.5, 1.0
    total, bad_n, m = float(s["n"]), float(s["bad"]), float(s["m"])
    p = bad_n / total
    noise = p * (1 - p)
    room = total - s["nn"] / total - (m - 1)
    if m < 2 or noise <= 0 or room <= 0:
        return (bad_n + 0.5) / (total + 1), 1.0
    rho = (s["spread"] - total * p * p - noise * (m - 1)) / (noise * room)
    rho = min(max(rho, 1e-4), 0.9)
    return (bad_n + 0.5) / (total + 1), (1 - rho) / rho


def host_reputation(labelled: DataFrame, host: str = "host", bad: str = "bad", z: float = 1.64, suffixes: Sequence[str] = ()) -> DataFrame:
    """Posterior of every host of ``labelled``, without user and port: host, n, bad, mean, lower.

    ``bad`` is 1, 0 or null (a page without label: its host gets a row, no count). A null host
    counts as ''. Repeated rows count each. An empty table gives an empty result.
    """
    hosts = materialize(
        labelled.select(bare_of(F.coalesce(F.col(host), F.lit(""))).alias("host"), F.col(bad).cast("long").alias("y"))
        .groupBy("host").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")),
        "hosts",
    ).select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "bad")
    counts = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(counts(hosts, "domain", "suffix"), "domains")
    suffixes = materialize(counts(domains, "suffix"), "suffixes")
    (m0, k_suffix), (_, k_domain), (_, k_host) = _moments(suffixes), _moments(domains), _moments(hosts)
    post = lambda k, m: (F.col("bad") + k * m) / (F.col("n") + k)
    suffixes = suffixes.select("suffix", post(F.lit(k_suffix), F.lit(m0)).alias("m_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", post(F.lit(k_domain), F.col("m_suffix")).alias("m_domain"))
    a = F.col("bad") + F.lit(k_host) * F.col("m_domain")
    b = F.col("n") - F.col("bad") + F.lit(k_host) * (1 - F.col("m_domain"))
    return (
        hosts.join(domains, "domain").withColumn("a", a).withColumn("b", b)
        .withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
        .withColumn("lower", F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1)))
        .select("host", "n", "bad", "mean", "lower")
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None,
          page_id: str = "page_id", url: str = "url", threshold: float = 0.5, z: float = 1.64, suffixes: Sequence[str] = ()) -> DataFrame:
    """Verdict of every row of ``pages``: page_id, host, path, rule, verdict, bad_rate, bad_rate_low.

    A page that a rule fits takes the rule's verdict and is itself a labelled outcome; ``labels``
    (page_id, bad) adds outcomes of other pages. Null urls and urls without ``://`` have an empty
    host and path; they share one reputation. ``suffixes`` are those of several labels, under which
    domains are registered. Repeated rows are judged each; an empty table gives an empty result.
    """
    p = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    p = p.select("*", rule_for(F.col("host"), F.col("path"), rules, 0).alias("rule"), rule_for(F.col("host"), F.col("path"), rules, 1).alias("said"))
    seen = p.select("page_id", "host", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0).alias("bad"))
    if labels is not None:
        own = labels.groupBy(F.col("page_id").alias("page_id")).agg(F.max("bad").alias("told"))
        seen = seen.join(own, "page_id", "left").select("host", F.coalesce("bad", "told").alias("bad"))
    seen = host_reputation(seen, z=z, suffixes=suffixes)
    method = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return p.join(seen.select(F.col("host").alias("bare"), "mean", "lower"), bare_of(F.col("host")) == F.col("bare"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"),
        F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_low"),
    )
