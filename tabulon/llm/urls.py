"""URL filters: rules, then empirical-Bayes reputation of hosts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, joinable
from .quality import log_gamma

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels that make a public suffix of two parts below a country's domain.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Verdict, then host and path of a rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def domains(host: Column, public_suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without its port and what precedes an @.

    The suffix is the longest of ``public_suffixes`` (such as co.uk, github.io) that fits, else two labels
    where a SECOND_LEVEL one stands below a country's, else the last label. The domain is one
    label more. A name of digits and dots, an address, is both.
    """
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    parts = F.split(name, r"\.")
    n = F.size(parts)
    deep = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL)
    labels = F.when(deep, 2).otherwise(1)
    for listed in sorted(public_suffixes, key=lambda x: (x.count("."), x)):
        labels = F.when((name == listed) | F.endswith(name, F.lit("." + listed)), listed.count(".") + 1).otherwise(labels)
    last = lambda k: F.when(name.rlike(r"^[0-9.]+$"), name).otherwise(F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), "."))
    return last(labels + 1), last(labels)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _shrunk(level: DataFrame, parent: DataFrame, own: str, above: str) -> DataFrame:
    """Adds to each node its posterior (a, b) under a beta prior around its parent's mean.

    The prior's strength is one number per level, 1 / rho - 1, with the intraclass correlation
    rho fitted by moments: the squared residuals against what binomial noise alone would give.
    """
    both = level.join(parent.select(F.col(own if above == own else above).alias(above), F.col("mean").alias("m")), above)
    noise = F.col("n") * F.col("m") * (1 - F.col("m"))
    fit = both.agg(F.sum(F.pow(F.col("bad") - F.col("n") * F.col("m"), 2) - noise).alias("extra"), F.sum(noise * (F.col("n") - 1)).alias("scale"))
    rho = F.least(F.greatest(F.coalesce(F.try_divide("extra", "scale"), F.lit(0.001)), F.lit(0.001)), F.lit(0.999))
    both = both.crossJoin(F.broadcast(fit.select((1 / rho - 1).alias("s"))))
    both = both.withColumn("a", F.col("bad") + F.col("s") * F.col("m")).withColumn("b", F.col("n") - F.col("bad") + F.col("s") * (1 - F.col("m")))
    return both.withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).drop("m", "s")


def beta_below(a: Column, b: Column, x: float) -> Column:
    """P(rate <= x) for rate ~ Beta(a, b), exact to rounding, where the mean exceeds x; 1 elsewhere, as no bound lies above x there.

    The series of the incomplete beta function, whose terms shrink from the first on; after 10
    standard deviations of a + b trials and 200 terms the rest is below rounding.
    """
    first = a * F.log(F.lit(x)) + b * F.log(F.lit(1 - x)) - F.log(a) - (log_gamma(a) + log_gamma(b) - log_gamma(a + b))
    terms = F.sequence(F.lit(0).cast("long"), (10 * F.sqrt(a + b) + 200).cast("long"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    step = lambda s, n: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * x * (a + b + n) / (a + 1 + n)).alias("term"))
    return F.when(a / (a + b) > x, F.least(F.exp(first) * F.aggregate(terms, zero, step, lambda s: s["sum"]), F.lit(1.0))).otherwise(1.0)


def reputations(outcomes: DataFrame, max_bad: float = 0.5, public_suffixes: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hosts, registered domains and suffixes with labelled pages, each as (host, domain or suffix; n, bad, mean, below).

    ``outcomes`` has host and bad (boolean, not null). Outcomes are counted per host, summed to
    registered domain, suffix and all; from the top down each node's rate is shrunk towards
    its parent's. ``below`` is the posterior probability that the rate of bad pages is at most ``max_bad``.
    """
    domain, suffix = domains(F.col("host"), public_suffixes)
    hosts = durable(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).select("*", domain.alias("domain"), suffix.alias("suffix")))
    total = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = total().select(F.lit("").alias("root"), ((F.coalesce("bad", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 1)).alias("mean"))
    suffixes = durable(_shrunk(total("suffix").withColumn("root", F.lit("")), top, "suffix", "root"))
    registered = durable(_shrunk(total("domain", "suffix"), suffixes, "domain", "suffix"))
    found = _shrunk(hosts.drop("suffix"), registered, "host", "domain")
    bounded = lambda level, own: level.select(own, "n", "bad", "mean", beta_below(F.col("a"), F.col("b"), max_bad).alias("below"))
    return bounded(found, "host"), bounded(registered, "domain"), bounded(suffixes, "suffix")


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = 0.5, doubt: float = 0.05, public_suffixes: Sequence[str] = (), key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict and the posterior that holds for the host.

    ``outcomes`` has url and bad. A rule decides where one fits, else reputation: blocked if even
    the lower posterior bound of the rate of bad pages, its quantile at ``doubt``, exceeds ``max_bad``. The reputation
    is the host's; a host without labelled pages has that of its registered domain, a domain without any that of
    its suffix, and pages on a suffix without any are allowed. Null URLs have empty host and path
    and are allowed; outcomes with a null url or bad or without a host are ignored; repeated rows are
    judged alike; empty tables are fine; other columns are ignored.
    """
    labelled = outcomes.filter("url is not null and bad is not null").select(host_and_path(F.col("url"))[0].alias("host"), "bad").filter("host <> ''")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    domain, suffix = domains(F.col("host"), public_suffixes)
    judged = parsed.select("*", domain.alias("domain"), suffix.alias("suffix"))
    levels = ("host", "domain", "suffix")
    for own, level in zip(levels, reputations(labelled, max_bad, public_suffixes)):
        known = joinable(level.select(F.col(own).alias("known"), F.struct("mean", "below").alias(f"of_{own}")))
        judged = judged.join(known, F.col(own) == F.col("known"), "left").drop("known")
    judged = judged.withColumn("found", F.coalesce(*[f"of_{own}" for own in levels]))
    learned = F.when(F.col("found.below") < doubt, "block").otherwise("allow")
    return judged.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.col("found.mean").alias("bad_rate"), F.col("found.below").alias("bad_rate_below"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes (url, bad) of the pages that ``labels`` (doc_id, quality, toxic) judges under their page_id."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    judged = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return pages.select("page_id", "url").join(judged, F.col("page_id") == F.col("doc_id")).select("url", "bad")
