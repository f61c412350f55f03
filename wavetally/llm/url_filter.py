"""URL filter: host and path rules, and an empirical-Bayes reputation of hosts.

Rules decide the pages that they fit, and label them: blocked or allowed. A page that
no rule fits has no label and is judged by its host. Rates of blocked labels are shrunk
by beta-binomial priors: a host's prior is the posterior of its registered domain (one
label under the public suffix), whose prior is that of its suffix, whose prior is the
rate of all labels (of them one more of each kind). The strength of each prior is estimated by moments from the spread
of the rates at that level. A host is blocked when the lower bound of its posterior
exceeds the limit; a host without labels has its domain's posterior.

Defined cases: a null url or one without "://" has an empty host and path, fits no
rule and is allowed, as is every page without a rule where no page has a label; repeated
rows are labels each; a url of any length is read whole; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import lower_ascii

#: (host and path prefix, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
Z, LIMIT = 1.645, 0.5
# Public suffixes of two labels (of the published list, those of many sites).
SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp or.jp ne.jp co.kr com.br com.cn com.tw com.mx com.ar com.tr co.in co.za co.il".split()
#: Labels that a prior counts for, at least and at most.
LEAST, MOST = 2.0, 1000.0


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as its text; null if none does."""
    found = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        found.append(F.when(((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}"), F.lit(rule)))
    return F.coalesce(*found)


def _strength(column: str) -> Column:
    """Prior strength by moments: m (1 - m) / variance of the groups' rates - 1, within bounds; no prior
    counts for more than all labels. Groups: bad of n labels."""
    m = F.sum("bad") / F.sum("n")
    second = F.sum(F.col("bad") * F.col("bad") / F.nullif(F.col("n"), F.lit(0))) / F.sum("n")
    variance = second - m * m
    fit = F.when(variance > 1e-12, m * (1 - m) / variance - 1).otherwise(F.lit(MOST))
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.least(fit, F.sum("n")))).alias(column)


def registered(hosts: DataFrame) -> DataFrame:
    """hosts (column host) with suffix and domain, the suffix with the label before it."""
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    own = hosts.withColumn("width", F.when(two.isin(*SUFFIXES), 2).otherwise(1))
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
    return own.withColumns({"suffix": last(F.col("width")), "domain": last(F.col("width") + 1)}).drop("width")


def reputations(judged: DataFrame) -> DataFrame:
    """host, bound: the lower posterior bound of its block rate. judged: host, outcome (0 or 1, null: no label)."""
    summed = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    per_host = registered(judged.where(F.col("host") != "").groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad")))
    per_domain = per_host.groupBy("suffix", "domain").agg(*summed)
    per_suffix = per_domain.groupBy("suffix").agg(*summed)
    root = per_suffix.agg(_strength("k_suffix"), ((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("m_all"))
    # One row each: the levels' strengths and the overall rate.
    fixed = F.broadcast(root.crossJoin(per_domain.agg(_strength("k_domain"))).crossJoin(per_host.agg(_strength("k_host"))))
    posterior = lambda k, prior: (F.col("bad") + F.col(k) * F.col(prior)) / (F.col("n") + F.col(k))
    suffix = per_suffix.crossJoin(fixed).select("suffix", "k_domain", "k_host", posterior("k_suffix", "m_all").alias("m_suffix"))
    domain = per_domain.join(suffix, "suffix").select("domain", "k_host", posterior("k_domain", "m_suffix").alias("m_domain"))
    host = per_host.join(domain, "domain").withColumn("mean", posterior("k_host", "m_domain"))
    mean = F.col("mean")
    return host.select("host", (mean - Z * F.sqrt(mean * (1 - mean) / (F.col("n") + F.col("k_host") + 1))).alias("bound"))


def judge(pages: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict: the rule's verdict, else the host's."""
    verdicts = dict(rules)
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in verdicts.items()])
    ruled = seen.withColumn("ruled", by_rule)
    bad = reputations(ruled.select("host", (F.col("ruled") == "block").cast("int").alias("outcome"))).where(F.col("bound") > limit)
    found = ruled.join(bad.select("host", F.lit("block").alias("by_host")), "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))
