"""Source rules as a table: which kind of institution stands behind a host, and how much its word counts.

A rule names a domain of any number of labels; it holds for hosts in which these labels stand one after the other. The
distinct hosts are exploded to their runs of labels, which meet the rules in an equality join; the rule that comes
first wins. What a URL or a name tells beyond the host (paths of forums, words of filings) stays a column rule with a
place in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions.text import has_any

RULES_DDL = "domain string, kind string, priority int, base double, tier string"

# Kinds of sources in the order in which they are asked, their base score and tier.
KINDS = (
    ("unusable", 0.10, terms.TIER_5), ("filing", 0.92, terms.TIER_1), ("government", 0.95, terms.TIER_1), ("international", 0.90, terms.TIER_1),
    ("association", 0.88, terms.TIER_1), ("academic", 0.85, terms.TIER_2), ("research", 0.82, terms.TIER_2), ("consulting", 0.80, terms.TIER_2),
    ("financial", 0.78, terms.TIER_2), ("news", 0.65, terms.TIER_3), ("blog", 0.35, terms.TIER_4), ("general", 0.35, terms.TIER_4),
)
_DOMAINS = {
    "unusable": terms.UNUSABLE_DOMAINS, "filing": terms.FILING_DOMAINS, "government": terms.GOVERNMENT_DOMAINS, "international": terms.INTERNATIONAL_DOMAINS,
    "association": terms.ASSOCIATION_DOMAINS, "academic": terms.ACADEMIC_DOMAINS, "research": terms.RESEARCH_DOMAINS, "consulting": terms.CONSULTING_DOMAINS,
    "financial": terms.FINANCIAL_DOMAINS, "news": terms.NEWS_DOMAINS, "blog": terms.BLOG_DOMAINS,
}


def default_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules (``RULES_DDL``); a caller may add rows, or give a table of its own."""
    rows = [(d, kind, i, base, tier) for i, (kind, base, tier) in enumerate(KINDS) for d in _DOMAINS.get(kind, ())]
    return spark.createDataFrame(rows, RULES_DDL)


def rate_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``domain`` and ``rule`` (struct of priority, kind, base and tier) of the hosts that a rule holds for.

    ``hosts`` has ``domain``, in lower case, with or without a port. Rules of equal priority go by kind, then base and tier.
    """
    longest = rules.agg(F.max(F.size(F.split("domain", r"\.")))).first()[0] or 1
    labels = F.split(F.regexp_replace("domain", ":[0-9]*$", ""), r"\.")
    starts = F.sequence(F.lit(1), F.size("_labels"))
    runs = F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_labels") - i + 1)), lambda n: F.array_join(F.slice("_labels", i, n), ".")))
    exploded = hosts.select("domain").distinct().withColumn("_labels", labels).select("domain", F.explode(F.array_distinct(F.flatten(runs))).alias("_run"))
    rule = F.struct(F.col("priority"), F.col("kind"), F.col("base"), F.col("tier"))
    named = rules.select(F.lower("domain").alias("_run"), rule.alias("rule")).filter(F.col("rule.priority").isNotNull())
    return exploded.join(named, "_run").groupBy("domain").agg(F.min("rule").alias("rule"))


def _rule(kind: str) -> Column:
    i, (name, base, tier) = next((i, k) for i, k in enumerate(KINDS) if k[0] == kind)
    return F.struct(F.lit(i).alias("priority"), F.lit(name).alias("kind"), F.lit(base).alias("base"), F.lit(tier).alias("tier"))


def rule_beyond_host(url: Column, domain: Column, source_name: Column) -> Column:
    """The first rule that holds by paths, words of a host or the name of a source; ``general`` if none does."""
    d, u, n = (F.lower(F.coalesce(c, F.lit(""))) for c in (domain, url, source_name))
    forum = (u.contains("/posts/") & d.contains("linkedin.com")) | has_any(u, ("/r/", "/forum/", "/thread/", "yahoo.com/answers"))
    filing = d.rlike(r"^(?:investor|ir|investors)\.") | has_any(u, ("annual-report", "investor-relations", "10-k", "10-q")) | has_any(n, terms.FILING_NAME_TERMS)
    return (
        F.when(forum, _rule("unusable")).when(filing, _rule("filing")).when(n.contains("trade association"), _rule("association"))
        .when(has_any(d, terms.ACADEMIC_SUBSTRINGS), _rule("academic")).otherwise(_rule("general"))
    )


def rate_sources(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Add ``source_rule`` (struct of priority, kind, base and tier) to rows with domain, source_url and source_name."""
    rated = rate_hosts(rows, default_rules(rows.sparkSession) if rules is None else rules)
    beyond = rule_beyond_host(F.col("source_url"), F.col("domain"), F.col("source_name"))
    return rows.join(rated, "domain", "left").withColumn("source_rule", F.least("rule", beyond)).drop("rule")
