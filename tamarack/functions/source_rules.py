"""Column rules about web sources: category, tier, authority, quality, URL safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions.text import domain_of, has_any, on_domain


def _lower(col: Column) -> Column:
    return F.lower(F.coalesce(col, F.lit("")))


def source_category(domain: Column, substring: bool = False) -> Column:
    """Institution kind of a domain: filing, government, academic, analyst, news or other."""
    d = _lower(domain)
    government = (
        d.endswith(".gov") | d.contains(".gov.") | d.endswith(".nic.in") | on_domain(d, terms.CATALOG_GOVERNMENT, substring)
    )
    academic = (
        d.endswith(".edu") | d.contains(".edu.") | d.endswith(".ac.in") | d.endswith(".ac.uk")
        | on_domain(d, ("arxiv.org", "researchgate.net"), substring)
    )
    filing = (
        on_domain(d, ("sec.gov", "mca.gov.in", "sebi.gov.in"), substring) | d.contains("edgar") | d.startswith("investor.")
    )
    return (
        F.when(d == "", "other")
        .when(filing, "company_filing")
        .when(government, "official_government")
        .when(academic, "academic_institution")
        .when(on_domain(d, terms.CATALOG_ANALYSTS, substring), "industry_analyst")
        .when(on_domain(d, terms.CATALOG_NEWS, substring), "reputable_news")
        .otherwise("other")
    )


def source_tier(category: Column, domain: Column, url: Column, substring: bool = False) -> Column:
    """Tier of a catalogued source; social media and forums are unusable whatever their category."""
    d, u = _lower(domain), _lower(url)
    unusable = (
        on_domain(d, terms.SOCIAL_DOMAINS, substring)
        | (u.contains("/posts/") & d.contains("linkedin.com"))
        | u.contains("/r/")
        | u.contains("/forum/")
    )
    return (
        F.when(unusable, terms.TIER_5)
        .when(category.isin("official_government", "company_filing", "trade_association"), terms.TIER_1)
        .when(category.isin("academic_institution", "financial_market_research", "industry_analyst"), terms.TIER_2)
        .when(category == "reputable_news", terms.TIER_3)
        .otherwise(terms.TIER_4)
    )


def authority_score(domain: Column, category: Column, substring: bool = False) -> Column:
    """Baseline authority of a domain, 0.10 to 0.95."""
    d = _lower(domain)
    top_analyst = has_any(d, ("gartner", "idc", "forrester", "mckinsey", "bain", "bcg", "statista"))
    top_news = has_any(d, ("reuters", "bloomberg", "wsj", "ft.com"))
    return (
        F.when(d == "", 0.4)
        .when(on_domain(d, terms.SOCIAL_DOMAINS, substring), 0.10)
        .when(category == "official_government", 0.95)
        .when(category.isin("academic_institution", "company_filing"), 0.90)
        .when(category == "trade_association", 0.88)
        .when(category == "financial_market_research", 0.80)
        .when(category == "industry_analyst", F.when(top_analyst, 0.88).otherwise(0.80))
        .when(category == "reputable_news", F.when(top_news, 0.85).otherwise(0.75))
        .otherwise(0.50)
    )


def quality_base(url: Column, domain: Column, source_name: Column, substring: bool = False) -> Column:
    """``struct(base, tier)`` by the first of twelve ordered tier rules that holds."""
    d, u, n = _lower(domain), _lower(url), _lower(source_name)
    unusable = (
        on_domain(d, terms.UNUSABLE_DOMAINS, substring)
        | (u.contains("/posts/") & d.contains("linkedin.com"))
        | has_any(u, ("/r/", "/forum/", "/thread/", "yahoo.com/answers"))
    )
    if substring:
        unusable = unusable | has_any(u, ("reddit.com", "quora.com", "twitter.com", "x.com"))
    filing = (
        on_domain(d, terms.FILING_DOMAINS, substring)
        | d.rlike(r"^(?:investor|ir|investors)\.")
        | has_any(u, ("annual-report", "investor-relations", "10-k", "10-q"))
        | has_any(n, terms.FILING_NAME_TERMS)
    )
    academic = has_any(d, terms.ACADEMIC_SUBSTRINGS) | on_domain(d, terms.ACADEMIC_DOMAINS, substring)
    association = on_domain(d, terms.ASSOCIATION_DOMAINS, substring) | n.contains("trade association")

    def rated(base: float, tier: str) -> Column:
        return F.struct(F.lit(base).alias("base"), F.lit(tier).alias("tier"))

    return (
        F.when(unusable, rated(0.10, terms.TIER_5))
        .when(filing, rated(0.92, terms.TIER_1))
        .when(on_domain(d, terms.GOVERNMENT_DOMAINS, substring), rated(0.95, terms.TIER_1))
        .when(on_domain(d, terms.INTERNATIONAL_DOMAINS, substring), rated(0.90, terms.TIER_1))
        .when(association, rated(0.88, terms.TIER_1))
        .when(academic, rated(0.85, terms.TIER_2))
        .when(on_domain(d, terms.RESEARCH_DOMAINS, substring), rated(0.82, terms.TIER_2))
        .when(on_domain(d, terms.CONSULTING_DOMAINS, substring), rated(0.80, terms.TIER_2))
        .when(on_domain(d, terms.FINANCIAL_DOMAINS, substring), rated(0.78, terms.TIER_2))
        .when(on_domain(d, terms.NEWS_DOMAINS, substring), rated(0.65, terms.TIER_3))
        .otherwise(rated(0.35, terms.TIER_4))
    )


def quality_adjustment(year: Column, source_name: Column, context: Column, raw_value: Column) -> Column:
    """Sum of the bonuses and penalties that follow the tier rule, in hundredths (exact integers)."""
    c = _lower(context)
    verbatim = (
        context.isNotNull() & (context != "") & raw_value.isNotNull() & (raw_value != "") & c.contains(F.lower(raw_value))
    )
    recency = (
        F.when(year.isNull(), 0).when(year >= 2023, 3).when(year < 2018, -5).otherwise(1)
    )
    return (
        F.when(has_any(c, terms.METHODOLOGY_TERMS), 5).otherwise(0)
        - F.when(has_any(c, terms.RUMOUR_TERMS), 15).otherwise(0)
        + recency
        + F.when(F.trim(F.coalesce(source_name, F.lit(""))) != "", 2).otherwise(0)
        + F.when(verbatim, 3).otherwise(0)
    )


def quality_score(base: Column, adjustment: Column) -> Column:
    """Source quality 0..1 (unusable sources at most 0.25) from ``quality_base`` and the adjustments."""
    points = F.round(base["base"] * 100).cast("int") + adjustment
    cap = F.when(base["tier"] == terms.TIER_5, 25).otherwise(100)
    return F.least(F.greatest(points, F.lit(0)), cap) / F.lit(100.0)


# -- URL safety ---------------------------------------------------------------------------------

# Blocked IPv4 networks as (first address, last address), fixed values: private, loopback, link-local,
# shared, documentation, benchmark, multicast and reserved ranges.
_BLOCKED_IPV4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# Loopback, unspecified, mapped or translated IPv4, unique local, link-local, site-local, documentation
# and multicast forms of IPv6.
_BLOCKED_IPV6 = (
    r"^(?:::1?|0*(?::0*){7}|0*(?::0*){6}:0*1|::ffff:.*|64:ff9b:1:.*|100::.*|f[cd][0-9a-f]{2}:.*|"
    r"fe[89abcdef][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*|2001:0*:.*|2001:1?[0-9a-f]{1,2}:.*|2002:.*)$"
)


def _ip_number(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def _blocked_number(n: Column) -> Column:
    out = F.lit(False)
    for first, last in _BLOCKED_IPV4:
        out = out | n.between(_ip_number(first), _ip_number(last))
    return out


def is_safe_url(url: Column, allow_private: bool = False) -> Column:
    """Column predicate: http(s), public host, web port, no disguised or internal address.

    It looks at the text only: names are not resolved, so it does not replace a network guard.
    """
    u = F.trim(F.coalesce(url, F.lit("")))
    authority = domain_of(u)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    bracketed = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    host = F.when(host_port.startswith("["), bracketed).otherwise(F.regexp_extract(host_port, r"^([^:]*)", 1))
    port_text = F.when(
        host_port.startswith("["), F.regexp_extract(host_port, r"^\[[^\]]*\]:(.+)$", 1)
    ).otherwise(F.regexp_extract(host_port, r"^[^:]*:(.+)$", 1))
    port_ok = (port_text == "") | port_text.rlike(r"^0*(?:80|443|8080|8443)$")
    forbidden = host.isin(*terms.FORBIDDEN_HOSTS) | host.rlike(terms.alternation(terms.FORBIDDEN_SUFFIXES) + "$")

    decimal_form = host.rlike(r"^[0-9]+$")
    hex_form = host.rlike(r"^0x[0-9a-f]+$")
    number = F.when(decimal_form & (F.length(host) <= 10), host.try_cast("bigint")).when(
        hex_form & (F.length(host) <= 10), F.conv(F.substring(host, 3, 8), 16, 10).try_cast("bigint")
    )
    bad_form = (decimal_form & host.rlike(r"^0[0-9]")) | number.isNull() | (number > 4294967295)
    parts = F.split(host, r"\.")
    dotted = sum(
        (parts[i].try_cast("bigint") * (1 << shift) for i, shift in enumerate((24, 16, 8, 0))), F.lit(0)
    )
    blocked = (
        F.when(decimal_form | hex_form, bad_form | (F.lit(not allow_private) & _blocked_number(number)))
        .when(F.lit(allow_private), F.lit(False))
        .when(host.rlike(_IPV4), _blocked_number(dotted))
        .when(host.contains(":"), host.rlike(_BLOCKED_IPV6))
        .otherwise(F.lit(False))
    )
    return F.coalesce(u.rlike(r"^(?i:https?)://") & (host != "") & port_ok & ~forbidden & ~blocked, F.lit(False))
