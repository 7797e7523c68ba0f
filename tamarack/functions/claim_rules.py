"""Column rules about a single claim: metric type, noise gates, relevance, scope, suitability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions.text import has_any, is_one_of, low


def metric_type(metric: Column, unit: Column, context: Column, value: Column, mult: Column) -> Column:
    """Canonical metric type of a claim; null when none fits."""
    return metric_type_of_lowered(low(metric), low(unit), low(context), value, F.lower(mult))


# What a sentence or context is searched for when a claim in it is typed.
CONTEXT_TERMS = {
    "usage": terms.USAGE_TYPE_TERMS,
    "funding": terms.FUNDING_TERMS,
    "company_revenue": terms.COMPANY_REVENUE_TERMS,
    "plan": ("subscription", "monthly", "annual plan", "plan", "/mo", "/month"),
    "unit_pricing": terms.UNIT_PRICING_TERMS,
    "cagr": ("cagr",),
    "growth": ("growth", "yoy", "increase"),
}


def context_flags(c: Column) -> dict[str, Column]:
    """Which of :data:`CONTEXT_TERMS` occur in a lower-case text: one look per text, however many claims it holds."""
    return {name: has_any(c, words) for name, words in CONTEXT_TERMS.items()}


def metric_type_of_lowered(m: Column, u: Column, c: Column, value: Column, mult: Column) -> Column:
    """:func:`metric_type` of texts that are lower case and trimmed already."""
    return metric_type_in_context(m, u, context_flags(c), value, mult)


def metric_type_in_context(m: Column, u: Column, seen: dict[str, Column], value: Column, mult: Column) -> Column:
    """:func:`metric_type_of_lowered` with the :func:`context_flags` of the text."""

    def either(name) -> Column:
        return seen[name] | has_any(m, CONTEXT_TERMS[name])

    def named(words) -> Column:
        return has_any(u, words) | has_any(m, words)

    is_money = has_any(u, terms.CURRENCY_MARKS)
    is_large = F.coalesce(value >= terms.MACRO_SCALE, F.lit(False)) | F.coalesce(
        mult.isin(*terms.MACRO_MULTIPLIERS), F.lit(False)
    )
    is_percent = has_any(u, ("%", "percent", "pct"))
    small_price = F.when(
        either("plan"), "subscription_price"
    ).otherwise("average_price")
    return (
        F.when(either("usage") | has_any(u, terms.USAGE_TYPE_TERMS), F.lit(None).cast("string"))
        .when(either("funding") & ~has_any(m, ("market size", "industry size", "total market")), "funding_amount")
        .when(
            either("company_revenue")
            & ~has_any(m, ("market size", "industry size", "sector size", "total market")),
            "company_revenue",
        )
        .when(is_money & ~is_large, small_price)
        .when(is_money, F.when(either("unit_pricing"), "average_price").otherwise("market_size"))
        .when(is_percent & either("cagr"), "cagr")
        .when(is_percent & either("growth"), "growth_rate")
        .when(is_percent, "market_share")
        .when(named(("student", "undergraduate", "postgraduate", "pupil")), "student_count")
        .when(named(("enrollment", "registration", "enrolled")), "enrollment")
        .when(named(("user", "developer", "programmer", "coder", "engineer")), "users")
        .when(named(("household", "family", "home")), "households")
        .when(
            named(("population", "people", "citizen", "individual", "adult", "youth", "child", "teen")), "population"
        )
        .when(
            named(("customer", "buyer", "subscriber", "client", "enterprise", "company", "business", "startup",
                   "smb", "sme", "plant", "factory", "firm", "manufacturer")),
            "customer_count",
        )
    )


# -- noise gates --------------------------------------------------------------------------------


def noise_category(metric: Column, unit: Column, context: Column, value: Column) -> Column:
    """First noise gate that a claim fails, null when it passes all of them."""
    m, u, c = low(metric), low(unit), low(context)
    phone = (
        has_any(m, terms.PHONE_METRICS)
        | F.coalesce(value.between(1_000_000_000, 9_999_999_999) & u.isin("", "unit", "units"), F.lit(False))
        | c.rlike(terms.PHONE_PATTERN)
    )
    contact = has_any(m, terms.CONTACT_METRICS) | has_any(c, terms.CONTACT_TERMS)
    navigation = has_any(c, terms.NAVIGATION_TERMS) | has_any(m, terms.NAVIGATION_METRICS)
    retail = (
        u.isin(*terms.RETAIL_UNITS) & value.isNotNull()
        & (has_any(c, terms.RETAIL_TERMS) | has_any(m, terms.RETAIL_TERMS))
    )
    not_market = (
        has_any(m, terms.NON_MARKET_METRICS) | is_one_of(u, terms.CLAIM_NOISE_TERMS) | is_one_of(m, terms.CLAIM_NOISE_TERMS)
    )
    return (
        F.when(phone | contact, "NOISE_CONTACT_INFO")
        .when(navigation, "NAVIGATION_TEXT")
        .when(retail, "UNRELATED_PRICE")
        .when(not_market, "NO_MARKET_SIZING_CLAIM")
    )


def unrelated_industry(text: Column, industry: Column) -> Column:
    """Name of a foreign industry the claim belongs to, null when none (or no target industry)."""
    target = low(industry)
    out = F.when(target == "", F.lit(None).cast("string"))
    for name, keys in terms.UNRELATED_INDUSTRIES:
        out = out.when(~target.contains(name) & has_any(text, keys) & ~has_any(target, keys), name)
    return out


# -- relevance dimensions (0..100) --------------------------------------------------------------


def _word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s/,]+"), lambda w: F.length(w) > 2)


def _segments(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[/,]+"), lambda s: F.trim(s)), lambda s: s != "")


def recency_score(year: Column) -> Column:
    return (
        F.when(year.isNull(), 60.0).when(year >= 2023, 100.0).when(year >= 2020, 80.0)
        .when(year >= 2015, 50.0).otherwise(25.0)
    )


def geography_score(metric: Column, context: Column, place: Column, target: Column) -> Column:
    m, c, p, t = low(metric), low(context), low(place), low(target)
    foreign_text = F.when(p != "", p).otherwise(c)
    return (
        F.when((t == "") | t.isin("global", "worldwide", "international"), 90.0)
        .when(p.contains(t) | c.contains(t) | m.contains(t), 100.0)
        .when((t == "india") & (has_any(c, terms.HOME_CITIES) | has_any(p, terms.HOME_CITIES)), 100.0)
        .when(has_any(p, ("global", "worldwide")) | has_any(c, ("global", "worldwide")), 50.0)
        .when(has_any(foreign_text, terms.FOREIGN_PLACES) & ~t.isin("united states", "usa", "uk", "global"), 10.0)
        .otherwise(70.0)
    )


def industry_score(text: Column, industry: Column) -> Column:
    target = low(industry)
    hits = F.size(F.filter(_word_list(target), lambda w: text.contains(w)))
    return (
        F.when(target == "", 80.0)
        .when(unrelated_industry(text, industry).isNotNull(), 0.0)
        .when((hits >= 2) | text.contains(target), 95.0)
        .when(hits == 1, 75.0)
        .when(has_any(text, ("market", "industry", "sector", "revenue", "demand", "growth")), 55.0)
        .otherwise(30.0)
    )


_PLACE_WORDS = ("india", "us", "usa", "uk", "chennai", "delhi", "mumbai", "bengaluru", "global", "worldwide")


def customer_score(text: Column, customer: Column) -> Column:
    target = low(customer)
    segment_hit = F.exists(
        _segments(target), lambda s: (F.length(s) > 3) & ~s.isin(*_PLACE_WORDS) & text.contains(s)
    )
    word_hit = F.exists(
        _word_list(target),
        lambda w: ~w.isin(*_PLACE_WORDS, "and", "the", "for", "with", "target", "customer") & text.contains(w),
    )
    broad = ("population", "people", "households", "users", "consumers", "subscribers", "students", "learners",
             "education", "market")
    return (
        F.when(target == "", 75.0)
        .when(text.contains(target) | segment_hit, 100.0)
        .when(word_hit, 80.0)
        .when(has_any(text, broad), 45.0)
        .otherwise(25.0)
    )


_GENERIC_PRODUCT_WORDS = (
    "online", "platform", "affordable", "app", "service", "education", "learning", "portal",
)


def product_score(text: Column, product: Column) -> Column:
    target = low(product)
    specific = F.filter(_word_list(target), lambda w: ~w.isin(*_GENERIC_PRODUCT_WORDS))
    segment_hit = F.exists(
        _segments(target),
        lambda s: (F.length(s) > 5) & F.exists(specific, lambda k: s.contains(k)) & text.contains(s),
    )
    parent = has_any(
        text, ("total education market", "education market size", "education sector", "entire education")
    ) & ~has_any(text, ("programming", "coding", "software engineer", "developer", "computer science"))
    return (
        F.when(target == "", 75.0)
        .when(parent, 35.0)
        .when(text.contains(target) | segment_hit, 100.0)
        .when(F.exists(specific, lambda k: text.contains(k)), 85.0)
        .when(has_any(text, ("online", "digital", "e-learning", "edtech", "software", "saas")), 65.0)
        .when(has_any(text, ("market size", "market revenue", "total market", "industry revenue")), 35.0)
        .otherwise(25.0)
    )


def usefulness_score(metric: Column, unit: Column, value: Column, is_range: Column) -> Column:
    m, u = low(metric), low(unit)
    population = ("student", "user", "developer", "customer", "people", "population", "subscriber", "learner",
                  "enterprise", "household")
    return (
        F.when(value.isNull(), F.when(is_range, 75.0).otherwise(30.0))
        .when(u.isin(*terms.PERCENT_UNITS), 90.0)
        .when(has_any(m, ("market size", "revenue", "valuation", "expenditure", "spend")), 85.0)
        .when(has_any(u, population), 95.0)
        .when(has_any(m, ("price", "arpu", "subscription", "fee", "cost", "annual spend")), 90.0)
        .otherwise(65.0)
    )


def overall_relevance(industry, product, geography, customer, quality_pct, usefulness, recency) -> Column:
    """Weighted sum 20/20/15/15/15/10/5, clamped to 0..100, one decimal."""
    total = (
        industry * 20.0 + product * 20.0 + geography * 15.0 + customer * 15.0 + quality_pct * 15.0
        + usefulness * 10.0 + recency * 5.0
    ) / 100.0
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 1)


def market_scope(metric, context, unit, notes, product, customer, industry, geography) -> Column:
    """Scope of a claim, from unrelated through parent, obtainable, serviceable, addressable to adjacent."""
    m, c, u = low(metric), low(context), low(unit)
    text = F.concat_ws(" ", m, c)
    macro = has_any(text, (
        "total education market", "education market size", "entire education sector", "total healthcare market",
        "overall retail market", "total automotive industry", "total market size", "industry revenue",
        "macro market", "overall sector", "entire sector", "education sector",
    ))
    money = has_any(u, ("usd", "inr", "eur", "gbp", "billion", "crore", "million", "dollar", "rupee"))
    obtainable = (
        u.isin(*terms.PERCENT_UNITS, "share")
        | has_any(m, ("som", "obtainable", "capture", "market share", "penetration", "obtainable market", "target share"))
        | low(notes).contains("som")
    )
    serviceable = has_any(
        m, ("sam", "serviceable", "target segment", "target population", "serviceable addressable")
    ) | (
        (customer >= 80) & (product >= 80)
        & has_any(m, ("college students", "undergraduates", "subscribers", "target users", "active learners"))
    )
    addressable = (
        (product >= 80)
        | has_any(m, ("tam", "total addressable", "coding education", "programming platform", "online coding"))
        | (has_any(u, ("student", "user", "developer", "customer", "people", "population")) & (customer >= 70))
    )
    return (
        F.when(industry < 20, "Unrelated market")
        .when(geography < 25, "Adjacent market")
        .when((macro | (product <= 45)) & (product < 70) & money, "Parent market")
        .when(obtainable, "Obtainable market")
        .when(serviceable, "Serviceable market")
        .when(addressable, "Addressable market")
        .when((product >= 60) | (industry >= 70), "Relevant market")
        .otherwise("Adjacent market")
    )


# -- suitability --------------------------------------------------------------------------------

_CITIES = ("chennai", "mumbai", "delhi", "bangalore", "hyderabad", "pune")


def suitability_tests(claim, target) -> dict[str, Column]:
    """What :func:`suitability_of` asks of a claim and a business. It reads most of the answers several times.

    ``claim`` gives metric, unit, geography, year, source_context, source_url; ``target`` gives
    geography, customer_type, preferred_year.
    """
    tg = low(F.coalesce(target["geography"], F.lit("India")))
    place, m, u = low(claim["geography"]), low(claim["metric"]), low(claim["unit"])
    text = F.concat_ws(" ", m, low(claim["source_context"]), low(claim["source_url"]))
    geo = F.when(
        (place == "") | place.isin("global", "worldwide"),
        text.contains(tg) | has_any(text, _CITIES + ("india",)),
    ).otherwise(place.contains(tg) | tg.contains(place) | has_any(place, _CITIES))

    cust = low(F.coalesce(target["customer_type"], F.lit("Clinics")))
    clinic_target = has_any(cust, ("clinic", "practice"))
    clinic_named = has_any(text, ("clinic", "outpatient", "private practice", "medical practice", "primary care"))
    hospital_only = m.contains("hospital") & ~has_any(m, ("clinic", "practice", "outpatient"))
    customer = (
        F.when(clinic_target, clinic_named & ~hospital_only)
        .when(cust.contains("hospital"), has_any(text, ("hospital", "bed", "inpatient", "hims", "his")))
        .when(
            has_any(cust, ("diagnostic", "lab", "pathology")),
            has_any(text, ("diagnostic", "laboratory", "laboratories", "lab", "pathology", "pacs", "imaging")),
        )
        .when(
            has_any(cust, ("pharmacy", "chemist")), has_any(text, ("pharmacy", "pharmacies", "chemist", "drugstore"))
        )
        .otherwise(text.contains(cust))
    )
    both = F.concat_ws(" ", u, m)
    return {
        "geo": geo, "customer": customer,
        "unrelated": has_any(text, ("pet care", "meal delivery", "solar", "ev charging", "food delivery",
                                    "retail e-commerce", "gaming", "automotive")),
        "direct": has_any(text, ("clinic management", "practice management", "clinic software", "clinic saas",
                                 "emr for clinics", "outpatient clinic")) | (
            clinic_target & text.contains("clinic") & text.contains("software")),
        "billing": has_any(text, ("revenue cycle", "rcm", "medical billing", "billing software", "claims processing")),
        "adjacent": has_any(text, ("telemedicine", "ehr", "emr", "lis", "lims", "pacs", "workforce", "patient engagement")),
        "parent": has_any(text, ("healthcare it", "healthcare saas", "health tech", "digital health",
                                 "healthcare software", "hospital market", "total healthcare")),
        "small": has_any(text, ("small", "medium", "smb", "sme", "independent", "single doctor", "solo practitioner",
                                "private practice")),
        "large": has_any(text, ("enterprise hospital", "500+ beds", "multi-chain", "hospital chain", "tertiary care",
                                "corporate hospital")),
        "gap": F.abs(F.coalesce(claim["year"], F.lit(2024)) - F.coalesce(target["preferred_year"], F.lit(2025))),
        "metric_ok": (
            has_any(both, ("clinic", "hospital", "facility", "facilities", "organization", "practice", "center",
                           "doctor", "unit"))
            | has_any(both, ("inr", "usd", "price", "spend", "cost", "fee", "subscription", "arpu", "/year", "/month"))
            | has_any(m, ("market", "industry", "revenue", "spending", "tam"))
        ),
    }


def suitability_of(tests: dict[str, Column], known: Column) -> Column:
    """Six matches and a rating of a claim against a business, from its :func:`suitability_tests`.

    Without a business (``known`` false) it is MEDIUM.
    """
    geo, customer, billing, parent = (tests[k] for k in ("geo", "customer", "billing", "parent"))
    definition = (
        F.when(tests["unrelated"], "UNRELATED").when(tests["direct"], "DIRECT_MATCH").when(billing | tests["adjacent"], "RELATED_MARKET")
        .when(parent, "BROAD_PARENT_MARKET").otherwise("RELATED_MARKET")
    )
    small, large, gap, metric_ok = (tests[k] for k in ("small", "large", "gap", "metric_ok"))
    rating = (
        F.when(~geo | (definition == "UNRELATED"), "UNSUITABLE")
        .when((definition == "DIRECT_MATCH") & customer, "HIGH")
        .when(
            (definition == "RELATED_MARKET") | ~customer,
            F.when(billing | parent, "LOW").when(customer, "MEDIUM").otherwise("LOW"),
        )
        .otherwise("MEDIUM")
    )

    def field(value, default, name):
        return F.when(known, value).otherwise(F.lit(default)).alias(name)

    return F.struct(
        field(rating, "MEDIUM", "overall"),
        field(geo, True, "geographic_match"),
        field(customer, True, "customer_type_match"),
        field(definition == "DIRECT_MATCH", True, "product_market_match"),
        field(small | (~large & customer), True, "segment_match"),
        field(gap <= 3, True, "temporal_match"),
        field(metric_ok, True, "metric_match"),
        field(definition, "DIRECT_MATCH", "definition_compatibility"),
    )
