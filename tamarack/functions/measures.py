"""Numeric column rules: growth, freshness, divergence, impact, pricing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions.text import has_any


def cagr(begin: Column, end: Column, years: Column) -> Column:
    """Compound annual growth rate, 4 decimals; null for a non-positive start or span or a negative end."""
    usable = (begin > 0) & (end >= 0) & (years > 0)
    return F.when(usable, F.round(F.pow(end / begin, F.lit(1.0) / years) - 1.0, 4))


def age_of(published: Column, target: Column) -> Column:
    return F.coalesce(target, F.lit(terms.DEFAULT_TARGET_YEAR)) - published


def freshness(published: Column, target: Column) -> Column:
    age = age_of(published, target)
    return (
        F.when(published.isNull(), "UNKNOWN")
        .when(age <= 2, "RECENT")
        .when(age <= 5, "MODERATELY_OLD")
        .when(age <= 10, "OLD")
        .otherwise("VERY_OLD")
    )


def freshness_age(published: Column, target: Column) -> Column:
    return F.when(published.isNotNull(), F.greatest(age_of(published, target), F.lit(0)))


def freshness_rank(category: Column) -> Column:
    """Order in which the worst freshness of several inputs is picked."""
    return (
        F.when(category == "VERY_OLD", 4).when(category == "OLD", 3).when(category == "MODERATELY_OLD", 2)
        .when(category == "UNKNOWN", 1).otherwise(0)
    )


def divergence(top_down: Column, bottom_up: Column) -> Column:
    """``struct(absolute, percent, ratio, severity)`` of two estimates; percent is against the midpoint."""
    absolute = F.round(F.abs(top_down - bottom_up), 2)
    middle = (top_down + bottom_up) / 2.0
    percent = F.when(middle > 0, F.round(absolute / middle * 100.0, 2)).otherwise(F.lit(0.0))
    smaller, larger = F.least(top_down, bottom_up), F.greatest(top_down, bottom_up)
    ratio = F.when(smaller > 0, F.round(larger / smaller, 2)).otherwise(F.lit(1.0))
    severity = (
        F.when(percent <= terms.ACCEPTABLE_DIVERGENCE, "acceptable")
        .when(percent <= terms.WARNING_DIVERGENCE, "warning")
        .otherwise("severe_divergence")
    )
    return F.when(
        top_down.isNotNull() & bottom_up.isNotNull(),
        F.struct(absolute.alias("absolute"), percent.alias("percent"), ratio.alias("ratio"), severity.alias("severity")),
    )


def assumption_impact(category: Column, is_assumption: Column) -> Column:
    return (
        F.when(category.isin(*terms.CRITICAL_CATEGORIES), F.when(is_assumption, "CRITICAL").otherwise("HIGH_IMPACT"))
        .when(category.isin(*terms.HIGH_CATEGORIES), F.when(is_assumption, "HIGH_IMPACT").otherwise("MEDIUM_IMPACT"))
        .when(category.isin(*terms.MEDIUM_CATEGORIES), F.when(is_assumption, "MEDIUM_IMPACT").otherwise("LOW_IMPACT"))
        .otherwise("LOW_IMPACT")
    )


def assumption_category(name: Column) -> Column:
    """Category of a free assumption, read from its name."""
    n = F.lower(name)
    return (
        F.when(has_any(n, ("price", "arpu", "fee")), "PRICE")
        .when(has_any(n, ("customer", "user", "student", "population")), "CUSTOMER_COUNT")
        .when(n.contains("share"), "MARKET_SHARE")
        .when(has_any(n, ("cagr", "growth")), "GROWTH_RATE")
        .when(has_any(n, ("penetration", "percent")), "PENETRATION")
        .when(has_any(n, ("market", "size")), "MARKET_SIZE")
        .otherwise("OTHER")
    )


def assumption_source(operand: Column) -> Column:
    """Where an operand comes from: user, verified or validated evidence, model, unknown."""
    tier = operand["source_quality_tier"]
    stage = F.lower(operand["lifecycle_stage"])
    return (
        F.when(operand["is_assumption"] | operand["is_user_provided"], "USER_ASSUMPTION")
        .when((stage == "verified") | tier.isin(terms.TIER_1, terms.TIER_2), "VERIFIED_EVIDENCE")
        .when((stage == "validated") | (tier == terms.TIER_3), "VALIDATED_EVIDENCE")
        .when((tier == terms.TIER_4) | operand["value"].isNotNull(), "MODEL_ASSUMPTION")
        .otherwise("UNKNOWN")
    )


def price_multiplier(basis: Column, frequency: Column) -> Column:
    """12 for monthly, 4 for quarterly, else 1 (stated frequency or wording of the pricing basis)."""
    b, f = F.lower(F.coalesce(basis, F.lit(""))), F.lower(F.coalesce(frequency, F.lit("")))
    return (
        F.when((f == "monthly") | b.contains("monthly"), 12.0)
        .when((f == "quarterly") | b.contains("quarterly"), 4.0)
        .otherwise(1.0)
    )


def revenue_per_customer(request, benchmark: Column) -> Column:
    """Annual revenue per customer: stated prices in order, else the caller's benchmark (may be null).

    ``request`` gives the price columns by name (a DataFrame or a struct column).
    """
    def stated(name: str) -> Column:
        return F.when(request[name] > 0, request[name])

    staff = F.when(request["number_of_employees"] != 0, request["number_of_employees"])
    return F.coalesce(
        stated("annual_price"),
        stated("monthly_price") * 12.0,
        stated("per_facility_price"),
        stated("per_provider_price") * F.coalesce(staff, F.lit(3)),
        stated("per_user_price") * F.coalesce(staff, F.lit(5)),
        benchmark,
    ).cast("double")
