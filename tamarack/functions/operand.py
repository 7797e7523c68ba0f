"""Operands: one number of a formula with its provenance, as a struct column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions.text import low
from tamarack.schemas import OPERAND_DDL, OPERAND_FIELDS

_FALSE = ("is_assumption", "is_user_provided", "is_conflict", "is_prior_year")


def _sql(value, kind: str) -> str:
    """SQL literal of a Python value in a field's type."""
    if value is None:
        return f"cast(null as {kind})"
    text = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value).lower()
    return f"cast({text} as {kind})"


def operand(name, value, unit, **fields) -> Column:
    """Build an operand struct; missing fields are null, missing flags false.

    Constants go into one parsed expression and only columns are set on top, which keeps the number of
    calls into the JVM (and so the time to build a plan) small.
    """
    given = {"name": name, "value": value, "unit": unit, **fields}
    parts, columns = [], []
    for field, kind in OPERAND_FIELDS:
        v = given.get(field, False if field in _FALSE else None)
        if isinstance(v, Column):
            columns.append((field, v.cast(kind)))
            v = None
        parts.append(f"'{field}', {_sql(v, kind)}")
    out = F.expr("named_struct(" + ", ".join(parts) + ")")
    for field, v in columns:
        out = out.withField(field, v)
    return out


def no_operand() -> Column:
    return F.lit(None).cast(OPERAND_DDL)


def no_operands() -> Column:
    return F.array().cast(f"array<{OPERAND_DDL}>")


def low_of(op: Column) -> Column:
    return F.coalesce(op["range_min"], op["value"])


def high_of(op: Column) -> Column:
    return F.coalesce(op["range_max"], op["value"])


def is_usable(op: Column) -> Column:
    """Constraints on an operand: finite, percentages within 0..100, ordered range, no noise unit, not raw."""
    unit = low(op["unit"])
    percent = unit.isin(*terms.PERCENT_UNITS, "share")

    def outside(v: Column) -> Column:
        return F.coalesce((v < 0) | (v > 100), F.lit(False))

    signed = unit.isin(*terms.PERCENT_UNITS, "ratio", "cagr", "growth_rate")
    negative = F.coalesce(op["value"] < 0, F.lit(False)) | F.coalesce(op["range_min"] < 0, F.lit(False))
    not_finite = F.coalesce(F.isnan(op["value"]) | (F.abs(op["value"]) == float("inf")), F.lit(False))
    return (
        (low(op["name"]) != "") & (unit != "") & ~not_finite
        & ~(percent & (outside(op["value"]) | outside(op["range_min"]) | outside(op["range_max"])))
        & ~(~signed & negative)
        & ~F.coalesce(op["range_min"] > op["range_max"], F.lit(False))
        & ~unit.isin(*terms.OPERAND_NOISE_UNITS)
        & (F.coalesce(op["lifecycle_stage"], F.lit("")) != "discovered")
    )


def present(*ops: Column) -> Column:
    """The operands that are there, in order."""
    return F.filter(F.array(*ops), lambda o: o.isNotNull())


def count_where(ops: Column, test) -> Column:
    return F.size(F.filter(ops, test))


def in_stage(op: Column, stage: str) -> Column:
    return F.coalesce(F.lower(op["lifecycle_stage"]) == stage, F.lit(False))


def in_tier(op: Column, *tiers: str) -> Column:
    return F.coalesce(op["source_quality_tier"].isin(*tiers), F.lit(False))


def confidence_sql(ops: str) -> str:
    """SQL of the confidence of a result, from the stages and flags of the operand array ``ops``."""
    assumed = f"size(filter({ops}, o -> o.is_assumption))"
    verified = f"size(filter({ops}, o -> lower(o.lifecycle_stage) <=> 'verified'))"
    validated = f"size(filter({ops}, o -> lower(o.lifecycle_stage) <=> 'validated'))"
    return f"""case when exists({ops}, o -> o.is_conflict) then 'low'
        when {assumed} > 1 then if({verified} > 0, 'medium', 'low')
        when {verified} >= 2 and {assumed} = 0 then 'very_high'
        when ({verified} >= 1 or {validated} >= 1) and {assumed} = 0 then 'high' else 'medium' end"""


def _tier_count(ops: str, *tiers: str) -> str:
    names = ", ".join(f"'{t}'" for t in tiers)
    return f"size(filter({ops}, o -> coalesce(o.source_quality_tier in ({names}), false)))"


def evidence_quality_sql(ops: str, has_warnings: str) -> str:
    """SQL of HIGH, MEDIUM or LOW, from the tiers of the operands."""
    assumed = f"size(filter({ops}, o -> o.is_assumption))"
    top, press = _tier_count(ops, terms.TIER_1, terms.TIER_2), _tier_count(ops, terms.TIER_3)
    return f"""case when {assumed} >= 2 or {_tier_count(ops, terms.TIER_4)} >= 2 then 'LOW'
        when {top} >= 1 and {assumed} = 0 and not {has_warnings} then 'HIGH'
        when {top} >= 1 or {press} >= 1 then 'MEDIUM' else 'LOW' end"""


def quality_reasons_sql(ops: str) -> str:
    """SQL of one line per kind of support that is present."""
    lines = (
        (_tier_count(ops, terms.TIER_1), "official (tier 1) source(s)"),
        (_tier_count(ops, terms.TIER_2), "academic or trade (tier 2) source(s)"),
        (_tier_count(ops, terms.TIER_3), "research or press (tier 3) source(s)"),
        (_tier_count(ops, terms.TIER_4), "general web (tier 4) source(s)"),
        (f"size(filter({ops}, o -> o.is_prior_year))", "prior-year benchmark(s)"),
        (f"size(filter({ops}, o -> o.is_assumption))", "explicit assumption(s)"),
    )
    parts = ", ".join(f"if({n} > 0, concat({n}, ' {text}'), null)" for n, text in lines)
    return f"array_compact(array({parts}))"


def provenance(op: Column, role: str) -> Column:
    """Provenance struct of an operand with derived data type and confidence; null without operand."""
    kind = F.coalesce(op["data_type"], F.when(op["is_assumption"], "estimated").otherwise("sourced"))
    derived = (
        F.when((kind == "sourced") & in_tier(op, terms.TIER_1, terms.TIER_2), "high")
        .when(kind == "derived", "medium").otherwise("low")
    )
    source = F.coalesce(
        op["source_name"], F.when(op["is_user_provided"], "User Input"), F.lit("Industry Benchmark")
    )
    return F.when(op.isNotNull(), F.struct(
        F.coalesce(op["name"], F.lit(role)).alias("metric"), op["value"].alias("value"), op["unit"].alias("unit"),
        op["currency"].alias("currency"), kind.alias("data_type"), source.alias("source"),
        op["source_url"].alias("source_url"), F.coalesce(op["published_year"], op["year"]).alias("published_year"),
        F.lower(F.coalesce(op["confidence"], derived)).alias("confidence"),
        op["assumption_justification"].alias("notes"),
    ))


def compatibility_warnings(customers: Column, pricing: Column) -> Column:
    """Entity and currency mismatches between a customer count and a price."""
    c = F.lower(F.coalesce(customers["entity_concept"], customers["unit"], F.lit("")))
    p = F.lower(F.coalesce(pricing["entity_concept"], pricing["name"], F.lit("")))
    personal = p.rlike("student|developer|per person|individual")
    consumer = p.rlike("per user|per student|consumer|individual")
    household = c.contains("household") & personal
    enterprise = ~household & c.contains("enterprise") & consumer
    currency = F.upper(customers["currency"]) != F.upper(pricing["currency"])
    return F.when(customers.isNull() | pricing.isNull(), F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(
            F.when(household, F.lit("Entity unit mismatch: a household count is priced per person.")),
            F.when(enterprise, F.lit("Entity unit mismatch: an enterprise count is priced per person.")),
            F.when(currency, F.lit("Currency divergence between customer metric and pricing.")),
        ))
    )
