"""Assumption registry, reliability, report status, confidence and rating. All in-row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import operand as op
from tamarack.functions.once import computed_once
from tamarack.schemas import ASSUMPTION_DDL, OPERAND_DDL
from tamarack.functions.measures import (
    assumption_category, assumption_impact, assumption_source, freshness, freshness_rank,
)

# Operand column, category, results it affects: the order in which names are registered (fixed values).
_REGISTERED = (
    ("macro", "MARKET_SIZE", "TAM,SAM"),
    ("segment_percentages", "SEGMENT_PERCENTAGE", "SAM"),
    ("geo_pct", "GEOGRAPHY", "SAM"),
    ("segment_pct", "SEGMENT_PERCENTAGE", "SAM"),
    ("other_filters", "SEGMENT_PERCENTAGE", "SAM"),
    ("td_share", "MARKET_SHARE", "SOM"),
    ("customers", "CUSTOMER_COUNT", "TAM"),
    ("serviceable", "TARGET_POPULATION", "SAM"),
    ("target_customer_pct", "PENETRATION", "SAM"),
    ("obtainable", "CUSTOMER_COUNT", "SOM"),
    ("bu_share", "MARKET_SHARE", "SOM"),
    ("pricing", "PRICE", "TAM,SAM,SOM"),
)
_LISTS = ("segment_percentages", "other_filters")


def _first_per_name(items: Column) -> Column:
    names = F.transform(items, lambda x: x["name"])
    return F.filter(items, lambda x, i: ~F.array_contains(F.slice(names, F.lit(1), i), x["name"]))


def _operand_item(x: Column) -> Column:
    """Registry item of ``struct(category, affects, o)``."""
    o, category = x["o"], x["category"]
    source = assumption_source(o)
    user = o["is_user_provided"] | o["is_assumption"]
    model = source == "MODEL_ASSUMPTION"
    return F.struct(
        o["name"].alias("name"), o["value"].alias("value"), F.coalesce(o["unit"], F.lit("units")).alias("unit"),
        category.alias("category"), source.alias("source_type"),
        F.coalesce(o["source_url"], o["source_name"]).alias("source_reference"),
        F.coalesce(o["confidence"], F.lit("medium")).alias("confidence"),
        user.alias("is_user_provided"), source.isin("VERIFIED_EVIDENCE", "VALIDATED_EVIDENCE").alias("is_evidence_based"),
        model.alias("is_model_derived"), assumption_impact(category, user | model).alias("impact"),
        x["affects"].alias("affects"), o["range_min"].alias("min_value"), o["range_max"].alias("max_value"),
        F.when(o["range_min"].isNotNull() & o["range_max"].isNotNull(), "EVIDENCE_BOUNDED").otherwise("POINT_ONLY").alias("uncertainty_status"),
    )


def _free_item(a: Column) -> Column:
    category = assumption_category(a["name"])
    user = F.coalesce(a["is_user_provided"], F.lit(True))
    none = F.lit(None).cast("double")
    return F.struct(
        a["name"].alias("name"), a["value"].alias("value"), a["unit"].alias("unit"), category.alias("category"),
        F.when(user, "USER_ASSUMPTION").otherwise("MODEL_ASSUMPTION").alias("source_type"),
        F.lit(None).cast("string").alias("source_reference"), F.when(user, "medium").otherwise("low").alias("confidence"),
        user.alias("is_user_provided"), F.lit(False).alias("is_evidence_based"), (~user).alias("is_model_derived"),
        assumption_impact(category, F.lit(True)).alias("impact"),
        F.when(category.isin("PRICE", "CUSTOMER_COUNT", "MARKET_SIZE"), "TAM,SAM").otherwise("SAM,SOM").alias("affects"),
        none.alias("min_value"), none.alias("max_value"), F.lit("POINT_ONLY").alias("uncertainty_status"),
    )


def assumption_registry(requests: DataFrame) -> DataFrame:
    """Add ``registry`` (first item per name) and its four counts."""
    def tagged(column: str, category: str, affects: str) -> str:
        ops = f"coalesce({column}, cast(array() as array<{OPERAND_DDL}>))" if column in _LISTS else f"array({column})"
        return f"transform({ops}, o -> named_struct('category', '{category}', 'affects', '{affects}', 'o', o))"

    every = F.expr("concat(" + ", ".join(tagged(*r) for r in _REGISTERED) + ")")
    evidence = F.transform(F.filter(every, lambda x: x["o"]["value"].isNotNull()), _operand_item)
    free = F.transform(F.expr(f"coalesce(assumptions, cast(array() as array<{ASSUMPTION_DDL}>))"), _free_item)
    df = computed_once(requests, {"_items": F.concat(evidence, free)})
    df = computed_once(df, {"registry": _first_per_name(F.col("_items"))})
    r = F.col("registry")
    return computed_once(df, {"registry_counts": F.struct(
        F.size(r).alias("total"),
        op.count_where(r, lambda i: i["is_user_provided"] | (i["source_type"] == "USER_ASSUMPTION")).alias("user_provided"),
        op.count_where(r, lambda i: i["is_model_derived"] | (i["source_type"] == "MODEL_ASSUMPTION")).alias("model_derived"),
        op.count_where(r, lambda i: i["impact"] == "CRITICAL").alias("critical"),
        op.count_where(r, lambda i: i["impact"].isin("CRITICAL", "HIGH_IMPACT")).alias("high_impact"),
    )}).drop("_items")


def raw_operands() -> Column:
    """All operands of a request that feed the audit, in order."""
    def many(c: str) -> Column:
        return F.filter(F.coalesce(c, op.no_operands()), lambda o: o.isNotNull())

    return F.concat(
        op.present(F.col("macro")), many("segment_percentages"), op.present(F.col("geo_pct"), F.col("segment_pct")),
        many("other_filters"),
        op.present(*[F.col(c) for c in ("td_share", "customers", "serviceable", "target_customer_pct", "obtainable", "bu_share", "pricing")]),
    )


def report_status(sized: DataFrame) -> DataFrame:
    """Add ``report_status``: conflict anywhere, else insufficient unless one TAM exists, else calculated."""
    results = [F.col(f"{p}_{m}.status") for p in ("td", "bu") for m in ("tam", "sam", "som")]
    conflict = F.array_contains(F.array(*results), "conflict")
    none = (results[0] != "calculated") & (results[3] != "calculated")
    return sized.withColumn(
        "report_status",
        F.when(conflict, "conflict").when(none, "insufficient_evidence").otherwise("calculated"),
    )


def reliability(sized: DataFrame) -> DataFrame:
    """Add ``reliability`` to rows that carry results, comparison, registry, status and double-counting risk."""
    df = computed_once(sized, {"_ops": raw_operands()})
    ops, counts, registry = F.col("_ops"), F.col("registry_counts"), F.col("registry")
    top = op.count_where(ops, lambda o: op.in_tier(o, terms.TIER_1, terms.TIER_2) & ~o["is_assumption"])
    press = op.count_where(ops, lambda o: op.in_tier(o, terms.TIER_3) & ~o["is_assumption"])
    weak = op.count_where(ops, lambda o: op.in_tier(o, terms.TIER_4) | o["is_assumption"])
    strength = F.when((top >= 2) & (weak == 0), "HIGH").when((top >= 1) | (press >= 1), "MEDIUM").otherwise("LOW")
    risky = op.count_where(registry, lambda i: i["impact"].isin("CRITICAL", "HIGH_IMPACT")
                           & (i["is_user_provided"] | i["is_model_derived"] | ~i["is_evidence_based"]))
    risk = (
        F.when(counts["critical"] >= 1, "CRITICAL")
        .when((risky >= 2) | (counts["user_provided"] >= 2), "HIGH")
        .when((counts["user_provided"] >= 1) | (counts["model_derived"] >= 1) | (risky >= 1), "MEDIUM")
        .otherwise("LOW")
    )
    target = F.col("target_year")
    ranked = F.transform(
        F.filter(ops, lambda o: o["published_year"].isNotNull()),
        lambda o: F.struct(freshness_rank(freshness(o["published_year"], target)).alias("r"), freshness(o["published_year"], target).alias("f")),
    )
    worst = F.coalesce(F.array_max(ranked)["f"], F.lit("UNKNOWN"))
    df = computed_once(df, {
        "_strength": strength, "_risk": risk, "_fresh": worst,
        "_agree": F.coalesce(F.upper("comparison.severity"), F.lit("SINGLE_METHOD")),
    })
    s, k, f, a = F.col("_strength"), F.col("_risk"), F.col("_fresh"), F.col("_agree")
    level = (
        F.when((k == "CRITICAL") | (s == "LOW") | (a == "SEVERE_DIVERGENCE"), "LOW")
        .when(f == "VERY_OLD", "LOW")
        .when(f == "OLD", "MEDIUM")
        .when((s == "HIGH") & k.isin("LOW", "MEDIUM") & a.isin("ACCEPTABLE", "SINGLE_METHOD") & (f == "RECENT"), "HIGH")
        .when(k.isin("LOW", "MEDIUM"), "MEDIUM")
        .otherwise("LOW")
    )
    done = F.col("report_status") == "calculated"

    def field(value: Column, default: str, name: str) -> Column:
        return F.when(done, value).otherwise(default).alias(name)

    return df.withColumn("reliability", F.struct(
        field(level, "INSUFFICIENT", "level"), field(s, "INSUFFICIENT", "evidence_strength"),
        field(k, "HIGH", "assumption_risk"), field(f, "UNKNOWN", "freshness"),
        field(a, "SINGLE_METHOD", "methodology_agreement"), F.col("double_counting_risk").alias("double_counting_risk"),
        field(F.when(f.isin("RECENT", "MODERATELY_OLD"), "CONSISTENT").otherwise("TEMPORAL_GAP"), "CONSISTENT", "temporal_consistency"),
    )).drop("_ops", "_strength", "_risk", "_fresh", "_agree")


def report_confidence(sized: DataFrame) -> DataFrame:
    """Add ``report_confidence`` and ``report_quality``."""
    severity = F.col("comparison.severity")
    n = F.col("registry_counts.user_provided") + F.col("registry_counts.model_derived")
    either_high = (F.col("td_tam.confidence") == "high") | (F.col("bu_tam.confidence") == "high")
    has_macro = F.col("macro").isNotNull()
    has_bottom_up = F.col("customers").isNotNull() | F.col("pricing").isNotNull() | F.col("base_organizations").isNotNull()
    confidence = (
        F.when(F.col("report_status") == "conflict", "low")
        .when(severity == "severe_divergence", "low")
        .when(severity == "acceptable", F.when(n <= 1, "very_high").otherwise("high"))
        .when(either_high, F.when(n <= 1, "high").otherwise("medium"))
        .when(has_macro | has_bottom_up, "medium")
        .otherwise("low")
    )
    ratings = F.transform(
        F.filter(
            F.array(*[F.col(f"{p}_{m}") for p in ("td", "bu") for m in ("tam", "sam", "som")]),
            lambda r: r["status"] == "calculated",
        ),
        lambda r: r["evidence_quality"],
    )
    quality = (
        F.when(F.col("report_status") != "calculated", "INSUFFICIENT")
        .when(F.array_contains(ratings, "HIGH") & ~F.array_contains(ratings, "LOW"), "HIGH")
        .when(F.array_contains(ratings, "HIGH") | F.array_contains(ratings, "MEDIUM"), "MEDIUM")
        .otherwise("LOW")
    )
    return computed_once(sized, {"report_confidence": confidence, "report_quality": quality})
