"""Claims: validation, duplicate groups, conflicts, corroboration.

Scale notes. A claim key or a subject may hold a third of all rows. Groups are therefore never collected
into one row: they are reduced by partial aggregation (counts, exact distinct counts through Spark's
two-level distinct plan, ``min_by`` for the canonical claim) and their members stay rows of a long table.
The members a conflict group disagrees with are a count and a value range, not a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import claim_rules as rules
from tamarack.functions import source_rules as src
from tamarack.functions import text as tx
from tamarack.functions.once import compiled_once
from tamarack.operators.domain_rules import rate_sources

# Business columns that ``validate_claims`` reads when the claims carry them.
BUSINESS_COLUMNS = (
    "target_geography", "target_industry", "target_customer", "target_product", "target_customer_type", "preferred_year",
)


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def score_sources(claims: DataFrame, substring: bool = False, rules: DataFrame | None = None) -> DataFrame:
    """Add ``domain, source_quality_score, source_quality_tier``.

    With ``rules`` (a table as :func:`tamarack.operators.domain_rules.default_rules` gives it) hosts are rated by a join with it, and
    ``source_rule`` says by which rule; without, by the built-in lists as column expressions.
    """
    df = claims.withColumn("domain", tx.domain_of(F.col("source_url")))
    if rules is not None:
        df = compiled_once(rate_sources(df, rules), {"_b": F.struct(F.col("source_rule.base").alias("base"), F.col("source_rule.tier").alias("tier"))})
    else:
        df = compiled_once(df, {"_b": src.quality_base(F.col("source_url"), F.col("domain"), F.col("source_name"), substring)})
    points = src.quality_adjustment(
        F.col("year"), F.col("source_name"), F.col("source_context"), _optional(df, "raw_value_expression")
    )
    return df.withColumns({
        "source_quality_score": src.quality_score(F.col("_b"), points),
        "source_quality_tier": F.col("_b.tier"),
    }).drop("_b")


def structural_errors(claims: DataFrame) -> Column:
    """All structural faults of a claim as an array of codes."""
    value, lo, hi = F.col("value"), F.col("range_min"), F.col("range_max")
    ranged = F.coalesce(F.col("is_range_or_approximate"), F.lit(False))
    unit, metric = tx.low(F.col("unit")), tx.low(F.col("metric"))
    norm = tx.normalize_unit(F.col("unit"))
    has_number = F.coalesce(value, lo, hi).isNotNull()
    no_unit = unit == ""
    noise = tx.is_one_of(norm, terms.CLAIM_NOISE_TERMS) | tx.is_one_of(unit, terms.CLAIM_NOISE_TERMS) | tx.has_any(metric, terms.NOISE_METRIC_TERMS)
    unknown = ~tx.is_one_of(norm, terms.RECOGNIZED_UNITS) & ~tx.is_one_of(unit, terms.RECOGNIZED_UNITS)
    finite = ~(F.isnan(value) | (F.abs(value) == float("inf")))
    url = F.trim(F.coalesce("source_url", F.lit("")))
    return F.array_compact(F.array(
        F.when(ranged & (lo > hi), "range_order"),
        F.when(ranged & F.coalesce(lo, hi, value).isNull(), "range_without_bounds"),
        F.when(~ranged & value.isNull(), "missing_value"),
        F.when(~ranged & ~finite, "value_not_finite"),
        F.when(~ranged & finite & (value < 0) & tx.has_any(metric, terms.NON_NEGATIVE_TERMS), "negative_value"),
        F.when(has_number & no_unit, "missing_unit"),
        F.when(has_number & ~no_unit & noise, "noise_unit"),
        F.when(has_number & ~no_unit & ~noise & unknown, "unknown_unit"),
        F.when(~F.col("year").between(1900, 2100), "year_out_of_bounds"),
        F.when(url == "", "missing_url"),
        F.when((url != "") & ~tx.is_http_url(url), "url_not_http"),
        F.when(F.trim(F.coalesce("source_context", F.lit(""))) == "", "missing_context"),
    ))


def relevance(claims: DataFrame) -> DataFrame:
    """Add the seven relevance scores, ``relevance_score``, ``market_scope``, ``rejection_category``.

    Reads the business columns (``BUSINESS_COLUMNS``) when present; needs ``source_quality_score``.
    """
    metric, unit, context, place = (F.col(c) for c in ("metric", "unit", "source_context", "geography"))
    geo, ind = _optional(claims, "target_geography"), _optional(claims, "target_industry")
    cust, prod = _optional(claims, "target_customer"), _optional(claims, "target_product")
    with_unit = F.concat_ws(" ", tx.low(metric), tx.low(context), tx.low(unit))
    without_unit = F.concat_ws(" ", tx.low(metric), tx.low(context))
    df = compiled_once(claims, {
        "quality_percent": F.round(F.col("source_quality_score") * 100, 1),
        "recency_score": rules.recency_score(F.col("year")),
        "geography_score": rules.geography_score(metric, context, place, geo),
        "industry_score": rules.industry_score(with_unit, ind),
        "customer_score": rules.customer_score(with_unit, cust),
        "product_score": rules.product_score(without_unit, prod),
        "usefulness_score": rules.usefulness_score(metric, unit, F.col("value"), F.coalesce("is_range_or_approximate", F.lit(False))),
        "noise_category": rules.noise_category(metric, unit, context, F.col("value")),
    })
    noise, ind_score, geo_score = F.col("noise_category"), F.col("industry_score"), F.col("geography_score")
    unrelated = ind_score == 0
    score = rules.overall_relevance(
        ind_score, F.col("product_score"), geo_score, F.col("customer_score"), F.col("quality_percent"),
        F.col("usefulness_score"), F.col("recency_score"),
    )
    overall = (
        F.when(noise.isin("NOISE_CONTACT_INFO", "NAVIGATION_TEXT"), 0.0).when(noise == "UNRELATED_PRICE", 10.0)
        .when(noise == "NO_MARKET_SIZING_CLAIM", 5.0).when(unrelated, 0.0).otherwise(score)
    )
    df = compiled_once(df, {"relevance_score": overall})
    rejection = (
        F.when(noise.isNotNull(), noise).when(unrelated, "UNRELATED_INDUSTRY")
        .when(geo_score < 15, "GEOGRAPHY_MISMATCH").when(ind_score < 20, "UNRELATED_INDUSTRY")
        .when(F.col("relevance_score") < 35, "LOW_RELEVANCE")
    )
    scope = rules.market_scope(
        metric, context, unit, _optional(claims, "notes"), F.col("product_score"), F.col("customer_score"), ind_score, geo_score
    )
    return df.withColumns({
        "market_scope": F.when(noise.isin("UNRELATED_PRICE", "NO_MARKET_SIZING_CLAIM"), "Unrelated market")
        .when(noise.isNull(), scope),
        "relevance_rejection": rejection,
    })


def validate_claims(claims: DataFrame, substring_domains: bool = False) -> DataFrame:
    """Validate every claim; rejected rows stay, with all their reasons.

    Adds source quality, relevance, suitability, ``errors, validation_status, is_valid,
    rejection_category, confidence, lifecycle_stage`` and the consistency notes. A single claim can reach
    ``validated`` but never ``verified``.
    """
    df = relevance(score_sources(claims, substring_domains))
    has_target = F.coalesce(*[_optional(claims, c).cast("string") for c in BUSINESS_COLUMNS]).isNotNull()
    target = {
        "geography": _optional(claims, "target_geography"),
        "customer_type": F.coalesce(_optional(claims, "target_customer_type"), _optional(claims, "target_customer")),
        "preferred_year": _optional(claims, "preferred_year", "int"),
    }
    claim = {c: F.col(c) for c in ("metric", "unit", "geography", "year", "source_context", "source_url")}
    df = compiled_once(df, {"errors": structural_errors(df)})
    unusable = (F.col("source_quality_tier") == terms.TIER_5) | (F.col("source_quality_score") < 0.25)
    structural = F.size("errors") > 0
    rejected = F.col("relevance_rejection").isNotNull()
    df = compiled_once(df, {
        "validation_status": F.when(unusable, "rejected").when(structural, "invalid").when(rejected, "rejected").otherwise("valid"),
        "rejection_category": F.when(unusable, "UNUSABLE_SOURCE").otherwise(F.col("relevance_rejection")),
    })
    # after the status: where only valid claims are read, the others are gone before this
    tests = rules.suitability_tests(claim, target)
    asked = {f"_suits_{k}": v for k, v in tests.items()} if any(c in claims.columns for c in BUSINESS_COLUMNS) else {}
    if asked:  # else no row has a business to be judged against, and nothing is asked
        df = compiled_once(df, asked)
        tests = {k: F.col(f"_suits_{k}") for k in tests}
    df = compiled_once(df, {"suitability": rules.suitability_of(tests, has_target)})
    valid = F.col("validation_status") == "valid"
    year = F.col("year")
    return df.withColumns({
        "is_valid": valid,
        "confidence": F.when(valid & (F.col("source_quality_score") >= 0.70), "medium").otherwise("low"),
        "lifecycle_stage": F.when(valid, "validated").otherwise("extracted"),
        "year_note": F.when(year.between(1900, 2019), F.concat(F.lit("Prior baseline data ("), year.cast("string"), F.lit(")")))
        .when(year.between(2020, 2100), F.concat(F.lit("Observation year: "), year.cast("string"))),
        "geography_note": F.when(tx.low(F.col("geography")) != "", F.concat(F.lit("Explicit geographic scope: "), F.col("geography"))),
    }).drop("relevance_rejection", *asked)


# -- grouping -----------------------------------------------------------------------------------


def with_claim_keys(claims: DataFrame) -> DataFrame:
    """Add the keys of the same claim and of the same thing measured, and their readable parts.

    ``group_key`` and ``subject_key`` are 256-bit digests, which operators group and join by; ``group_id`` and
    ``subject_id`` are short labels of them.
    """
    metric, unit = tx.normalize_metric(F.col("metric")), tx.normalize_unit(F.col("unit"))
    place, kind = tx.normalize_place(F.col("geography")), F.coalesce("metric_type", F.lit(""))
    year = F.coalesce(F.col("year").cast("string"), F.lit("None"))
    df = compiled_once(claims, {"norm_metric": metric, "norm_unit": unit, "norm_place": place, "_kind": kind, "_year": year})
    group = F.concat_ws(
        "|", "norm_metric", "_kind", "norm_place", "_year", "norm_unit", tx.key_number(F.col("value")),
        tx.key_number(F.col("range_min")), tx.key_number(F.col("range_max")),
    )
    macro = F.coalesce("value", "range_min") >= terms.MACRO_SCALE
    subject = F.concat_ws(
        "|", "norm_metric", "_kind", "norm_place", "_year", "norm_unit", F.when(macro, "macro").otherwise("micro")
    )
    return compiled_once(df, {
        "group_key": F.sha2(group, 256), "subject_key": F.sha2(subject, 256),
        "group_id": F.concat(F.lit("dup_"), F.substring(F.md5(group), 1, 12)),
        "subject_id": F.concat(F.lit("cnf_"), F.substring(F.md5(F.concat(F.lit("conflict_"), subject)), 1, 12)),
    }).drop("_kind", "_year")


def _order() -> Column:
    """Total order of claims that replaces list order: url, then sentence and offset through the id."""
    return F.struct("source_url", "candidate_id")


_KEYS = ("group_key", "subject_key", "group_id", "subject_id")
_CANONICAL = ("candidate_id", "metric", "metric_type", "value", "raw_value_expression", "unit", "geography", "year",
              "is_range_or_approximate", "range_min", "range_max", "source_name", "source_url", "source_context")


def duplicate_groups(claims: DataFrame, keep=()) -> DataFrame:
    """One row per distinct claim (per request when the claims carry ``request_id``).

    Canonical fields come from the first claim. Counts are exact: claims, distinct urls, distinct domains,
    and whether one context text (over 30 characters) appears twice (``is_syndicated``).
    """
    scope = [c for c in ("request_id",) if c in claims.columns]
    df = claims if "group_key" in claims.columns else with_claim_keys(claims)
    if "domain" not in df.columns:
        df = df.withColumn("domain", tx.domain_of(F.col("source_url")))
    context = F.regexp_replace(tx.low(F.col("source_context")), r"\s+", " ")
    df = df.withColumn("_ctx", F.when(F.length(context) > 30, F.sha2(context, 256)))
    canonical = [c for c in (*_CANONICAL, *keep) if c in df.columns]
    quality = (
        [
            F.max("source_quality_score").alias("max_quality_score"),
            F.bool_or(F.col("source_quality_tier").isin(terms.TIER_1, terms.TIER_2, terms.TIER_3)).alias("has_authority"),
        ]
        if "source_quality_score" in df.columns else []
    )
    grouped = df.groupBy(*scope, *_KEYS).agg(
        F.min_by(F.struct(*canonical), _order()).alias("first"),
        F.count("*").alias("n_claims"),
        F.countDistinct("source_url").alias("n_urls"),
        F.countDistinct("domain").alias("n_domains"),
        (F.count("_ctx") > F.countDistinct("_ctx")).alias("is_syndicated"),
        *quality,
    )
    rest = [c for c in grouped.columns if c not in (*scope, *_KEYS, "first")]
    return grouped.select(*scope, *_KEYS, "first.*", *rest)


def group_members(claims: DataFrame) -> DataFrame:
    """Membership as rows: which claim, url and domain belongs to which group."""
    scope = [c for c in ("request_id",) if c in claims.columns]
    df = claims if "group_key" in claims.columns else with_claim_keys(claims)
    return df.select(*scope, *_KEYS, "candidate_id", "source_url", tx.domain_of(F.col("source_url")).alias("domain"))


def conflicts(groups: DataFrame) -> DataFrame:
    """Subjects for which sources state more than one value."""
    scope = [c for c in ("request_id",) if c in groups.columns]
    first = F.min_by(F.struct("metric", "geography", "year", "unit"), _order()).alias("first")
    return (
        groups.groupBy(*scope, "subject_key", "subject_id").agg(
            first, F.countDistinct("value").alias("n_values"), F.min("value").alias("min_value"),
            F.max("value").alias("max_value"), F.sum("n_claims").alias("subject_claims"),
        )
        .filter(F.col("n_values") > 1)
        .select(*scope, "subject_key", "subject_id", "first.*", "n_values", "min_value", "max_value", "subject_claims")
    )


def conflicting_values(groups: DataFrame) -> DataFrame:
    """The values of every conflict as rows."""
    scope = [c for c in ("request_id",) if c in groups.columns]
    hot = conflicts(groups).select(*scope, "subject_key")
    return groups.join(hot, [*scope, "subject_key"], "left_semi").select(*scope, *_KEYS, "value", "n_claims", "n_domains")


def triangulate(claims: DataFrame, validated: bool = False, substring_domains: bool = False) -> DataFrame:
    """Status of every distinct valid claim: conflict, verified or validated, with its confidence.

    ``claims`` are raw, or already through :func:`validate_claims` with ``validated=True``. ``verified``
    needs two independent domains, one of them in tier 1 to 3, and no conflict. Rejected claims are left
    out here; read them from :func:`validate_claims`.
    """
    return statuses(claim_groups(claims if validated else validate_claims(claims, substring_domains)))


def claim_groups(checked: DataFrame) -> DataFrame:
    """Groups of the valid claims, as :func:`statuses` takes them.

    It reads them twice, for the totals of subjects too: write them first where the claims are costly to derive.
    """
    return duplicate_groups(with_claim_keys(checked.filter("is_valid")), keep=KEPT)


# Columns of a claim that its group carries beyond the canonical ones.
KEPT = ("source_quality_tier", "market_scope", "relevance_score", "suitability", "extraction_confidence")


def statuses(groups: DataFrame) -> DataFrame:
    """Status, stage and confidence of claim groups (rows as :func:`duplicate_groups` gives them, all groups of a subject)."""
    scope = [c for c in ("request_id",) if c in groups.columns]
    # The subject totals come from the (much smaller) group table; the join key is the grouping key.
    hot = conflicts(groups).select(*scope, "subject_key", "n_values", "min_value", "max_value", "subject_claims")
    df = groups.join(hot, [*scope, "subject_key"], "left")
    conflict, many, strong = F.col("n_values").isNotNull(), F.col("n_domains") >= 2, F.col("has_authority")
    best = F.col("max_quality_score")
    single = F.when(best >= 0.70, "medium").otherwise("low")
    verified = ~conflict & many & strong
    return df.select(
        *scope, *_KEYS, *[c for c in (*_CANONICAL, *KEPT) if c in df.columns],
        F.col("max_quality_score").alias("source_quality_score"),
        F.when(conflict, "conflict").otherwise("valid").alias("validation_status"),
        F.when(verified, "verified").otherwise("validated").alias("lifecycle_stage"),
        F.when(conflict, single).when(many & strong, F.when(best >= 0.85, "very_high").otherwise("high"))
        .when(many, "medium").otherwise(single).alias("confidence"),
        "n_claims", "n_urls",
        F.col("n_domains").alias("corroborating_source_count"),
        F.when(conflict, F.col("subject_claims") - F.col("n_claims")).otherwise(F.lit(0)).cast("bigint").alias("conflicting_source_count"),
        F.when(conflict, F.col("min_value")).alias("conflict_min"),
        F.when(conflict, F.col("max_value")).alias("conflict_max"),
        "is_syndicated", F.lit(True).alias("is_valid"),
    )


def distinct_provenance(checked: DataFrame) -> DataFrame:
    """One provenance row per group and url, the first claim of that url."""
    scope = [c for c in ("request_id",) if c in checked.columns]
    fields = F.struct("source_name", "domain", "source_context", "source_quality_score", "source_quality_tier", "market_scope")
    df = with_claim_keys(checked.filter("is_valid"))
    return df.groupBy(*scope, "group_key", "group_id", "source_url").agg(F.min_by(fields, F.col("candidate_id")).alias("p")).select(
        *scope, "group_key", "group_id", "source_url", "p.*"
    )


def evidence_rating(items: DataFrame, by=(), conflicts_column: str | None = None) -> DataFrame:
    """HIGH, MEDIUM, LOW or INSUFFICIENT for a set of validated rows (per ``by`` columns)."""
    valid = F.col("is_valid")
    hot = F.bool_or(F.col(conflicts_column)) if conflicts_column else F.bool_or(F.col("validation_status") == "conflict")
    df = items.groupBy(*by).agg(
        F.count_if(valid).alias("n_valid"),
        F.count_if(valid & (F.col("source_quality_tier") == terms.TIER_1)).alias("tier_1"),
        F.count_if(valid & (F.col("source_quality_tier") == terms.TIER_2)).alias("tier_2"),
        F.count_if(valid & (F.col("source_quality_tier") == terms.TIER_3)).alias("tier_3"),
        F.count_if(valid & (F.col("lifecycle_stage") == "verified")).alias("n_verified"),
        F.coalesce(hot, F.lit(False)).alias("has_conflicts"),
    )
    rating = (
        F.when(F.col("n_valid") == 0, "INSUFFICIENT")
        .when(F.col("has_conflicts"), "LOW")
        .when((F.col("tier_1") >= 1) & (F.col("n_verified") >= 1), "HIGH")
        .when(((F.col("tier_1") >= 1) | (F.col("tier_2") >= 1)) & (F.col("n_valid") >= 2),
              F.when(F.col("n_verified") >= 1, "HIGH").otherwise("MEDIUM"))
        .when((F.col("tier_3") >= 1) | (F.col("n_valid") >= 2), "MEDIUM")
        .otherwise("LOW")
    )
    return df.withColumn("evidence_rating", rating)


# -- hand-entered evidence ----------------------------------------------------------------------


def check_evidence_items(items: DataFrame) -> DataFrame:
    """Normalise and inspect hand-entered evidence: ``source_type``, ``errors``, ``warnings`` and flags."""
    status, has_value = F.col("evidence_status"), F.col("value").isNotNull()
    named, linked = tx.low(F.col("source_name")) != "", tx.low(F.col("source_url")) != ""
    df = items.withColumn(
        "source_type", F.when((status == "assumed") & (F.col("source_type") == "unknown"), "assumption").otherwise(F.col("source_type"))
    )
    kind = F.col("source_type")
    official = kind.isin("government", "official_statistics", "regulatory")
    return df.withColumns({
        "errors": F.array_compact(F.array(
            F.when(has_value & (tx.low(F.col("unit")) == ""), "value_without_unit"),
            F.when((status == "verified") & ~named, "verified_without_source"),
            F.when((status == "verified") & (kind == "assumption"), "verified_assumption"),
            F.when((status == "unknown") & has_value, "unknown_with_value"),
            F.when((status == "assumed") & official, "assumed_as_official"),
            F.when(~F.col("year").between(1900, 2100), "year_out_of_bounds"),
        )),
        "warnings": F.array_compact(F.array(
            F.when(status == "assumed", "unverified_assumption"),
            F.when((status == "verified") & ~linked, "no_source_url"),
            F.when(F.col("year") < 2020, "historical_data"),
            F.when(has_value & (tx.low(F.col("geography")) == ""), "no_geography"),
        )),
        "is_verified": status == "verified", "is_assumed": status == "assumed", "is_unknown": status == "unknown",
        "has_source_url": linked,
    })
