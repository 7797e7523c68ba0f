"""Registered queries: one row per supplier through every branch of the claim rules.

Each query deals a list of cases out to the suppliers by key; the expected outcome of a case is stated beside it and
makes up the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack import terms
from tamarack.functions import claim_rules as rules
from tamarack.functions import source_rules as src
from tamarack.operators import evidence as ev
from tamarack.operators import operands as opd
from tamarack.plans import corpus
from tamarack.plans.registry import query


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def expected(cases, columns: str, kinds: str) -> str:
    """SQL of the outcomes: ``cases`` are (input..., outcome); the outcome has one value per column."""
    rows = ", ".join(f"({i}, {', '.join(map(_literal, c[-1]))})" for i, c in enumerate(cases))
    casts = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in zip(columns.split(), kinds.split(), strict=True))
    return f"WITH e(i, {', '.join(columns.split())}) AS (VALUES {rows}) SELECT s_suppkey, {casts} FROM supplier JOIN e ON s_suppkey % {len(cases)} = i"


def dealt(spark, sf, cases, fields: str):
    """The suppliers with the input fields ("name type, ...") of their case."""
    schema = T.StructType.fromDDL(fields)
    s = corpus.table(spark, sf, "supplier").select("s_suppkey")
    k = F.col("s_suppkey") % len(cases)
    return s.select("s_suppkey", *[
        F.element_at(F.array(*[F.lit(c[i]).cast(f.dataType) for c in cases]), (k + 1).cast("int")).alias(f.name) for i, f in enumerate(schema)])


# -- metric types -------------------------------------------------------------------------------

_TYPES = (
    ("tariff rate", "INR", "electricity", 5.0, None, (None,)), ("amount", "USD", "the firm raised money in series b", 5e7, "million", ("funding_amount",)),
    ("market size", "USD", "raised to new heights", 5e9, None, ("market_size",)), ("total", "USD", "acme reported revenue", 5e8, None, ("company_revenue",)),
    ("fee", "USD", "monthly plan", 20.0, None, ("subscription_price",)), ("fee", "USD", "one time", 20.0, None, ("average_price",)),
    ("spend", "INR", "arpu of the sector", 2e6, None, ("average_price",)), ("sector", "INR", "as stated", 2e9, None, ("market_size",)),
    ("sector", "USD", "as stated", 3.0, "Billion", ("market_size",)), ("rate", "%", "a cagr of", 12.0, None, ("cagr",)), ("rate", "percent", "yoy change", 12.0, None, ("growth_rate",)),
    ("part", "pct", "as stated", 12.0, None, ("market_share",)), ("pupils", "children", "as stated", 1000.0, None, ("student_count",)),
    ("new registrations", "rows", "as stated", 100.0, None, ("enrollment",)), ("active", "developers", "as stated", 100.0, None, ("users",)),
    ("total", "households", "as stated", 100.0, None, ("households",)), ("total", "citizens", "as stated", 100.0, None, ("population",)),
    ("total", "manufacturers", "as stated", 100.0, None, ("customer_count",)), ("total", "things", "as stated", 100.0, None, (None,)),
)


@query("metric_types", expected(_TYPES, "metric_type", "VARCHAR"))
def metric_types(spark, sf):
    df = dealt(spark, sf, _TYPES, "metric string, unit string, context string, value double, mult string")
    return df.select("s_suppkey", rules.metric_type(*[F.col(c) for c in ("metric", "unit", "context", "value", "mult")]).alias("metric_type"))


# -- gates --------------------------------------------------------------------------------------

_GATES = (
    ("helpline", "users", "as stated", 5.0, ("NOISE_CONTACT_INFO",)), ("count", "units", "as stated", 9876543210.0, ("NOISE_CONTACT_INFO",)),
    ("count", "users", "dial +91 9876543210 now", 5.0, ("NOISE_CONTACT_INFO",)), ("count", "users", "write to info@a.org", 5.0, ("NOISE_CONTACT_INFO",)),
    ("hotel rooms", "users", "as stated", 5.0, ("NOISE_CONTACT_INFO",)), ("count", "users", "see our Privacy Policy", 5.0, ("NAVIGATION_TEXT",)),
    ("cookie policy", "users", "as stated", 5.0, ("NAVIGATION_TEXT",)), ("price", "USD", "a t-shirt on sale", 5.0, ("UNRELATED_PRICE",)),
    ("price", "USD", "a t-shirt on sale", None, (None,)), ("price", "users", "a t-shirt on sale", 5.0, (None,)),
    ("page number", "users", "as stated", 5.0, ("NO_MARKET_SIZING_CLAIM",)), ("count", "tips", "as stated", 5.0, ("NO_MARKET_SIZING_CLAIM",)), ("count", "users", "as stated", 5.0, (None,)),
)


@query("noise_gates", expected(_GATES, "noise", "VARCHAR"))
def noise_gates(spark, sf):
    df = dealt(spark, sf, _GATES, "metric string, unit string, context string, value double")
    return df.select("s_suppkey", rules.noise_category(*[F.col(c) for c in ("metric", "unit", "context", "value")]).alias("noise"))


# -- structure ----------------------------------------------------------------------------------

_URL = "https://a.org/x"
_STRUCTURES = (
    ("users", 5.0, "users", False, None, None, 2024, _URL, "x", ("",)), ("users", None, "users", True, 9.0, 3.0, 2024, _URL, "x", ("range_order",)),
    ("users", None, "users", True, None, None, 2024, _URL, "x", ("range_without_bounds",)), ("users", None, "users", False, None, None, 2024, _URL, "x", ("missing_value",)),
    ("users", float("inf"), "users", False, None, None, 2024, _URL, "x", ("value_not_finite",)), ("users", -5.0, "users", False, None, None, 2024, _URL, "x", ("negative_value",)),
    ("change", -5.0, "%", False, None, None, 2024, _URL, "x", ("",)), ("users", 5.0, " ", False, None, None, 2024, _URL, "x", ("missing_unit",)),
    ("users", 5.0, "Tips", False, None, None, 2024, _URL, "x", ("noise_unit",)), ("users", 5.0, "parsecs", False, None, None, 2024, _URL, "x", ("unknown_unit",)),
    ("users", 5.0, "users", False, None, None, 1800, _URL, "x", ("year_out_of_bounds",)), ("users", 5.0, "users", False, None, None, None, _URL, "x", ("",)),
    ("users", 5.0, "users", False, None, None, 2024, "", "x", ("missing_url",)), ("users", 5.0, "users", False, None, None, 2024, "ftp://a.org", "x", ("url_not_http",)),
    ("users", 5.0, "users", False, None, None, 2024, _URL, "  ", ("missing_context",)),
    ("price", -5.0, None, False, None, None, 2500, None, None, ("negative_value,missing_unit,year_out_of_bounds,missing_url,missing_context",)),
)


@query("structural_codes", expected(_STRUCTURES, "errors", "VARCHAR"))
def structural_codes(spark, sf):
    df = dealt(spark, sf, _STRUCTURES, "metric string, value double, unit string, is_range_or_approximate boolean, range_min double, range_max double, year int, source_url string, source_context string")
    return df.select("s_suppkey", F.array_join(ev.structural_errors(df), ",").alias("errors"))


# -- relevance, scope, rejection ----------------------------------------------------------------

_EDU = ("India", "education technology", "college students", "coding platform")
_GOV, _WEB = "https://data.census.gov/a", "https://acme.example/a"
# metric, unit, context, place, year, value, url; target place, industry, customer, product;
# geography, industry, overall, scope and rejection
_RELEVANCES = (
    ("college students", "students", "college students use a coding platform in education technology", "India", 2024, 1e6, _GOV, *_EDU, (100.0, 95.0, 98.2, "Serviceable market", None)),
    ("output", "tonnes", "crude steel from a blast furnace", "India", 2024, 5.0, _GOV, *_EDU, (100.0, 0.0, 0.0, "Unrelated market", "UNRELATED_INDUSTRY")),
    ("coding learners", "learners", "students in germany", "Germany", 2024, 1000.0, _GOV, *_EDU, (10.0, 30.0, 65.7, "Adjacent market", "GEOGRAPHY_MISMATCH")),
    ("total education market", "USD", "the total education market is known", "Global", None, 5e9, _GOV, *_EDU, (50.0, 75.0, 60.0, "Parent market", None)),
    ("market share", "%", "in india", None, None, 12.0, _GOV, "India", None, "college students", None, (100.0, 80.0, 79.0, "Obtainable market", None)),
    ("coding platform revenue", "USD", "as stated", "India", None, 5e9, _GOV, "India", None, None, "coding platform", (100.0, 80.0, 88.0, "Addressable market", None)),
    ("online classes", "seats", "as stated", "India", None, 500.0, _GOV, "India", None, None, "coding platform", (100.0, 80.0, 79.0, "Relevant market", None)),
    ("hats", "boxes", "sold worldwide", None, 2010, None, _WEB, *_EDU, (50.0, 30.0, 31.0, "Adjacent market", "LOW_RELEVANCE")),
    ("shops", "units", "in chennai", None, None, 500.0, _GOV, "India", None, None, None, (100.0, 80.0, 81.0, "Relevant market", None)),
    ("page number", "users", "as stated", None, None, 5.0, _GOV, None, None, None, None, (90.0, 80.0, 5.0, "Unrelated market", "NO_MARKET_SIZING_CLAIM")),
    ("helpline", "users", "as stated", None, None, 5.0, _GOV, "Global", None, None, None, (90.0, 80.0, 0.0, None, "NOISE_CONTACT_INFO")),
)


@query("relevance_dimensions", expected(_RELEVANCES, "geography_score industry_score relevance_score market_scope rejection", "DOUBLE DOUBLE DOUBLE VARCHAR VARCHAR"))
def relevance_dimensions(spark, sf):
    df = dealt(spark, sf, _RELEVANCES, "metric string, unit string, source_context string, geography string, year int, value double, source_url string, "
                                       "target_geography string, target_industry string, target_customer string, target_product string")
    df = df.withColumns({"source_name": F.lit(None).cast("string"), "is_range_or_approximate": F.lit(False), "notes": F.lit(None).cast("string")})
    out = ev.relevance(ev.score_sources(df))
    return out.select("s_suppkey", "geography_score", "industry_score", "relevance_score", "market_scope", F.col("relevance_rejection").alias("rejection"))


# -- percentages and money ----------------------------------------------------------------------

# value, metric, context, place; rejection and slot. The business: a tutoring platform for tutors in India.
_PERCENTS = (
    (140.0, "share of buyers", "as stated", "India", ("out_of_bounds", None)), (40.0, "share of buyers", "demand is growing fast", "India", ("growth", None)),
    (40.0, "share of buyers", "a change of x +40% in all", "India", (None, None)), (40.0, "share of buyers", "the churn of clients is known", "India", ("operational", None)),
    (40.0, "share of buyers", "students are female there", "India", ("demographic", None)), (40.0, "share of buyers", "as stated", "Japan", ("foreign_place", None)),
    (40.0, "share of buyers", "the share in europe is known", "India", ("foreign_place", None)), (40.0, "share of buyers", "tutors hold a part, pet food alone is 40", "India", ("unrelated_product", None)),
    (40.0, "share of buyers", "pet food is large, tutors use the platform for 40", "India", (None, "segment_pct")), (40.0, "share of buyers", "the market leader holds this part", "India", ("competitor_share", None)),
    (40.0, "regional market share", "as stated for india", "India", (None, "geo_pct")), (40.0, "part", "the obtainable market share of a newcomer", "India", (None, "share")),
    (40.0, "part", "tutors represent this portion of the market", "India", (None, "segment_pct")), (40.0, "part", "as stated", "India", (None, None)),
)


def _business_items(df, unit, kind):
    k = F.col("s_suppkey")
    defaults = {
        "request_id": F.concat(F.lit("r"), k.cast("string")), "business_idea": F.lit("tutoring platform for tutors"), "target_geography": F.lit("India"), "target_year": F.lit(2025),
        "target_customer": F.lit("tutors"), "unit": unit, "metric_type": kind, "year": F.lit(2025), "range_min": F.lit(None).cast("double"), "range_max": F.lit(None).cast("double"),
        "raw_value_expression": F.concat(F.col("value").cast("string"), F.lit("x")), "candidate_id": k.cast("string"), "is_valid": F.lit(True),
        "source_quality_tier": F.lit(terms.TIER_1), "lifecycle_stage": F.lit("validated"),
    }
    return df.withColumns({n: v for n, v in defaults.items() if n not in df.columns})


@query("percent_branches", expected(_PERCENTS, "rejection slot", "VARCHAR VARCHAR"))
def percent_branches(spark, sf):
    items = _business_items(dealt(spark, sf, _PERCENTS, "value double, metric string, source_context string, geography string"), F.lit("%"), F.lit("market_share"))
    why = opd._prepared(items).select("s_suppkey", "candidate_id", opd.percent_rejection().alias("rejection"))
    return why.join(opd.operand_candidates(items).select("candidate_id", "slot"), "candidate_id", "left").select("s_suppkey", "rejection", "slot")


# metric, value, unit, type, context, place; slot
_AMOUNTS = (
    ("market size", 5e9, "USD", "market_size", "as stated", "India", ("macro",)), ("energy tariff", 5e9, "USD", None, "as stated", "India", (None,)),
    ("round", 5e7, "USD", None, "the firm raised it in a seed round", "India", (None,)), ("sales", 5e8, "USD", None, "its revenue as told", "India", (None,)),
    ("tutoring", 5e6, "USD", "market_size", "spent per student", "India", ("price",)), ("subscription price", 90.0, "INR", "subscription_price", "as stated", "India", ("price",)),
    ("market size", 5e9, "USD", "market_size", "as stated", "China", (None,)), ("market size", 5e9, "EUR", "market_size", "as stated", None, ("macro",)),
    ("number of students", 5e6, "students", "student_count", "as stated", "India", ("customers",)), ("urban students", 5e5, "students", "student_count", "as stated", "India", ("serviceable",)),
    ("forecast of students", 5e6, "students", "student_count", "as stated", "India", (None,)), ("rooms", 500.0, "rooms", None, "as stated", "India", (None,)),
    ("students", 2024.0, "students", "student_count", "2020 to 2024", "India", ("customers",)), ("market value", 2e6, "rupees", None, "as stated", "India", ("macro",)),
)


@query("operand_branches", expected(_AMOUNTS, "slot", "VARCHAR"))
def operand_branches(spark, sf):
    items = _business_items(dealt(spark, sf, _AMOUNTS, "metric string, value double, unit string, metric_type string, source_context string, geography string"), None, None)
    slots = opd.operand_candidates(items).select(F.col("candidate_id").cast("long").alias("s_suppkey"), "slot")
    return corpus.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")).join(slots, "s_suppkey", "left")


# value, metric, unit, context; the seven slots of one request, filled by its best items
_SLOTTED = (
    (5e9, "market size", "USD", "as stated", ("macro", 5e9)), (90.0, "subscription price", "USD", "as stated", ("price", 90.0)), (6e6, "number of students", "students", "as stated", ("customers", 6e6)),
    (7e5, "urban students", "students", "as stated", ("serviceable", 7e5)), (30.0, "regional market share", "%", "as stated for india", ("geo_pct", 30.0)),
    (20.0, "part", "%", "tutors represent this portion of the market", ("segment_pct", 20.0)), (10.0, "part", "%", "the obtainable market share of a newcomer", ("share", 10.0)),
)


@query("operand_slots", expected(_SLOTTED, "slot value", "VARCHAR DOUBLE").replace("SELECT s_suppkey,", "SELECT 'r' || s_suppkey // 7 AS request_id,"))
def operand_slots(spark, sf):
    """Requests of seven suppliers, one item per slot: the pivoted operands, as rows again."""
    items = _business_items(dealt(spark, sf, _SLOTTED, "value double, metric string, unit string, source_context string"), None, F.lit(None).cast("string"))
    items = items.withColumns({"request_id": F.concat(F.lit("r"), F.floor(F.col("s_suppkey") / 7).cast("string")), "geography": F.lit("India")})
    p = opd.pivot_operands(opd.best_operands(opd.operand_candidates(items)))
    rows = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"{s}.value").alias("value")) for s in opd.SLOTS])
    return p.select("request_id", F.explode(rows).alias("x")).select("request_id", "x.*").filter("value IS NOT NULL")


# -- catalogue ----------------------------------------------------------------------------------

_CATALOGUE = (
    ("sec.gov", ("company_filing",)), ("investor.acme.com", ("company_filing",)), ("stats.gov.uk", ("official_government",)), ("data.nic.in", ("official_government",)),
    ("who.int", ("official_government",)), ("mit.edu", ("academic_institution",)), ("iitm.ac.in", ("academic_institution",)), ("arxiv.org", ("academic_institution",)),
    ("www.gartner.com", ("industry_analyst",)), ("in.reuters.com", ("reputable_news",)), ("acme.example", ("other",)), ("", ("other",)), ("notreuters.com", ("other",)),
)


@query("source_categories", expected(_CATALOGUE, "category", "VARCHAR"))
def source_categories(spark, sf):
    return dealt(spark, sf, _CATALOGUE, "domain string").select("s_suppkey", src.source_category(F.col("domain")).alias("category"))
