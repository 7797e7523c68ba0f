"""Request tables: clean-up, completeness, derived business fields, research queries, sizing inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import operand as op
from tamarack.functions.once import computed_once
from tamarack.functions.measures import revenue_per_customer
from tamarack.functions.text import has_any, has_any_word, low
from tamarack.schemas import ASSUMPTION_DDL

# Request columns and types; a table may lack any of them but ``request_id`` and ``business_idea``.
REQUEST_COLUMNS = {
    "request_id": "string", "business_idea": "string", "business_name": "string", "target_country": "string",
    "preferred_geography": "string", "preferred_year": "int", "customer_type": "string", "industry": "string",
    "product": "string", "product_description": "string", "target_customer_segment": "string", "market_category": "string",
    "healthcare_saas_category": "string", "organization_size": "string", "target_region": "string",
    "target_state_or_region": "string", "target_city": "string", "pricing_basis": "string", "pricing_model": "string",
    "monthly_price": "double", "annual_price": "double", "per_user_price": "double", "per_provider_price": "double",
    "per_facility_price": "double", "currency": "string", "number_of_organizations": "double", "number_of_employees": "double",
    "serviceable_organizations": "double", "serviceable_percentage": "double", "geographic_reach_percentage": "double",
    "expected_customer_acquisition_annual": "double", "sales_team_size": "int", "sales_cycle_months": "double",
    "clinical_use": "boolean", "emr_ehr_integration_required": "boolean", "interoperability_standards": "string",
    "regulatory_market": "string", "regulatory_constraints": "string", "allow_estimated_pricing": "boolean",
    "max_sources": "int", "assumptions": f"array<{ASSUMPTION_DDL}>",
}


def complete_columns(requests: DataFrame) -> DataFrame:
    """Declared request columns in order, missing ones null, unknown ones dropped."""
    return requests.select(*[
        (F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in REQUEST_COLUMNS.items()
    ])


def _meaningful(col: Column) -> Column:
    return F.when(~low(col).isin(*terms.PLACEHOLDERS), F.trim(col))


def clean_requests(requests: DataFrame) -> DataFrame:
    """Placeholders to null, aliases filled from each other, impossible years to null."""
    df = complete_columns(requests)
    country, other = _meaningful(F.col("target_country")), _meaningful(F.col("preferred_geography"))
    region, state = F.col("target_region"), F.col("target_state_or_region")
    return df.withColumns({
        "business_idea": F.trim("business_idea"),
        "target_country": F.coalesce(country, other), "preferred_geography": F.coalesce(other, country),
        "target_region": F.coalesce(region, state), "target_state_or_region": F.coalesce(state, region),
        "pricing_model": F.coalesce("pricing_model", "pricing_basis"), "pricing_basis": F.coalesce("pricing_basis", "pricing_model"),
        "preferred_year": F.when(F.col("preferred_year").between(1900, 2100), F.col("preferred_year")),
    })


# Words that state a place, a customer or a price in an idea.
_PLACES_IN_IDEA = ("india", "us", "usa", "united states", "uk", "united kingdom", "canada", "australia", "germany", "singapore",
                   "uae", "chennai", "mumbai", "delhi", "bangalore", "hyderabad", "pune")
_CUSTOMERS_IN_IDEA = (
    "hospital", "hospitals", "clinic", "clinics", "doctor", "doctors", "dentist", "dentists", "physician",
    "physicians", "practice", "practices", "patient", "patients", "lab", "labs", "student", "students", "developer",
    "developers", "college", "colleges", "school", "schools", "enterprise", "enterprises", "team", "teams", "user",
    "users", "smb", "smbs", "client", "clients", "firm", "firms", "startup", "startups", "organization",
    "organizations", "merchant", "merchants", "diagnostic", "pathology", "pharmacy", "pharmacies", "nursing home",
    "insurance", "payer", "radiology", "university", "universities", "company", "companies", "business",
    "businesses",
)
_PRICING_IN_IDEA = ("per month", "/month", "per year", "/year", "annual subscription", "monthly subscription", "per doctor",
                    "per clinic", "per hospital", "per user", "per seat", "per employee", "per team", "rs", "inr", "usd", "$", "₹",
                    "pricing", "subscription", "tier", "plan", "freemium")


def missing_fields(requests: DataFrame) -> DataFrame:
    """Add ``missing_fields``: what a request lacks, with the conditional clinical rules."""
    idea = low(F.col("business_idea"))
    prices = [F.col(c) for c in ("monthly_price", "annual_price", "per_provider_price", "per_facility_price", "per_user_price")]
    priced = F.lit(False)
    for p in prices:
        priced = priced | F.coalesce(p > 0, F.lit(False))
    assumed = F.coalesce(F.exists("assumptions", lambda a: has_any(F.lower(a["name"]), ("pricing", "arpu", "price"))), F.lit(False))
    named = _meaningful(F.col("pricing_basis")).isNotNull() | _meaningful(F.col("pricing_model")).isNotNull()
    has_price = priced | assumed | named | F.coalesce("allow_estimated_pricing", F.lit(False)) | has_any(idea, _PRICING_IN_IDEA)
    category = low(F.col("healthcare_saas_category"))
    records = (
        has_any(category, ("ehr", "emr")) | has_any(idea, ("electronic health record", "electronic medical record"))
        | has_any_word(idea, ("ehr", "emr"))
    )
    clinical_ai = has_any(category, ("ai", "clinical decision support")) | has_any(
        idea, ("healthcare ai", "clinical ai", "ai diagnostic", "decision support")
    )
    country = F.coalesce(_meaningful(F.col("target_country")), _meaningful(F.col("preferred_geography")))
    return requests.withColumn("missing_fields", F.array_compact(F.array(
        F.when(F.length(idea) < 3, "business_idea"),
        F.when(country.isNull() & ~has_any_word(idea, _PLACES_IN_IDEA), "target_country"),
        F.when(_meaningful(F.col("customer_type")).isNull() & ~has_any_word(idea, _CUSTOMERS_IN_IDEA), "customer_type"),
        F.when(~has_price, "pricing_basis"),
        F.when((records | clinical_ai) & F.col("clinical_use").isNull(), "clinical_use"),
        F.when(records & F.col("emr_ehr_integration_required").isNull() & (low(F.col("interoperability_standards")) == ""),
               "emr_ehr_integration_required"),
    )))


# Ordered keyword rules (fixed values): first rule with a hit gives the value.
_HEALTH_CATEGORY = (
    ("Hospital Management SaaS", ("hospital management", "hims", "his", "hospital information", "bed management")),
    ("Clinic Management SaaS", ("clinic management", "outpatient clinic", "polyclinic")),
    ("EHR/EMR SaaS", ("ehr", "emr", "electronic health record", "electronic medical record", "medical charting")),
    ("Telemedicine SaaS", ("telemedicine", "telehealth", "video consult", "virtual doctor", "remote consultation")),
    ("Medical Billing & Revenue Cycle Management (RCM) SaaS", ("billing", "revenue cycle", "rcm", "insurance claim", "medical coding", "tpa claim")),
    ("Patient Engagement & Portal SaaS", ("patient engagement", "patient portal", "patient app", "treatment adherence", "health companion")),
    ("Dental Practice Management SaaS", ("dental", "dentist")),
    ("Laboratory & Diagnostic Management SaaS", ("lab", "pathology", "lims")),
    ("Diagnostic Imaging & PACS SaaS", ("radiology", "pacs", "dicom", "imaging", "x-ray", "mri", "ct scan")),
    ("Remote Patient Monitoring (RPM) SaaS", ("rpm", "remote patient monitoring", "vitals monitoring", "wearable health", "tele-monitoring")),
    ("Pharmacy Management SaaS", ("pharmacy", "drug inventory", "e-prescription")),
    ("Healthcare AI & Clinical Decision Support SaaS", ("ai diagnostic", "clinical ai", "decision support")),
    ("Healthcare Analytics & BI SaaS", ("analytics", "healthcare bi", "clinical intelligence")),
    ("Clinic Management SaaS", ("healthcare", "medical", "clinic", "hospital")),
)
_CUSTOMER_TYPE = (
    ("Hospitals", ("hospital", "tertiary care")),
    ("Dental Clinics", ("dental", "dentist")),
    ("Diagnostic Laboratories", ("diagnostic", "pathology", "radiology lab", "imaging center")),
    ("Pharmacies", ("pharmacy", "pharmacies", "chemist")),
    ("Nursing Homes & Long-Term Care", ("nursing home", "elder care", "assisted living")),
    ("Telemedicine Providers", ("telemedicine provider", "telehealth company")),
    ("Payers & Health Insurance Organizations", ("insurance", "payer", "tpa", "health plan")),
    ("Medical Practices", ("doctor", "physician", "practitioner", "solo practice")),
    ("Clinics", ("clinic",)),
)
_PRICING_MODEL = (
    ("per_provider", ("per doctor", "per physician", "per provider", "per-doctor", "per-provider")),
    ("per_facility", ("per clinic", "per hospital", "per facility", "per-clinic", "per-facility", "per-hospital")),
    ("per_user", ("per user", "per seat", "per staff", "per-user")),
    ("annual_subscription", ("annual", "yearly")),
    ("monthly_subscription", ("month", "subscription")),
)
_COUNTRIES = ("India", "United States", "USA", "UK", "United Kingdom", "Canada", "Australia", "Germany", "Singapore", "UAE")
_VAGUE_PRICING = ("premium", "cheap", "affordable", "budget", "luxury", "low-cost", "high-cost", "none", "null")
_REGULATION = (
    ("ABDM (Ayushman Bharat Digital Mission) / NABH / DISHA", ("india", "bharat")),
    ("HIPAA / HITECH / FDA 510(k) (if clinical AI)", ("us", "usa", "united states", "america")),
    ("NHS Data Security and Protection Toolkit (DSPT) / DCB0129 / NICE", ("uk", "united kingdom", "nhs")),
    ("EU MDR / GDPR / DiGA (Germany)", ("europe", "germany", "france", "eu")),
)


def _first_rule(text: Column, rules, default=None) -> Column:
    out = None
    for value, words in rules:
        hit = has_any(text, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(default)) if default is not None else out


def derive_business(requests: DataFrame) -> DataFrame:
    """Business fields derived from the idea text; whatever the request states itself stays.

    Fills ``healthcare_saas_category, customer_type, target_country, product, pricing_model, clinical_use,
    emr_ehr_integration_required, regulatory_market`` and adds ``business_model``.
    """
    text = F.trim(F.coalesce("business_idea", F.lit("")))
    df = requests.withColumn("_t", F.lower(text))
    t = F.col("_t")
    df = df.withColumns({
        "healthcare_saas_category": F.coalesce("healthcare_saas_category", _first_rule(t, _HEALTH_CATEGORY)),
        "customer_type": F.coalesce("customer_type", _first_rule(t, _CUSTOMER_TYPE)),
    })
    place = None
    for name in _COUNTRIES:
        hit = text.rlike(rf"(?i)\b(?:in|across|for)\s+{name}\b") | t.endswith(f"in {name.lower()}")
        place = F.when(hit, name) if place is None else place.when(hit, name)
    vague = low(F.col("pricing_model")).isin(*_VAGUE_PRICING)
    df = df.withColumns({
        "target_country": F.coalesce("target_country", place),
        "product": F.coalesce("product", "healthcare_saas_category", F.when(F.length(text) < 60, text).otherwise("Healthcare SaaS Platform")),
        "business_model": F.lit("B2B SaaS"),
        "pricing_model": F.when(F.col("pricing_model").isNotNull(), F.when(~vague, F.col("pricing_model"))).otherwise(_first_rule(t, _PRICING_MODEL)),
    })
    category = low(F.col("healthcare_saas_category"))
    return df.withColumns({
        "clinical_use": F.coalesce("clinical_use", has_any(category, ("ehr", "emr", "diagnostic", "ai", "clinical", "monitoring", "rpm", "imaging", "pacs"))),
        "emr_ehr_integration_required": F.coalesce("emr_ehr_integration_required", has_any(category, ("ehr", "emr", "hims", "his", "hospital", "interoperability", "pacs"))),
        "regulatory_market": F.coalesce("regulatory_market", _first_rule(low(F.col("target_country")), _REGULATION, "Local Health Data Privacy & Security Regulations")),
    }).drop("_t")


_STRATEGY_STOP = ("for", "the", "and", "with", "market", "service", "platform", "app", "software")


def market_strategy(requests: DataFrame) -> DataFrame:
    """Add ``tam_method, market_definition, evidence_requirements, relevant_terms``."""
    model = low(F.col("pricing_model"))
    product = F.coalesce("product", "product_description", F.lit("B2B SaaS Solution"))
    category = F.coalesce("healthcare_saas_category", "market_category", F.lit("B2B SaaS"))
    customer = F.coalesce("customer_type", F.lit("Businesses"))
    target = F.coalesce("target_customer_segment", customer)
    where = F.coalesce(F.concat(F.lit(" in "), F.col("target_country")), F.lit(""))
    words = F.lower(F.concat_ws(
        " ", product, category, customer, target, "industry", F.lit("b2b saas hospital clinic medical emr ehr software platform")
    ))
    return requests.withColumns({
        "tam_method": F.when(has_any(model, ("provider", "doctor", "physician")), "bottom_up_per_provider_pricing")
        .when(has_any(model, ("facility", "hospital", "clinic", "practice", "store", "plant", "location")), "bottom_up_per_facility_pricing")
        .otherwise("bottom_up_customer_arpu"),
        "market_definition": F.concat(category, F.lit(" market serving "), target, where),
        "evidence_requirements": F.array(
            F.concat(F.lit("Total count of potential "), F.lower(customer), where),
            F.concat(F.lit("Average annual contract value for "), category, where),
            F.concat(F.lit("Total market spend for "), category, F.lit(" software"), where),
        ),
        "relevant_terms": F.array_sort(F.filter(
            F.array_distinct(F.regexp_extract_all(words, F.lit("[a-zA-Z]{3,}"), F.lit(0))), lambda w: ~w.isin(*_STRATEGY_STOP)
        )),
    })


# -- research queries ---------------------------------------------------------------------------


def research_queries(requests: DataFrame, wording: str = "general") -> DataFrame:
    """Three query rows per request: population, market size, price. ``wording`` is ``general`` or ``saas``."""
    geo = F.coalesce("target_country", "preferred_geography")
    year = F.coalesce("preferred_year", F.lit(2025))
    most = F.nullif(F.coalesce("max_sources", F.lit(5)), F.lit(0))  # 0: no limit
    none = F.lit(None).cast("string")
    if wording == "saas":
        place = F.coalesce(geo, F.lit("India"))
        cat = F.coalesce("healthcare_saas_category", "market_category", "industry", "product", F.lit("B2B SaaS"))
        cust = F.coalesce("customer_type", F.lit("Businesses"))
        rows = [
            (F.concat(F.lit("total number of "), F.lower(cust), F.lit(" in "), place), place, F.concat(cat, F.lit(" / Target Population")), cust),
            (F.concat_ws(" ", place, cat, F.lit("market size annual revenue")), place, cat, none),
            (F.concat_ws(" ", cat, F.lit("software pricing average annual subscription cost"), place), place, cat, none),
        ]
        fallback = None
    else:
        cat = F.coalesce("market_category", "industry", "product", F.lit("market"))
        cust = F.coalesce("target_customer_segment", "customer_type", F.lit("customers"))
        topic = F.coalesce("industry", cat)
        rows = [
            (F.concat_ws(" ", geo, cust, F.lit("population count businesses number users")), geo, topic, cust),
            (F.concat_ws(" ", geo, cat, F.lit("market size annual revenue")), geo, topic, none),
            (F.concat_ws(" ", geo, F.coalesce("product", cat), F.lit("pricing average annual spend subscription ARPU fee cost")), geo, topic, none),
        ]
        analysed = F.coalesce("market_category", "industry", "product", "target_customer_segment", "customer_type").isNotNull()
        fallback = (analysed, (F.concat_ws(" ", geo, F.lit("target customer population and market size")), geo, none, none))

    def row(no: int, parts) -> Column:
        metric, place, topic, population = parts
        return F.struct(
            F.lit(no).alias("query_no"), metric.alias("metric_required"), place.alias("geography"), year.alias("year"),
            topic.alias("industry_topic"), population.alias("target_population"), most.alias("max_results"),
        )

    queries = F.array(*[row(i + 1, r) for i, r in enumerate(rows)])
    if fallback is not None:
        queries = F.when(fallback[0], queries).otherwise(F.array(row(1, fallback[1])))
    return requests.select("request_id", F.explode(queries).alias("q")).select("request_id", "q.*")


def unified_query(requests: DataFrame, wording: str = "general") -> DataFrame:
    """One combined query per request."""
    geo = F.coalesce("target_country", "preferred_geography")
    if wording == "saas":
        place = F.coalesce(geo, F.lit("India"))
        cat = F.coalesce("healthcare_saas_category", "market_category", "product", F.lit("B2B SaaS"))
        cust = F.coalesce("customer_type", F.lit("Businesses"))
        metric = F.concat(F.lit("total number of "), cust, F.lit(" and "), cat, F.lit(" in "), place)
        topic, population = cat, cust
        year = F.coalesce("preferred_year", F.lit(2025))
    else:
        place = F.coalesce(geo, F.lit("Global"))
        topic_text = F.coalesce("market_category", "product", "industry", "business_idea")
        cust = F.coalesce("target_customer_segment", "customer_type")
        named_place = F.when(~F.lower(place).isin("global", "unknown"), place)
        extra = F.when(~F.lower(topic_text).contains(F.lower(cust)), cust)
        metric = F.concat_ws(" ", named_place, topic_text, extra, F.lit("market size revenue growth volume customer count spend"))
        topic, population = F.coalesce("industry", "product", topic_text), cust
        year = F.coalesce("preferred_year", F.lit(2026))
    return requests.select(
        "request_id", F.lit(1).alias("query_no"), metric.alias("metric_required"), place.alias("geography"), year.alias("year"),
        topic.alias("industry_topic"), population.alias("target_population"), F.nullif(F.coalesce("max_sources", F.lit(5)), F.lit(0)).alias("max_results"),
    )


# -- first-match sizing inputs ------------------------------------------------------------------


def first_match_inputs(items: DataFrame) -> DataFrame:
    """Per request the items that the first-match policy takes, one aggregate pass over the claims.

    Gives struct columns ``best_count`` (by suitability), ``first_price, first_percent, first_serviceable,
    first_macro, first_share, first_cagr, begin_value, end_value``. Item order is (url, id).
    """
    order = F.struct("source_url", "candidate_id")
    item = F.struct("metric", "value", "unit", "year", "geography", "source_url", "source_name", "source_quality_tier", "metric_type", "candidate_id")
    metric, v, unit = low(F.col("metric")), F.col("value"), F.col("unit")
    percent = unit.isin(*terms.PERCENT_UNITS)
    suit = F.col("suitability")
    rank = (
        F.when(suit.isNull(), 2).when(~suit["geographic_match"], 0)
        .when((suit["overall"] == "HIGH") & suit["customer_type_match"], 4)
        .when((suit["overall"] == "MEDIUM") & suit["customer_type_match"], 3)
        .when(suit["customer_type_match"], 2).otherwise(1)
    )
    countable = (v > 0) & ~unit.isin(*terms.PERCENT_UNITS, "INR", "USD", "INR/month", "INR/year")
    priced = (v != 0) & (v < 10_000_000) & (has_any(metric, ("price", "arpu", "subscription")) | unit.isin("INR", "USD", "INR/month", "INR/year"))
    share = percent & (v > 0) & (v <= 100)
    adoption = share & has_any(metric, ("serviceable", "adoption", "digitized", "emr", "ehr", "abdm", "nabh", "penetration", "segment"))
    served = ~percent & (F.col("market_scope") == "Serviceable market") & (v > 0)
    macro_words = ("market", "industry", "spending", "tam", "software")
    macro = (v > 10_000_000) & (
        F.coalesce("metric_type", F.lit("")).contains("market_size") | has_any(metric, macro_words + ("usd", "inr", "billion", "crore"))
        | has_any(low(F.col("source_context")), macro_words)
    )
    growth = (v > 0) & (v <= 100) & has_any(metric, ("cagr", "growth"))

    def first(test: Column) -> Column:
        return F.min_by(F.when(test, item), F.when(test, order))

    return items.filter("is_valid").groupBy("request_id").agg(
        F.min_by(F.when(countable, item), F.when(countable, F.struct(-rank, order))).alias("best_count"),
        first(priced).alias("first_price"),
        F.min_by(F.when(adoption | served, F.struct(adoption.alias("is_percent"), item.alias("item"))), F.when(adoption | served, order)).alias("first_serviceable"),
        first(macro).alias("first_macro"), first(share).alias("first_percent"), first(growth).alias("first_cagr"),
        first((F.col("year") <= 2024) & (v > 1_000_000)).alias("begin_value"),
        first((F.col("year") >= 2028) & (v > 1_000_000)).alias("end_value"),
    )


def _from_item(item: Column, name: str, **fields) -> Column:
    made = op.operand(
        F.coalesce(item["metric"], F.lit(name)), item["value"], F.coalesce(item["unit"], F.lit("units")),
        year=F.coalesce(item["year"], F.lit(2024)), source_url=item["source_url"], source_name=item["source_name"],
        source_quality_tier=item["source_quality_tier"], data_type="sourced", evidence_id=item["candidate_id"], **fields,
    )
    return F.when(item.isNotNull(), made)


def _benchmark(requests: DataFrame, name: str) -> Column:
    return F.col(name) if name in requests.columns else F.lit(None).cast("double")


def first_match_requests(requests: DataFrame, inputs: DataFrame) -> DataFrame:
    """Sizing requests by the first-match policy.

    Customers, price, serviceability, obtainable capacity and macro size come from the request, else from
    the first fitting item, else from benchmark columns the caller joined on (``benchmark_customers,
    benchmark_revenue, benchmark_serviceable_pct``), which are marked as assumptions. Without a benchmark
    the slot stays empty.
    """
    df = requests.join(inputs, "request_id", "left")
    geo = F.coalesce("target_country", F.lit("India"))
    currency = F.coalesce("currency", F.lit("INR"))
    label = F.coalesce("customer_type", F.lit("facilities"))

    def positive(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name))

    def stated(name: str, value: Column, unit: Column, **f) -> Column:
        made = op.operand(name, value, unit, geography=geo, data_type="USER_PROVIDED", **f)
        return F.when(value.isNotNull(), made)

    bench_n = _benchmark(df, "benchmark_customers")
    customers = F.coalesce(
        stated("User specified count", positive("number_of_organizations"), label, year=2025, source_name="User Input"),
        _from_item(F.col("best_count"), "customers", geography=geo),
        F.when(bench_n.isNotNull(), op.operand("Benchmark customer count", bench_n, label, geography=geo, data_type="estimated", is_assumption=True)),
    )
    assumptions = F.coalesce("assumptions", F.array().cast(f"array<{ASSUMPTION_DDL}>"))

    def first_assumption(*words: str, deny=()) -> Column:
        return F.try_element_at(F.filter(
            assumptions, lambda a: has_any(F.lower(a["name"]), words) & (~has_any(F.lower(a["name"]), deny) if deny else F.lit(True))
        ), F.lit(1))

    p_assumed = first_assumption("price", "pricing", "arpu", "subscription")
    request_price = F.coalesce(*[positive(c) for c in ("monthly_price", "annual_price", "per_facility_price", "per_provider_price", "per_user_price")])
    arpu = revenue_per_customer(df, _benchmark(df, "benchmark_revenue"))
    name = F.concat(F.lit("Price ("), F.coalesce("pricing_basis", F.lit("per_facility")), F.lit(")"))
    price_value = F.coalesce(request_price, p_assumed["value"], F.col("first_price.value"), arpu)
    monthly = F.coalesce(F.col("monthly_price") > 0, F.lit(False))
    price_assumed = request_price.isNull() & (p_assumed.isNotNull() | F.col("first_price").isNull())
    pricing = F.when(price_value.isNotNull(), op.operand(
        name, price_value, F.concat(currency, F.lit("/year")), currency=currency, year=2025, geography=geo,
        is_assumption=price_assumed, source_url=F.when(request_price.isNull() & p_assumed.isNull(), F.col("first_price.source_url")),
    ))
    staff = positive("number_of_employees")
    basis = low(F.col("pricing_basis"))
    df = computed_once(df, {
        "_pricing": pricing, "_customers": customers,
        "_freq": F.when(monthly, "monthly").otherwise("annual"),
        "providers": F.when(basis.contains("provider") & staff.isNotNull(), op.operand("Providers Per Organization", staff, "providers", data_type="USER_PROVIDED")),
        "seats": F.when(has_any(basis, ("seat", "user")) & staff.isNotNull(), op.operand("Seats Per Organization", staff, "seats", data_type="USER_PROVIDED")),
    })

    sam_assumed = first_assumption("segment", "serviceable", "target_", "share", "reach", "pct", "percent", deny=("som", "obtainable", "acquisition", "capture"))
    srv_item = F.col("first_serviceable")
    srv = F.coalesce(
        stated("User-provided serviceable count", positive("serviceable_organizations"), label, year=2025, is_user_provided=True),
    )
    pct = F.coalesce(
        stated("User-provided serviceable share", positive("serviceable_percentage"), F.lit("%"), year=2025, is_user_provided=True),
        F.when(sam_assumed.isNotNull(), op.operand(sam_assumed["name"], sam_assumed["value"], "%", year=2025, is_assumption=True, is_user_provided=True,
                                                   assumption_justification=sam_assumed["justification"], data_type="USER_PROVIDED")),
        stated("Target geographic reach", positive("geographic_reach_percentage"), F.lit("%"), year=2025, is_user_provided=True),
    )
    nothing_stated = srv.isNull() & pct.isNull()
    item_srv = F.when(nothing_stated & ~srv_item["is_percent"], _from_item(srv_item["item"], "serviceable"))
    item_pct = F.when(nothing_stated & srv_item["is_percent"], _from_item(srv_item["item"], "serviceable share"))
    bench_pct = _benchmark(df, "benchmark_serviceable_pct")
    bench = F.when(nothing_stated & srv_item.isNull() & bench_pct.isNotNull(),
                   op.operand("Benchmark serviceable share", bench_pct, "%", year=2025, data_type="estimated", is_assumption=True))
    df = computed_once(df, {
        "serviceable": F.coalesce(srv, item_srv),
        "target_customer_pct": F.when(srv.isNull(), F.coalesce(pct, item_pct, bench)),
        "serviceability_constraints": F.array_compact(F.array(
            F.when(F.coalesce("target_state_or_region", "target_city").isNotNull(), F.concat(F.lit("Geographic serviceability: "), F.concat_ws(", ", "target_city", "target_state_or_region"))),
            F.when(F.coalesce("organization_size", "target_customer_segment").isNotNull(), F.concat(F.lit("Customer segment constraint: "), F.concat_ws(" ", "organization_size", "target_customer_segment"))),
            F.when(F.col("emr_ehr_integration_required"), F.concat(F.lit("Technical requirement: EMR/EHR Integration ("), F.coalesce("interoperability_standards", F.lit("HL7 FHIR / ABDM")), F.lit(")"))),
            F.when(F.coalesce("regulatory_market", "regulatory_constraints").isNotNull(), F.concat(F.lit("Regulatory constraint: "), F.concat_ws(" ", "regulatory_market", "regulatory_constraints"))),
        )),
    })

    base_count = F.coalesce(F.col("_customers.value"), F.lit(0.0))
    ceiling = F.coalesce(F.col("serviceable.value"), F.round(F.col("_customers.value") * (F.col("target_customer_pct.value") / 100.0), 0), base_count)
    som_assumed = first_assumption("som", "obtainable", "acquisition", "capture")
    customer = low(F.col("customer_type"))
    cycle = F.coalesce(
        positive("sales_cycle_months"),
        F.when(customer.contains("hospital"), 9.0).when(has_any(customer, ("diagnostic", "lab", "imaging", "pharmacy")), 4.0).otherwise(3.0),
    )
    deals = F.greatest(F.lit(1.0), F.lit(12.0) / cycle * 3.0)
    reach = F.coalesce(positive("geographic_reach_percentage") / 100.0, F.lit(1.0))
    capacity = F.coalesce(F.when(F.col("sales_team_size") != 0, F.col("sales_team_size")), F.lit(2)) * deals * reach
    sells = F.coalesce(F.col("healthcare_saas_category"), F.col("sales_team_size").cast("string"), F.col("sales_cycle_months").cast("string")).isNotNull()
    wanted = positive("expected_customer_acquisition_annual")
    df = computed_once(df, {"_ceil": ceiling})
    df = df.withColumn("_obt", F.when(wanted.isNotNull(), F.least(wanted, F.col("_ceil")))
        .when(som_assumed["value"].isNotNull(), F.round(F.col("_ceil") * (som_assumed["value"] / 100.0), 0))
        .when(sells, F.round(F.least(F.col("_ceil"), F.greatest(F.lit(1.0), capacity)), 0)))
    obt = F.col("_obt")
    high = F.round(F.greatest(obt, F.least(F.col("_ceil"), obt * 1.5)), 0)
    lo = F.least(F.round(F.greatest(F.lit(0.0), F.least(obt, obt * 0.5)), 0), high)
    obtainable = F.when(obt.isNotNull(), op.operand(
        "Obtainable customer acquisition capacity", obt, F.coalesce(F.col("_customers.unit"), label), year=2025, geography=geo,
        is_assumption=wanted.isNull(), range_min=lo, range_max=high, data_type=F.when(wanted.isNull() & som_assumed.isNull(), "derived").otherwise("USER_PROVIDED"),
    ))
    macro_item = F.col("first_macro")
    macro = _from_item(macro_item, "market size", geography=geo,
                       currency=F.when(macro_item["unit"].isin("USD", "INR", "EUR", "GBP"), macro_item["unit"]).otherwise(currency))
    none, empty = op.no_operand(), op.no_operands()
    return df.withColumns({
        "macro": macro, "geo_pct": F.when(macro.isNotNull(), _from_item(F.col("first_percent"), "Geographic Market Share", geography=geo)),
        "segment_pct": none, "td_share": none, "customers": F.col("_customers"), "base_organizations": none, "base_segment_pct": none,
        "obtainable": obtainable, "bu_share": none, "pricing": F.col("_pricing"), "volume": none,
        "segment_percentages": empty, "other_filters": empty,
        "target_geography": geo, "target_year": F.coalesce("preferred_year", F.lit(2025)), "pricing_frequency": F.col("_freq"),
        "assumptions": assumptions,
    }).drop("_pricing", "_customers", "_freq", "_ceil", "_obt", "best_count", "first_price", "first_serviceable", "first_macro", "first_percent")
