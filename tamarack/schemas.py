"""Table schemas."""

from __future__ import annotations

# One number of a formula with its provenance: (field, type) in order.
OPERAND_FIELDS = (
    ("name", "string"), ("value", "double"), ("unit", "string"), ("currency", "string"), ("year", "int"),
    ("geography", "string"), ("range_min", "double"), ("range_max", "double"), ("is_assumption", "boolean"),
    ("is_user_provided", "boolean"), ("is_conflict", "boolean"), ("lifecycle_stage", "string"),
    ("source_quality_tier", "string"), ("source_url", "string"), ("source_name", "string"), ("published_year", "int"),
    ("confidence", "string"), ("data_type", "string"), ("assumption_justification", "string"),
    ("entity_concept", "string"), ("market_scope", "string"), ("is_prior_year", "boolean"), ("evidence_id", "string"),
)
OPERAND_DDL = "struct<" + ",".join(f"{n}:{t}" for n, t in OPERAND_FIELDS) + ">"

ASSUMPTION_DDL = "struct<name:string,value:double,unit:string,justification:string,is_user_provided:boolean>"

SINGLE_OPERANDS = (
    "macro", "geo_pct", "segment_pct", "td_share",
    "customers", "base_organizations", "base_segment_pct", "serviceable", "target_customer_pct", "obtainable",
    "bu_share", "pricing", "providers", "seats", "volume",
)
OPERAND_LISTS = ("segment_percentages", "other_filters")

# One row per market-sizing request.
SIZING_REQUEST_DDL = (
    "request_id string, business_idea string, target_geography string, target_year int, "
    "pricing_basis string, pricing_frequency string, "
    + ", ".join(f"{c} {OPERAND_DDL}" for c in SINGLE_OPERANDS)
    + ", "
    + ", ".join(f"{c} array<{OPERAND_DDL}>" for c in OPERAND_LISTS)
    + f", assumptions array<{ASSUMPTION_DDL}>"
)

CLAIMS_DDL = (
    "candidate_id string, metric string, metric_type string, value double, raw_value_expression string, unit string, "
    "geography string, year int, is_range_or_approximate boolean, range_min double, range_max double, "
    "source_name string, source_url string, source_context string, extraction_confidence string, notes string"
)
DOCUMENTS_DDL = (
    "original_url string, final_url string, title string, content string, content_type string, http_status int, "
    "fetch_status string, source_name string, content_length_bytes bigint"
)
SOURCES_DDL = (
    "title string, url string, snippet string, source_name string, domain string, category string, "
    "source_quality_tier string, relevance_score double"
)
RESEARCH_QUERIES_DDL = (
    "request_id string, query_no int, metric_required string, geography string, year int, industry_topic string, "
    "target_population string, max_results int"
)
EVIDENCE_ITEMS_DDL = (
    "metric string, value double, unit string, geography string, year int, source_name string, source_url string, "
    "source_type string, confidence string, evidence_status string"
)
PROGRESS_EVENTS_DDL = (
    "pipeline_id string, stage string, status string, message string, progress_percent int, ts timestamp"
)
STORED_ANALYSES_DDL = (
    "analysis_id string, business_idea string, status string, confidence string, created_at string, "
    "completed_at string, business_analysis string, evidence_summary string, discovered_sources string, "
    "fetched_sources string, extracted_candidates string, validation_results string, triangulation_result string, "
    "calculation_report string, tam string, sam string, som string, competitors string, assumptions string, "
    "warnings string, errors string, final_result string"
)
