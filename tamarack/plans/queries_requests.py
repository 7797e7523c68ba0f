"""Registered queries: requests, classification, whole analyses."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tamarack.functions.measures import revenue_per_customer
from tamarack.functions.operand import is_usable, operand
from tamarack.operators import classify as cls
from tamarack.operators import discovery as dis
from tamarack.operators import requests as req
from tamarack.plans import analyze as an
from tamarack.plans import corpus
from tamarack.plans.registry import query
from tamarack.sources.shared import written_once

_PHRASES = (
    "Cloud CRM to manage the sales pipeline of", "Payroll and hiring software for", "Dental clinic scheduling for", "Fleet and freight routing for",
    "Mobile fitness app for individual users of", "Invoice and tax workflow for", "Restaurant table booking for", "An AI", "Data dashboard with API monitoring for",
    "Bespoke widgets made by hand for",
)


def ideas(spark, sf):
    k = F.col("p_partkey")
    phrase = corpus.pick(_PHRASES, k % 10)
    return corpus.table(spark, sf, "part").select("p_partkey", F.when(k % 10 == 7, phrase).otherwise(F.concat_ws(" ", phrase, F.lower("p_name"), F.lit("makers"))).alias("idea"))


_IDEAS_SQL = """
ideas AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 7 THEN ph ELSE ph || ' ' || lower(p_name) || ' makers' END AS idea FROM (
  SELECT p_partkey, p_name, ([""" + ",".join(f"'{p}'" for p in _PHRASES) + """])[CAST(p_partkey % 10 + 1 AS INTEGER)] AS ph FROM part))"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _score_sql(cat: cls.Category) -> str:
    parts = []
    for sub in cat.subcategories:
        low = sub.lower()
        bare = re.sub(r"\b(saas|software|platform|system|tools|tool)\b", "", low).strip()
        weak = f" WHEN contains(t, '{_quoted(bare)}') THEN 12.0" if len(bare) >= 4 else ""
        parts.append(f"CASE WHEN contains(t, '{_quoted(low)}') THEN 15.0{weak} ELSE 0.0 END")
    for kw in cat.keywords:
        points = 1.0 if kw in cls._GENERIC_KEYWORDS else (10.0 if " " in kw else max(4.0, float(len(kw))))
        parts.append(f"CASE WHEN regexp_matches(t, '\\b{re.escape(kw)}\\b') THEN {points} ELSE 0.0 END")
    return " + ".join(parts)


_SCORES_SQL = f"""{_IDEAS_SQL}, low AS (SELECT p_partkey, lower(idea) AS t FROM ideas),
scores AS (""" + " UNION ALL ".join(
    f"SELECT p_partkey, '{c.category_id}' AS category_id, {i} AS o, CAST({_score_sql(c)} AS DOUBLE) AS score FROM low" for i, c in enumerate(cls.TAXONOMY)
) + ")"


@query("category_score", f"WITH {_SCORES_SQL} SELECT p_partkey, category_id, score FROM scores WHERE score > 0")
def category_score(spark, sf):
    return cls.category_scores(ideas(spark, sf)).select("p_partkey", "category_id", "score")


@query("classify_ideas", f"""
WITH {_SCORES_SQL}, best AS (SELECT p_partkey, arg_max(category_id, (score, -o)) FILTER (score > 0) AS category_id FROM scores GROUP BY 1)
SELECT p_partkey, CASE p_partkey % 10 WHEN 7 THEN 'AMBIGUOUS' WHEN 4 THEN 'OUT_OF_SCOPE' ELSE 'IN_SCOPE' END AS classification_status,
  CASE WHEN p_partkey % 10 NOT IN (4, 7) THEN coalesce(category_id, 'other_b2b_saas') END AS category_id FROM best""")
def classify_ideas(spark, sf):
    return cls.classify(ideas(spark, sf)).select("p_partkey", "classification_status", "category_id")


# One idea per category and part of its terms, so that every category wins somewhere.
_TERMS = [(c.category_id, " ".join((c.subcategories[i % len(c.subcategories)], *c.keywords[2 * i:2 * i + 2])))
          for c in cls.TAXONOMY for i in range(3)]
_TERM_LIST = ",".join(f"'{_quoted(t.lower())}'" for _, t in _TERMS)
_TERM_SCORES = f"""low AS (SELECT p_partkey, 'we sell ' || ([{_TERM_LIST}])[CAST(p_partkey % {len(_TERMS)} + 1 AS INTEGER)] || ' to many firms' AS t FROM part),
scores AS (""" + " UNION ALL ".join(
    f"SELECT p_partkey, '{c.category_id}' AS category_id, {i} AS o, CAST({_score_sql(c)} AS DOUBLE) AS score FROM low" for i, c in enumerate(cls.TAXONOMY)
) + ")"
_BUYERS = ", ".join(f"('{c.category_id}', '{_quoted(c.name)}', '{_quoted(c.buyer)}', '{_quoted('; '.join(c.use_cases))}')" for c in cls.TAXONOMY)


@query("classify_categories", f"""
WITH {_TERM_SCORES}, best AS (SELECT p_partkey, arg_max(category_id, (score, -o)) AS category_id, max(score) AS score FROM scores GROUP BY 1),
c(category_id, category, primary_buyer, use_cases) AS (VALUES {_BUYERS})
SELECT p_partkey, best.category_id, category, score AS category_score, primary_buyer, use_cases FROM best JOIN c USING (category_id)""")
def classify_categories(spark, sf):
    k = F.col("p_partkey")
    words = corpus.pick([t.lower() for _, t in _TERMS], k % len(_TERMS))
    df = corpus.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("We sell "), words, F.lit(" to many firms")).alias("idea"))
    return cls.classify(df).select("p_partkey", "category_id", "category", "category_score", "primary_buyer", F.array_join("use_cases", "; ").alias("use_cases"))


# Ids, names and synonyms of all categories; the first category of a synonym counts.
_NAMES = list({n.lower(): c.category_id for c in reversed(cls.TAXONOMY) for n in (*c.synonyms, c.name, c.category_id)}.items())


@query("category_names", f"""
WITH n AS (SELECT p_partkey, ([{",".join(f"'{_quoted(n)}'" for n, _ in _NAMES)}])[CAST(p_partkey % {len(_NAMES)} + 1 AS INTEGER)] AS name FROM part),
m(name, category_id) AS (VALUES {", ".join(f"('{_quoted(n)}', '{c}')" for n, c in _NAMES)})
SELECT p_partkey, category_id FROM n JOIN m USING (name)""")
def category_names(spark, sf):
    k = F.col("p_partkey")
    name = corpus.pick([n for n, _ in _NAMES], k % len(_NAMES))
    df = corpus.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), F.when(k % 2 == 0, F.upper(name)).otherwise(name)).alias("name"))
    return df.select("p_partkey", cls.normalize_category(F.col("name")).alias("category_id"))


# Names that only hold a term: a subcategory anywhere, else the longest synonym, else the longest keyword between word boundaries.
_INSIDE = (
    ("our payroll softwares", "hr_workforce"), ("presales crms", "crm_sales"), ("a sales crm and lead management", "crm_sales"),
    ("payroll run for hotels", "hr_workforce"), ("best hotel pms", "hospitality_restaurant"), ("an online agritech thing", "vertical_saas"),
    ("the factory machinery maintenance of mills", "manufacturing_operations"), ("hrmsx", None), ("sales-crm!", "crm_sales"), ("(cpq)", "crm_sales"), ("knitting", None), ("  ", None),
)


@query("category_names_inside", f"""
WITH m(i, category_id) AS (VALUES {", ".join(f"({i}, {repr(c) if c else 'NULL'})" for i, (_, c) in enumerate(_INSIDE))})
SELECT p_partkey, category_id FROM part JOIN m ON p_partkey % {len(_INSIDE)} = i""")
def category_names_inside(spark, sf):
    k = F.col("p_partkey")
    name = F.initcap(corpus.pick([n for n, _ in _INSIDE], k % len(_INSIDE)))
    return corpus.table(spark, sf, "part").select("p_partkey", cls.normalize_category(name).alias("category_id"))


@query("scope_check", f"""
WITH {_IDEAS_SQL} SELECT p_partkey, p_partkey % 10 = 7 AS ambiguous, p_partkey % 10 = 4 AS consumer FROM ideas""")
def scope_check(spark, sf):
    return ideas(spark, sf).select("p_partkey", cls.is_ambiguous(F.col("idea")).alias("ambiguous"), cls.is_consumer(F.col("idea")).alias("consumer"))


def raw_requests(spark, sf):
    """One request per customer, with gaps, placeholders and aliases."""
    k = F.col("c_custkey")
    idea = corpus.pick((
        "Clinic management software for clinics in India", "EHR platform", "Inventory tool", "Per seat CRM for companies in Germany", "Pharmacy stock app with monthly subscription",
    ), k % 5)
    return corpus.table(spark, sf, "customer").select(
        k.cast("string").alias("request_id"), idea.alias("business_idea"), F.when(k % 3 == 0, "India").when(k % 3 == 1, "string").alias("target_country"),
        F.when(k % 4 == 0, " Germany ").alias("preferred_geography"), (k % 300 + 1850).cast("int").alias("preferred_year"),
        F.when(k % 6 == 0, F.col("c_mktsegment")).alias("customer_type"),
        F.when(k % 7 == 0, F.round(F.abs("c_acctbal"), 0)).alias("monthly_price"), F.when(k % 11 == 0, 5000.0).alias("annual_price"),
        F.when(k % 5 == 0, 100.0).alias("per_provider_price"), F.when(k % 10 == 0, (k % 9).cast("double")).alias("number_of_employees"),
        F.when(k % 8 == 0, (k * 10).cast("double")).alias("number_of_organizations"), F.when(k % 9 == 0, 30.0).alias("serviceable_percentage"),
        F.when(k % 13 == 0, 4).alias("sales_team_size"), (k % 2 == 0).alias("clinical_use"),
    )


@query("clean_requests", """
SELECT CAST(c_custkey AS VARCHAR) AS request_id, CASE WHEN c_custkey % 3 = 0 THEN 'India' WHEN c_custkey % 4 = 0 THEN 'Germany' END AS target_country,
  CAST(CASE WHEN c_custkey % 300 + 1850 BETWEEN 1900 AND 2100 THEN c_custkey % 300 + 1850 END AS INTEGER) AS preferred_year FROM customer""")
def clean_requests(spark, sf):
    return req.clean_requests(raw_requests(spark, sf)).select("request_id", "target_country", "preferred_year")


@query("missing_fields", """
WITH c AS (SELECT c_custkey AS k, c_acctbal, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 1 ELSE 0 END AS country FROM customer)
SELECT CAST(k AS VARCHAR) AS request_id, concat_ws(',',
  CASE WHEN country = 0 AND k % 5 NOT IN (0, 3) THEN 'target_country' END,
  CASE WHEN k % 6 <> 0 AND k % 5 IN (1, 2, 4) AND NOT (k % 5 = 4) THEN 'customer_type' END,
  CASE WHEN NOT ((k % 7 = 0 AND round(abs(c_acctbal), 0) > 0) OR k % 11 = 0 OR k % 5 IN (0, 3, 4)) THEN 'pricing_basis' END,
  CASE WHEN k % 5 = 1 AND k % 4 = 2 THEN 'clinical_use' END,
  CASE WHEN k % 5 = 1 THEN 'emr_ehr_integration_required' END) AS missing FROM c""")
def missing_fields(spark, sf):
    asked = raw_requests(spark, sf)
    asked = asked.withColumn("clinical_use", F.when(F.col("request_id").cast("long") % 4 != 2, F.col("clinical_use")))
    df = req.missing_fields(req.clean_requests(asked))
    return df.select("request_id", F.array_join("missing_fields", ",").alias("missing"))


@query("derive_business", """
SELECT CAST(c_custkey AS VARCHAR) AS request_id,
  CASE c_custkey % 5 WHEN 0 THEN 'Clinic Management SaaS' WHEN 1 THEN 'EHR/EMR SaaS' WHEN 4 THEN 'Pharmacy Management SaaS' END AS category,
  CASE WHEN c_custkey % 3 = 0 THEN 'India' WHEN c_custkey % 4 = 0 THEN 'Germany' WHEN c_custkey % 5 = 0 THEN 'India' WHEN c_custkey % 5 = 3 THEN 'Germany' END AS country,
  CASE c_custkey % 5 WHEN 3 THEN 'per_user' WHEN 4 THEN 'monthly_subscription' END AS pricing_model FROM customer""")
def derive_business(spark, sf):
    df = req.derive_business(req.clean_requests(raw_requests(spark, sf)))
    return df.select("request_id", F.col("healthcare_saas_category").alias("category"), F.col("target_country").alias("country"), "pricing_model")


@query("market_strategy", """
WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'Clinic Management SaaS' WHEN 1 THEN 'EHR/EMR SaaS' WHEN 4 THEN 'Pharmacy Management SaaS' END AS category,
    CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment WHEN c_custkey % 5 = 0 THEN 'Clinics' WHEN c_custkey % 5 = 4 THEN 'Pharmacies' END AS customer,
    CASE WHEN c_custkey % 3 = 0 THEN 'India' WHEN c_custkey % 4 = 0 THEN 'Germany' WHEN c_custkey % 5 = 0 THEN 'India' WHEN c_custkey % 5 = 3 THEN 'Germany' END AS country,
    (['Clinic management software for clinics in India','EHR platform','Inventory tool','Per seat CRM for companies in Germany','Pharmacy stock app with monthly subscription'])[CAST(c_custkey % 5 + 1 AS INTEGER)] AS idea
  FROM customer),
w AS (SELECT k, list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(category, idea), coalesce(category, 'B2B SaaS'), coalesce(customer, 'Businesses'), coalesce(customer, 'Businesses'),
    'b2b saas hospital clinic medical emr ehr software platform')), '[a-zA-Z]{3,}')) AS words, category, customer, country FROM c)
SELECT CAST(k AS VARCHAR) AS request_id, 'bottom_up_customer_arpu' AS tam_method,
  coalesce(category, 'B2B SaaS') || ' market serving ' || coalesce(customer, 'Businesses') || CASE WHEN country IS NULL THEN '' ELSE ' in ' || country END AS market_definition,
  array_to_string(list_sort(list_filter(words, lambda x: x NOT IN ('for', 'the', 'and', 'with', 'market', 'service', 'platform', 'app', 'software'))), ' ') AS terms FROM w""")
def market_strategy(spark, sf):
    df = req.market_strategy(req.derive_business(req.clean_requests(raw_requests(spark, sf))))
    return df.select("request_id", "tam_method", "market_definition", F.array_join("relevant_terms", " ").alias("terms"))


@query("revenue_per_customer", """
WITH c AS (SELECT c_custkey AS k, round(abs(c_acctbal), 0) AS m, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 9 <> 0 THEN c_custkey % 9 ELSE 3 END AS staff FROM customer)
SELECT CAST(k AS VARCHAR) AS request_id, CAST(CASE WHEN k % 11 = 0 THEN 5000 WHEN k % 7 = 0 AND m > 0 THEN m * 12 WHEN k % 5 = 0 THEN 100 * staff ELSE 48000 END AS DOUBLE) AS arpu FROM c""")
def revenue_per_customer_query(spark, sf):
    df = req.clean_requests(raw_requests(spark, sf))
    return df.select("request_id", revenue_per_customer(df, F.lit(48000.0)).alias("arpu"))


@query("research_queries", """
WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS request_id, CASE WHEN c_custkey % 3 = 0 THEN 'India' WHEN c_custkey % 4 = 0 THEN 'Germany' ELSE 'India' END AS geo,
  CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment ELSE 'Businesses' END AS cust FROM customer)
SELECT request_id, 1 AS query_no, 'total number of ' || lower(cust) || ' in ' || geo AS metric_required FROM r UNION ALL
SELECT request_id, 2, geo || ' B2B SaaS market size annual revenue' FROM r UNION ALL
SELECT request_id, 3, 'B2B SaaS software pricing average annual subscription cost ' || geo FROM r""")
def research_queries(spark, sf):
    return req.research_queries(req.clean_requests(raw_requests(spark, sf)), "saas").select("request_id", "query_no", "metric_required")


@query("research_queries_general", """
WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS request_id, CASE WHEN c_custkey % 3 = 0 THEN 'India' WHEN c_custkey % 4 = 0 THEN 'Germany' END AS geo,
  CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment END AS cust FROM customer),
q AS (SELECT request_id, 1 AS query_no, concat_ws(' ', geo, CASE WHEN cust IS NULL THEN 'target customer population and market size'
        ELSE cust || ' population count businesses number users' END) AS metric_required, CASE WHEN cust IS NOT NULL THEN 'market' END AS industry_topic, cust AS target_population FROM r
  UNION ALL SELECT request_id, 2, concat_ws(' ', geo, 'market market size annual revenue'), 'market', NULL FROM r WHERE cust IS NOT NULL
  UNION ALL SELECT request_id, 3, concat_ws(' ', geo, 'market pricing average annual spend subscription ARPU fee cost'), 'market', NULL FROM r WHERE cust IS NOT NULL)
SELECT * FROM q""")
def research_queries_general(spark, sf):
    return req.research_queries(req.clean_requests(raw_requests(spark, sf))).select("request_id", "query_no", "metric_required", "industry_topic", "target_population")


@query("query_strings", """
SELECT CAST(c_custkey AS VARCHAR) AS request_id, concat_ws(' ', CASE WHEN c_custkey % 3 = 0 THEN 'India' WHEN c_custkey % 4 = 0 THEN 'Germany' ELSE '' END
  || CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN ' ' ELSE '' END
  || (['Clinic management software for clinics in India','EHR platform','Inventory tool','Per seat CRM for companies in Germany','Pharmacy stock app with monthly subscription'])[CAST(c_custkey % 5 + 1 AS INTEGER)]
  || CASE WHEN c_custkey % 6 = 0 THEN ' ' || c_mktsegment ELSE '' END || ' market size revenue growth volume customer count spend') AS metric_required FROM customer""")
def query_strings(spark, sf):
    return req.unified_query(req.clean_requests(raw_requests(spark, sf))).select("request_id", "metric_required")


@query("operand_constraints", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice <= 100 * 1000 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS usable FROM orders""")
def operand_constraints(spark, sf):
    k, v = F.col("o_orderkey") % 6, F.col("o_totalprice")
    op = operand(
        "x", F.when(k == 0, v / 1000).when(k == 2, -v).otherwise(v), F.when(k == 0, "%").when(k == 1, "tips").otherwise("USD"),
        range_min=F.when(k == 3, v * 2), range_max=F.when(k == 3, v), lifecycle_stage=F.when(k == 5, "discovered"),
    )
    return corpus.table(spark, sf, "orders").select("o_orderkey", is_usable(op).alias("usable"))


@query("competitor_matrix", """
SELECT s_name AS product, 'Businesses' AS target_customer, n_name AS geography, 'Cloud SaaS' AS deployment_model FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def competitor_matrix(spark, sf):
    s = corpus.table(spark, sf, "supplier").join(corpus.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.col("s_name").alias("name"), F.col("n_name").alias("geography"))
    return dis.competitor_matrix(rows).select("product", "target_customer", "geography", "deployment_model")


@query("merged_competitors", """
SELECT n_name AS request_id, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def merged_competitors(spark, sf):
    s = corpus.table(spark, sf, "supplier").join(corpus.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.col("n_name").alias("request_id"), F.col("s_name").alias("name"), "s_suppkey")
    listed = rows.filter(F.col("s_suppkey") % 3 != 0).drop("s_suppkey")
    extracted = rows.withColumn("name", F.when(F.col("s_suppkey") % 3 != 0, F.upper("name")).otherwise(F.col("name"))).drop("s_suppkey")
    return dis.merge_competitors(listed, extracted)


def analysis_inputs(spark, sf):
    """Requests per place, the derived documents as their sources and pages."""
    place = F.regexp_extract("content", r"market in ([A-Z][a-z]+) reached", 1)
    docs = written_once(corpus.sentences(spark, sf).withColumn("request_id", place), "documents")
    sources = docs.select(
        "request_id", F.col("doc_id").alias("ord"), F.col("original_url").alias("url"), F.lit("market report").alias("title"),
        F.lit("enterprise market size").alias("snippet"), "source_name", F.lit("other").alias("category"), F.lit(0.8).alias("relevance_score"),
    )
    documents = docs.groupBy("original_url").agg(F.min_by(F.struct("source_name", "content"), "doc_id").alias("d")).select(
        "original_url", F.col("original_url").alias("final_url"), F.lit(None).cast("string").alias("title"), F.col("d.content").alias("content"),
        F.lit("text/html").alias("content_type"), F.lit(200).alias("http_status"), F.lit("success").alias("fetch_status"), F.col("d.source_name").alias("source_name"),
    )
    requests = sources.select("request_id").distinct().select(
        "request_id", F.lit("Online marketplace for enterprise market reports").alias("business_idea"), F.col("request_id").alias("target_country"),
        F.lit(1998).alias("preferred_year"), F.lit("enterprise").alias("customer_type"), F.lit(0).alias("max_sources"),
        F.lit(None).cast("double").alias("annual_price"),
    )
    return requests, sources, documents


@query("analysis_reports")
def analysis_reports(spark, sf):
    """The whole chain: sources, documents, claims, triangulation, ranked operands, both funnels, headline."""
    a = an.analyze(*analysis_inputs(spark, sf), store=written_once)
    return a.reports.select("request_id", "report_status", "headline_method", F.col("tam.estimate").alias("tam"), F.col("macro.name").alias("macro"),
                            F.col("customers.value").alias("customers"), "report_confidence", "final_status")
