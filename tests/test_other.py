"""Pages, search results, classification, stored analyses, whole analyses."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tamarack.operators import classify as cls
from tamarack.operators import requests as req
from tamarack.plans import analyze as an
from tamarack.sources import analyses as store
from tamarack.sources.shared import written_once
from tamarack.sources import catalog
from tamarack.sources import pages as pg

HTML = """<html><head><title>Market &amp; Co</title><style>p{}</style><script>var x = "<p>no</p>";</script></head>
<body><nav>Menu</nav><h1>Size</h1><p>India has  5,000 hospitals.</p><noscript>off</noscript><footer>legal</footer></body></html>"""


def test_html_text(spark):
    r = spark.createDataFrame([(HTML,)], "h string").select(pg.html_text(F.col("h")).alias("t"), pg.html_text_regex(F.col("h")).alias("x")).first()
    assert r.t.title == "Market & Co"
    assert "India has 5,000 hospitals." in r.t.text.split("\n")
    assert not any(w in r.t.text for w in ("Menu", "legal", "off", "var x"))
    assert "India has 5,000 hospitals." in r.x and "var x" not in r.x


def test_search_payload_shapes(spark):
    items = [{"url": "https://a.gov/x", "title": "A", "content": "s", "score": 3}, {"link": "ftp://b", "name": "B"}, {"link": "https://b.com/y"}, {"url": "https://c.com"}]
    shapes = [items, {"results": items}, {"organic_results": items}, {"webPages": {"value": items}}, {"nothing": 1}]
    rows = [(str(i), "q", json.dumps(s), 2) for i, s in enumerate(shapes)]
    out = catalog.parse_search_results(spark.createDataFrame(rows, "request_id string, query_used string, payload string, max_results int")).collect()
    by = {}
    for r in out:
        by.setdefault(r.request_id, []).append(r)
    assert sorted(by) == ["0", "1", "2", "3"]
    for rows in by.values():
        assert [(r.url, r.title, r.relevance_score) for r in sorted(rows, key=lambda r: r.ord)] == [("https://a.gov/x", "A", 1.0), ("https://b.com/y", "Document at b.com", 0.5)]


@pytest.mark.parametrize("name, want", [("CRM", "crm_sales"), ("RevOps", "crm_sales"), ("HRMS", "hr_workforce"), ("Invoicing", "accounting_finance"),
                                        ("DevOps", "developer_tools"), ("InfoSec", "cybersecurity"), ("crm & sales", "crm_sales"), ("", None), ("zzz", None)])
def test_category_names(spark, name, want):
    assert spark.range(1).select(cls.normalize_category(F.lit(name)).alias("c")).first().c == want


def test_classification(spark):
    ideas = [("Cloud CRM for small businesses to manage sales pipeline and leads.", "IN_SCOPE", "crm_sales"),
             ("A mobile fitness app for individual users to track workouts", "OUT_OF_SCOPE", None),
             ("A movie streaming platform for individual subscribers", "OUT_OF_SCOPE", None), ("An AI platform", "AMBIGUOUS", None)]
    got = cls.classify(spark.createDataFrame([(i[0],) for i in ideas], "idea string")).collect()
    assert {(r.idea, r.classification_status, r.category_id) for r in got} == set(ideas)


def test_analysis_log(spark):
    with tempfile.TemporaryDirectory(prefix="log-", dir="/tmp") as d:
        log = store.AnalysisLog(spark, d + "/log")

        def rows(*r):
            return spark.createDataFrame(r, "analysis_id string, business_idea string, created_at string, status string")

        log.save(rows(("a", "first idea", "2024-01-01", "partial"), ("b", "other", "2024-02-01", "completed")), 1)
        log.save(rows(("a", "changed idea", "2025-01-01", "completed")), 2)
        a = log.get("a").first()
        assert (a.business_idea, a.created_at, a.status) == ("first idea", "2024-01-01", "completed")
        assert [r.analysis_id for r in log.history().collect()] == ["b", "a"] and log.count() == 2
        log.delete(spark.createDataFrame([("a",)], "analysis_id string"), 3)
        assert log.count() == 1
        log.save(rows(("a", "again", "2026-01-01", "partial")), 4)
        assert log.get("a").first().business_idea == "again"
        assert log.compact(d + "/new").count() == 2
        log.clear(5)
        assert log.count() == 0


def test_request_rules(spark):
    df = spark.createDataFrame(
        [("1", "EHR system for hospitals", "string", None, None), ("2", "Clinic management software for clinics in India with monthly subscription", None, None, True),
         ("3", "Stuff", "India", "Clinics", None)],
        "request_id string, business_idea string, target_country string, customer_type string, clinical_use boolean")
    clean = req.clean_requests(df)
    missing = {r.request_id: r.missing_fields for r in req.missing_fields(clean).collect()}
    assert missing["1"] == ["target_country", "pricing_basis", "clinical_use", "emr_ehr_integration_required"] and missing["2"] == [] and missing["3"] == ["pricing_basis"]
    got = {r.request_id: r for r in req.derive_business(clean).collect()}
    assert got["2"].target_country == "India" and got["2"].customer_type == "Clinics" and got["2"].pricing_model == "monthly_subscription"
    assert got["2"].regulatory_market.startswith("ABDM") and got["1"].healthcare_saas_category == "EHR/EMR SaaS"


def test_whole_analysis(spark):
    requests = spark.createDataFrame([("r", "Clinic management software for clinics in India", "India", 2024)], "request_id string, business_idea string, target_country string, preferred_year int")
    sources = spark.createDataFrame(
        [("r", 1, "https://mohfw.gov.in/a", "Clinic census", "clinics in India", "Ministry", "official_government", 0.96),
         ("r", 2, "https://nha.gov.in/b", "Clinics of India", "outpatient clinics in India", "Authority", "official_government", 0.9),
         ("r", 3, "https://grandviewresearch.com/c", "Clinic market report", "clinic software market in India", "Analyst", "industry_analyst", 0.9),
         ("r", 4, "https://birds.example.org/d", "Wildlife", "birds", "Birds", "other", 0.9)],
        "request_id string, ord int, url string, title string, snippet string, source_name string, category string, relevance_score double")
    count = "India has 150,000 private clinics in 2024."
    docs = spark.createDataFrame(
        [("https://mohfw.gov.in/a", count, "success"), ("https://nha.gov.in/b", "Census: " + count, "success"),
         ("https://grandviewresearch.com/c", "The clinic software market in India was valued at USD 850 million in 2024. Clinics spend an average annual price of INR 48,000 in 2024.", "success"),
         ("https://birds.example.org/d", "India has 900,000 clients of 2024.", "success")], "original_url string, content string, fetch_status string")
    docs = docs.select("*", F.col("original_url").alias("final_url"), F.lit(None).cast("string").alias("title"), F.lit("text/plain").alias("content_type"),
                       F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("source_name"))
    a = an.analyze(requests, sources, docs)
    r = a.reports.first()
    assert r.macro.value == 850e6 and r.customers is None or r.customers.value == 150000.0
    assert r.pricing.value == 48000.0 and r.pricing.currency == "INR"
    assert r.td_tam.estimate == 850e6
    stages = {(x.value, x.lifecycle_stage) for x in a.triangulated.collect()}
    assert (150000.0, "verified") in stages and not any(v == 900000.0 for v, _ in stages)
    written = {}

    def keep(df, name):
        written[name] = written_once(df, name)
        return written[name]

    b = an.analyze(requests, sources, docs, store=keep)
    assert set(written) == {"requests", "claim-groups"} and b.reports.collect() == a.reports.collect()
    # statuses come from the written groups alone: texts are extracted once
    assert sorted(b.triangulated.inputFiles()) == sorted(written["claim-groups"].inputFiles())


def test_texts_are_extracted_by_many_tasks(spark):
    requests = spark.createDataFrame([("r", "Clinic management software for clinics in India", "India")], "request_id string, business_idea string, target_country string")
    rows = spark.range(400).withColumn("url", F.concat(F.lit("https://s"), "id", F.lit(".example.gov/a")))
    sources = rows.select(F.lit("r").alias("request_id"), F.col("id").alias("ord"), "url", F.lit("Clinics in India").alias("title"), F.lit("clinics in India").alias("snippet"),
                          F.lit("S").alias("source_name"), F.lit("official_government").alias("category"), F.lit(0.9).alias("relevance_score"))
    requests = requests.withColumn("max_sources", F.lit(0))
    docs = rows.select(F.col("url").alias("original_url"), F.col("url").alias("final_url"), F.lit(None).cast("string").alias("title"),
                       F.concat(F.lit("India has "), F.col("id") + 10000, F.lit(" private clinics in 2024.")).alias("content"), F.lit("text/plain").alias("content_type"),
                       F.lit(200).alias("http_status"), F.lit("success").alias("fetch_status"), F.lit("S").alias("source_name"))
    claims = written_once(an.analyze(requests, sources, docs).claims, "claims-of-many")
    # a few kilobytes of text: adaptive execution would leave them all to one task
    files = claims.groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) <= 200 and sum(r["count"] for r in files) == 400


def test_search_payload_with_a_bad_element(spark):
    payload = '{"results": [{"url": "https://a.org/x", "title": "A"}, "bare text", null, 7, [1], {"url": "https://b.org/y", "n": {"deep": 1}}]}'
    df = spark.createDataFrame([("r", "q", payload, 5), ("r", "q", "no json", 5), ("r", "q", None, 5)], "request_id string, query_used string, payload string, max_results int")
    assert [r.url for r in catalog.parse_search_results(df).collect()] == ["https://a.org/x", "https://b.org/y"]
