"""Benchmark choice by hand: levels, currencies, classes, other names, gaps."""

from tamarack.operators import benchmarks as bm
from tamarack.operators import requests as req
from tamarack.operators.sizing import bottom_up

ROWS = [
    ("customers", "Clinics", "India", None, 150.0, "clinics in India"), ("customers", "Clinics", None, None, 90.0, "clinics"),
    ("customers", "smb", "India", None, 5e6, "small firms in India"), ("customers", "smb", None, None, 1e6, "small firms"),
    ("customers", None, "United States", None, 77.0, "US"), ("customers", None, None, None, 500.0, "all"),
    ("customers", None, None, None, 400.0, "zz"), ("customers", "hospitals", None, None, None, "no value"),
    ("revenue", "clinic", None, "INR", 48.0, "clinic INR"), ("revenue", "clinic", None, None, 2.4, "clinic"),
    ("revenue", "enterprise", "India", "USD", 18.0, "enterprise India USD"), ("revenue", "enterprise", None, "INR", 240.0, "enterprise INR"),
    ("revenue", None, None, "INR", 49.0, "all INR"),
]


def chosen(spark, asked):
    requests = spark.createDataFrame(asked, "request_id string, customer_type string, target_country string, currency string")
    table = spark.createDataFrame(ROWS, bm.BENCHMARKS_DDL)
    out = bm.choose_benchmarks(requests, table).collect()
    assert len(out) == len(asked)
    return {r.request_id: (r.benchmark_customers_name, r.benchmark_revenue_name, r.benchmark_serviceable_pct) for r in out}


def test_levels(spark):
    got = chosen(spark, [
        ("own", " clinics ", "INDIA", "inr"), ("type", "Clinics", "Chile", "USD"), ("class", "Small shops", "India", None),
        ("class all", "MSME owners", "Chile", "EUR"), ("country", "Guild", "usa", "USD"), ("default", "Guild", "Chile", "INR"),
        ("nulls", None, None, None), ("blank", " ", "", ""), ("currency first", "large enterprise", "India", "USD"),
        ("currency", "large enterprise", "India", "INR"), ("other currency", "large enterprise", "India", "EUR"),
        ("orders differ", "small hospital practice", "India", "INR"), ("no value", "Hospitals", "Chile", None),
    ])
    assert got == {
        "own": ("clinics in India", "clinic INR", None), "type": ("clinics", "clinic", None), "class": ("small firms in India", None, None),
        "class all": ("small firms", None, None), "country": ("US", None, None), "default": ("all", "all INR", None), "nulls": ("all", None, None),
        "blank": ("all", None, None), "currency first": ("all", "enterprise India USD", None), "currency": ("all", "enterprise INR", None),
        "other currency": ("all", None, None), "orders differ": ("small firms in India", "all INR", None), "no value": ("all", None, None),
    }


def test_empty_tables_and_missing_columns(spark):
    table = spark.createDataFrame([], bm.BENCHMARKS_DDL)
    requests = spark.createDataFrame([("a",), ("a",)], "request_id string")
    assert [tuple(r) for r in bm.choose_benchmarks(requests, table).collect()] == [("a", *[None] * 6)] * 2
    full = spark.createDataFrame(ROWS, bm.BENCHMARKS_DDL)
    assert {r.benchmark_customers for r in bm.choose_benchmarks(requests, full).collect()} == {500.0}
    assert bm.choose_benchmarks(requests.limit(0), full).collect() == []


def test_benchmarks_are_assumptions_in_sizing(spark):
    requests = req.derive_business(req.clean_requests(spark.createDataFrame(
        [("r1", "Clinic management software for clinics in India", "Clinics", None), ("r2", "Clinic tool", "Clinics", 20.0)],
        "request_id string, business_idea string, customer_type string, number_of_organizations double")))
    rows = ROWS + [("serviceable_pct", None, None, None, 25.0, "a quarter")]
    asked = bm.choose_benchmarks(requests, spark.createDataFrame(rows, bm.BENCHMARKS_DDL))
    items = spark.createDataFrame([], "request_id string, is_valid boolean, metric string, value double, unit string, year int, geography string, source_url string, "
                                      "source_name string, source_quality_tier string, metric_type string, candidate_id string, market_scope string, source_context string, "
                                      "suitability struct<overall:string,geographic_match:boolean,customer_type_match:boolean>")
    out = {r.request_id: r for r in bottom_up(req.first_match_requests(asked, req.first_match_inputs(items))).collect()}
    assert (out["r1"].customers.value, out["r1"].customers.is_assumption) == (150.0, True)
    assert (out["r2"].customers.value, out["r2"].customers.is_assumption) == (20.0, False)
    assert out["r1"].target_customer_pct.value == 25.0 and out["r1"].bu_tam.estimate == 150.0 * out["r1"].pricing.value
