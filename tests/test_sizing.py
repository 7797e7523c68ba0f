"""Funnels, comparison, growth, freshness: literal expectations."""

import pytest
from pyspark.sql import functions as F

from tamarack.functions import measures as ms
from tamarack.functions.operand import no_operand, no_operands, operand
from tamarack.functions.text import display_count, display_value
from tamarack.operators import reliability as rel
from tamarack.operators import sizing
from tamarack.plans import report as rep
from tamarack.schemas import ASSUMPTION_DDL, OPERAND_LISTS, SINGLE_OPERANDS


def request(spark, rid="r", basis=None, frequency="annual", year=2026, **ops):
    cols = [F.lit(rid).alias("request_id"), F.lit("idea").alias("business_idea"), F.lit("India").alias("target_geography"), F.lit(year).alias("target_year"),
            F.lit(basis).cast("string").alias("pricing_basis"), F.lit(frequency).alias("pricing_frequency")]
    cols += [ops.get(c, no_operand()).alias(c) for c in SINGLE_OPERANDS]
    cols += [(F.array(*ops[c]) if c in ops else no_operands()).alias(c) for c in OPERAND_LISTS]
    return spark.range(1).select(*cols, F.array().cast(f"array<{ASSUMPTION_DDL}>").alias("assumptions"))


def usd(value, **f):
    return operand("money", float(value), "USD", currency=f.pop("currency", "USD"), **f)


def pct(value, **f):
    return operand("share", float(value), "%", **f)


def count(value, **f):
    return operand("buyers", float(value), "customers", **f)


@pytest.fixture(scope="module")
def sized(spark):
    cases = {
        "td": dict(macro=usd(100e6), segment_percentages=[pct(40)], geo_pct=pct(25), td_share=pct(10)),
        "bu": dict(customers=count(40e6), pricing=usd(1200), target_customer_pct=pct(20), bu_share=pct(5)),
        "interval": dict(customers=count(1000, range_min=800.0, range_max=1200.0), pricing=usd(100, range_min=90.0, range_max=110.0)),
        "annual": dict(customers=count(21000), pricing=usd(48000), serviceable=count(6300), obtainable=count(630)),
        "monthly": dict(customers=count(10000), pricing=usd(5000), frequency="monthly"),
        "quarterly": dict(customers=count(5000), pricing=usd(25000), frequency="quarterly"),
        "providers": dict(customers=count(8000), pricing=usd(12000), providers=count(6), basis="per_provider"),
        "seats": dict(customers=count(10000), pricing=usd(1000), seats=count(4), basis="per_seat", frequency="monthly"),
        "too_many_served": dict(customers=count(100), pricing=usd(10), serviceable=count(200)),
        "too_many_won": dict(customers=count(100), pricing=usd(10), serviceable=count(50), obtainable=count(60)),
        "no_share": dict(customers=count(100), pricing=usd(10), serviceable=count(50)),
        "derived": dict(base_organizations=count(1000), base_segment_pct=pct(30), pricing=usd(10)),
        "close": dict(macro=usd(20e9), customers=count(3e6), pricing=usd(6000)),
        "apart": dict(macro=usd(20e9), customers=count(2466667), pricing=usd(6000)),
        "far": dict(macro=usd(100e9), customers=count(3333333.33), pricing=usd(6000)),
        "currency": dict(macro=usd(20e9), customers=count(3e6), pricing=usd(6000, currency="INR")),
        "conflict": dict(macro=usd(20e9, is_conflict=True), customers=count(3e6), pricing=usd(6000)),
        "nothing": dict(),
        "zero": dict(customers=count(0), pricing=usd(10)),
    }
    frames = [request(spark, rid, **ops) for rid, ops in cases.items()]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return {r.request_id: r for r in rep.headline(rep.report(df)).collect()}


def test_top_down(sized):
    r = sized["td"]
    assert (r.td_tam.estimate, r.td_sam.estimate, r.td_som.estimate) == (40e6, 10e6, 1e6)
    assert r.bu_tam.status == "insufficient_evidence" and r.report_status == "calculated" and r.headline_method == "top_down"


def test_bottom_up(sized):
    r = sized["bu"]
    assert (r.bu_tam.estimate, r.bu_sam.estimate, r.bu_som.estimate) == (48e9, 9.6e9, 480e6)
    i = sized["interval"].bu_tam
    assert (i.low, i.estimate, i.high) == (72000.0, 100000.0, 132000.0)
    a = sized["annual"]
    assert (a.bu_tam.estimate, a.bu_sam.estimate, a.bu_som.estimate) == (1.008e9, 302.4e6, 30.24e6)
    assert [sized[k].bu_tam.estimate for k in ("monthly", "quarterly", "providers", "seats")] == [600e6, 500e6, 576e6, 480e6]
    assert sized["derived"].bu_tam.estimate == 3000.0


def test_statuses(sized):
    assert sized["too_many_served"].bu_sam.status == "not_calculable"
    assert sized["too_many_won"].bu_som.status == "not_calculable"
    assert sized["no_share"].bu_som.status == "insufficient_evidence" and sized["no_share"].bu_som.estimate is None
    assert sized["zero"].bu_tam.status == "invalid_input"
    assert sized["conflict"].td_tam.status == "conflict" and sized["conflict"].report_status == "conflict"
    assert sized["nothing"].report_status == "insufficient_evidence"


def test_comparison(sized):
    assert (sized["close"].comparison.percent, sized["close"].comparison.severity) == (10.53, "acceptable")
    assert sized["apart"].comparison.severity == "warning" and sized["far"].comparison.severity == "severe_divergence"
    c = sized["currency"].comparison
    assert (c.currency, c.percent, c.severity) == ("MISMATCH", None, "warning")
    assert sized["td"].comparison is None


def test_funnel_order(sized):
    for r in sized.values():
        for p in ("td", "bu"):
            tam, sam, som = (r[f"{p}_{m}"].estimate for m in ("tam", "sam", "som"))
            assert tam is None or sam is None or 0 <= sam <= tam
            assert sam is None or som is None or 0 <= som <= sam
            for m in ("tam", "sam", "som"):
                assert (r[f"{p}_{m}"].estimate is not None) == (r[f"{p}_{m}"].status == "calculated")


def test_scenarios_only_with_ranges(sized):
    assert sized["interval"].scenarios.status == "AVAILABLE" and sized["interval"].scenarios.tam.low == 72000.0
    assert sized["bu"].scenarios.status == "INSUFFICIENT_EVIDENCE" and sized["bu"].scenarios.tam is None


def test_measures(spark):
    rows = [(100.0, 200.0, 5.0, 0.1487), (50.0, 150.0, 6.0, 0.2009), (0.0, 5.0, 1.0, None), (5.0, -1.0, 1.0, None), (5.0, 6.0, 0.0, None)]
    df = spark.createDataFrame(rows, "b double, e double, y double, want double")
    assert all(r.got == r.want for r in df.select("want", ms.cagr(F.col("b"), F.col("e"), F.col("y")).alias("got")).collect())
    ages = spark.createDataFrame([(2025, "RECENT"), (2022, "MODERATELY_OLD"), (2018, "OLD"), (2012, "VERY_OLD"), (None, "UNKNOWN")], "y int, want string")
    assert all(r.got == r.want for r in ages.select("want", ms.freshness(F.col("y"), F.lit(2026)).alias("got")).collect())


def test_display(spark):
    rows = [(123456789.0, "INR", "₹12.35 crore", "₹12.35 Cr"), (250000.0, "INR", "₹2.50 lakh", "₹2.5 Lakh"), (1234.5, "INR", "₹1,234.50", "₹1,234.5"),
            (12345678901.0, "INR", "₹1,234.57 crore", "₹1,234.57 Cr"), (1.5e9, "USD", "$1.50B", "$1.5B"), (2500.0, "USD", "$2.50K", "$2,500"), (3e6, "EUR", "EUR 3.00M", "€3M")]
    df = spark.createDataFrame(rows, "v double, c string, w string, s string")
    for r in df.select("*", display_value(F.col("v"), F.col("c")).alias("g"), display_value(F.col("v"), F.col("c"), "short").alias("h")).collect():
        assert (r.g, r.h) == (r.w, r.s)
    lakh = spark.range(1).select(display_value(F.lit(12345670.0 * 1e7), F.lit("INR"), "short").alias("x"), display_count(F.lit(1234.4)).alias("n")).first()
    assert lakh.x == "₹1,23,45,670 Cr" and lakh.n == "~1,234"


def test_registry_keeps_the_first_item_of_a_name(spark):
    df = rel.assumption_registry(request(spark, macro=usd(1e6), geo_pct=pct(20), td_share=pct(5, is_assumption=True), pricing=usd(10, is_assumption=True)))
    r = df.first()
    assert [(i.name, i.category) for i in r.registry] == [("money", "MARKET_SIZE"), ("share", "GEOGRAPHY")]
    assert r.registry_counts.total == 2


def test_sensitivity_and_steps(spark):
    df = sizing.bottom_up(sizing.top_down(request(spark, macro=usd(100e6), segment_percentages=[pct(40)], geo_pct=pct(25), td_share=pct(10), customers=count(10), pricing=usd(2))))
    assert [r.parameter for r in sizing.sensitivity(df).orderBy("rank").collect()] == ["annual_price", "potential_customers", "macro_market_size", "share"]
    steps = sizing.calculation_steps(df).orderBy("step_number").collect()
    assert [s.result for s in steps if s.method == "top_down"] == [100e6, 40e6, 10e6, 1e6]
