"""Validation, grouping and corroboration of claims."""

import pytest
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import source_rules as src
from tamarack.functions.once import compiled_once, computed_once
from tamarack.operators import evidence as ev
from tamarack.schemas import CLAIMS_DDL

_NO = [0]


def claim(url, value=43e6, metric="college students", unit="students", place="India", year=2024, context=None, kind="student_count", **more):
    _NO[0] += 1
    row = dict(
        candidate_id=f"c{_NO[0]:04d}", metric=metric, metric_type=kind, value=value, raw_value_expression=None, unit=unit, geography=place, year=year,
        is_range_or_approximate=False, range_min=None, range_max=None, source_name="Agency", source_url=url,
        source_context=context or f"Report {_NO[0]}: the number of people in this group, in the market of {place}.", extraction_confidence="medium", notes=None,
    )
    row.update(more)
    return row


def frame(spark, *rows):
    names = [p.split()[0] for p in CLAIMS_DDL.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], CLAIMS_DDL)


def test_compiled_once(spark):
    df = spark.createDataFrame([(1, " A b "), (2, None), (3, "b")], "id int, t string")
    columns = {"t": F.lower(F.trim("t")), "words": F.transform(F.split("t", " "), lambda w: F.concat(w, w))}
    got, want = (make(df, columns).filter("t != ''") for make in (compiled_once, computed_once))
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect()) and got.count() == 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # evaluated once, in a projection: neither the filter nor the generator holds the expression
    assert plan.count("lower(") == 1 and [x for x in plan.split("\n") if "lower(" in x][0].lstrip("+-: ").startswith("Project")


def test_suitability_is_asked_of_valid_claims_only(spark):
    df = frame(spark, claim("https://statistics.gov.in/a"), claim("https://reddit.com/r/b")).withColumn("target_geography", F.col("geography"))
    checked = ev.validate_claims(df)
    assert {(r.source_url, r.is_valid, r.suitability.geographic_match) for r in checked.collect()} == {
        ("https://statistics.gov.in/a", True, True), ("https://reddit.com/r/b", False, True)}
    valid = checked.filter("is_valid").select("candidate_id", "suitability")
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = valid._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    asked = [i for i, x in enumerate(plan) if "_suits_geo" in x]
    kept = [i for i, x in enumerate(plan) if x.lstrip("+-: ").startswith("Filter") and "= valid" in x]
    assert asked and kept and max(asked) < min(kept)


def test_groups(spark):
    df = frame(
        spark, claim("https://statistics.gov.in/a"), claim("https://education.gov.in/b"),
        claim("https://x.gov.in/c", metric="Number of college students", unit="student"), claim("https://y.gov.in/d", value=47e6),
    )
    groups = {r.value: (r.n_claims, r.n_domains) for r in ev.duplicate_groups(ev.with_claim_keys(df)).collect()}
    assert groups == {43e6: (3, 3), 47e6: (1, 1)}


def test_triangulation_status(spark):
    df = frame(
        spark,
        claim("https://statistics.gov.in/a", place="India"), claim("https://education.gov.in/b", place="India"),
        claim("https://one.example.org/a", place="Goa"), claim("https://one.example.org/a", place="Goa"),
        claim("https://data.gov.in/a", place="Pune", value=43e6), claim("https://blog.example.com/a", place="Pune", value=85e6),
        claim("https://who.int/a", place="Delhi"), claim("https://reuters.com/a", place="Delhi"),
        claim("https://blog1.example.com/a", place="Bihar"), claim("https://blog2.example.com/a", place="Bihar"),
        claim("https://reddit.com/r/x", place="Kerala"),
    )
    rows = {}
    for r in ev.triangulate(df).collect():
        rows.setdefault(r.geography, []).append(r)
    assert (rows["India"][0].lifecycle_stage, rows["India"][0].confidence) == ("verified", "very_high")
    assert (rows["Goa"][0].lifecycle_stage, rows["Goa"][0].corroborating_source_count) == ("validated", 1)
    assert {r.validation_status for r in rows["Pune"]} == {"conflict"} and rows["Pune"][0].conflict_min == 43e6 and rows["Pune"][0].conflict_max == 85e6
    assert (rows["Delhi"][0].lifecycle_stage, rows["Delhi"][0].confidence) == ("verified", "very_high")
    assert (rows["Bihar"][0].lifecycle_stage, rows["Bihar"][0].confidence) == ("validated", "medium")
    assert "Kerala" not in rows
    assert all(r.corroborating_source_count >= 2 for rs in rows.values() for r in rs if r.lifecycle_stage == "verified")


def test_noise_and_relevance(spark):
    base = dict(metric="market size", unit="USD", value=5e6, kind="market_size")
    df = frame(
        spark,
        claim("https://a.org/1", context="Call our helpline: 1800 123 4567 for the market", **base),
        claim("https://a.org/2", context="Reach us at info@corp.example for market size", **base),
        claim("https://a.org/3", context="Home > Reports. All rights reserved. The market", **base),
        claim("https://a.org/4", context="A hardcover book costs USD 25 in the market", **{**base, "value": 25.0}),
        claim("https://a.org/5", context="Crude steel output and blast furnace capacity in India", **base),
        claim("https://a.org/6", place="Germany", context="The coding market of Germany", **base),
        claim("https://a.org/7", context="The online coding education market in India", **base),
    ).withColumns({"target_geography": F.lit("India"), "target_industry": F.lit("Education"), "target_customer": F.lit("college students"),
                   "target_product": F.lit("online coding education")})
    got = {r.source_url[-1]: (r.is_valid, r.rejection_category) for r in ev.validate_claims(df).collect()}
    assert got == {
        "1": (False, "NOISE_CONTACT_INFO"), "2": (False, "NOISE_CONTACT_INFO"), "3": (False, "NAVIGATION_TEXT"), "4": (False, "UNRELATED_PRICE"),
        "5": (False, "UNRELATED_INDUSTRY"), "6": (False, "GEOGRAPHY_MISMATCH"), "7": (True, None),
    }


def test_structural_faults(spark):
    df = frame(spark, claim("https://a.org/1", value=None), claim("https://a.org/2", value=-5.0), claim("ftp://a.org/3"), claim("https://a.org/4", unit="tips"),
               claim("https://a.org/5", year=1700), claim("https://a.org/6", is_range_or_approximate=True, value=None, range_min=9.0, range_max=3.0))
    got = {r.source_url[-1]: r.e for r in df.select("source_url", ev.structural_errors(df).alias("e")).collect()}
    assert got["1"] == ["missing_value"] and got["2"] == ["negative_value"] and got["3"] == ["url_not_http"] and got["4"] == ["noise_unit"]
    assert got["5"] == ["year_out_of_bounds"] and got["6"] == ["range_order"]


@pytest.mark.parametrize("substring", [False, True])
def test_tiers(spark, substring):
    urls = {
        "https://mospi.gov.in/x": terms.TIER_1, "https://www.worldbank.org/x": terms.TIER_1, "https://cs.stanford.edu/x": terms.TIER_2,
        "https://www.gartner.com/x": terms.TIER_2, "https://www.reuters.com/x": terms.TIER_3, "https://me.medium.com/x": terms.TIER_4,
        "https://www.reddit.com/r/x": terms.TIER_5, "https://fedex.com/x": terms.TIER_5 if substring else terms.TIER_4,
    }
    df = frame(spark, *[claim(u) for u in urls])
    got = {r.source_url: r.source_quality_tier for r in ev.score_sources(df, substring).collect()}
    assert got == urls


def test_url_safety(spark):
    unsafe = ["http://localhost/x", "http://127.0.0.1/", "http://10.0.0.5/", "http://192.168.1.1/", "http://172.16.0.1/", "http://169.254.169.254/latest",
              "http://[::1]/", "http://[::ffff:127.0.0.1]/", "http://2130706433/", "http://0x7f000001/", "ftp://example.com/", "http://metadata.google.internal/",
              "http://db.internal/", "http://example.com:22/", "http://example.com:3306/", "http://example.com:5432/", "http://example.com:6379/", "", "nonsense",
              "http://user@127.0.0.1/"]
    safe = ["https://example.com/a?b=c", "http://example.com:8080/", "https://8.8.8.8/", "https://EXAMPLE.org", "http://user:pw@example.com/"]
    df = spark.createDataFrame([(u,) for u in unsafe + safe], "u string")
    got = {r.u: r.s for r in df.select("u", src.is_safe_url(F.col("u")).alias("s")).collect()}
    assert [u for u in unsafe if got[u]] == [] and [u for u in safe if not got[u]] == []


def test_hot_group_is_reduced_not_collected(spark):
    df = spark.range(20000).select(
        F.col("id").cast("string").alias("candidate_id"), F.lit("m").alias("metric"), F.lit("market_size").alias("metric_type"),
        F.when(F.col("id") < 15000, 5e6).otherwise(F.col("id").cast("double")).alias("value"), F.lit(None).cast("double").alias("range_min"),
        F.lit(None).cast("double").alias("range_max"), F.lit("USD").alias("unit"), F.lit("India").alias("geography"), F.lit(2024).alias("year"),
        F.concat(F.lit("https://d"), (F.col("id") % 300).cast("string"), F.lit(".org/"), F.col("id").cast("string")).alias("source_url"),
        F.concat(F.lit("a context long enough to count number "), F.col("id").cast("string")).alias("source_context"), F.lit("n").alias("source_name"),
        F.lit(False).alias("is_range_or_approximate"),
    )
    g = ev.duplicate_groups(ev.with_claim_keys(df))
    top = g.orderBy(F.desc("n_claims")).first()
    assert (top.n_claims, top.n_domains, top.n_urls, top.is_syndicated) == (15000, 300, 15000, False)
    assert "collect_" not in g._jdf.queryExecution().executedPlan().toString()


def test_claim_keys_of_extreme_numbers(spark):
    from pyspark.sql import functions as F

    from tamarack.functions import text as tx

    values = [1.0, 1.00004, 1.00001, 1e14, 1e15, 9.99e39, 1e300, -1e300, None, float("nan"), float("inf"), 0.0, -2.5]
    got = [r.k for r in spark.createDataFrame([(v,) for v in values], "v double").select(tx.key_number(F.col("v")).alias("k")).collect()]
    assert got[:3] == ["1.0", "1.0", "1.0"] and got[3] == "100000000000000.0" and got[8] == "None"
    assert len(set(got[3:])) == len(got[3:])


def test_cap_with_a_column_limit_on_one_hot_request(spark):
    from pyspark.sql import functions as F

    from tamarack.operators import discovery

    df = spark.range(5000).select(F.when(F.col("id") % 100 < 95, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 3)).alias("request_id"),
                                  F.concat(F.lit("u"), F.col("id")).alias("url"), (F.col("id") * 7919 % 5003).alias("ord"))
    limited = df.withColumn("most", F.when(F.col("request_id") == "hot", 40).when(F.col("request_id") == "r0", 3))
    got = {}
    for r in discovery.cap_sources(limited, F.col("most"), F.col("ord")).collect():
        got.setdefault(r.request_id, []).append(r.ord)
    rows = {}
    for r in df.collect():
        rows.setdefault(r.request_id, []).append(r.ord)
    most = {"hot": 40, "r0": 3}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:most.get(k, len(v))] for k, v in rows.items()}
    assert discovery.cap_sources(df, None, F.col("ord")).count() == 5000 and discovery.cap_sources(df, 2, F.col("ord")).count() == 8


def test_repeated_competitors_differ_in_more_than_case(spark):
    from tamarack.operators import discovery

    listed = spark.createDataFrame([("r", "Acme")], "request_id string, name string")
    found = spark.createDataFrame([("r", "ACME", 1), ("r", "Beta", 2), ("r", "beta", 1), ("q", "Acme", 1)], "request_id string, name string, ord int")
    got = discovery.merge_competitors(listed, found, order=("ord", "name")).collect()
    assert sorted((r.request_id, r.name) for r in got) == [("q", "Acme"), ("r", "Acme"), ("r", "beta")]
