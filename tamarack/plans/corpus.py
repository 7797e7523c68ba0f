"""Tables derived from the benchmark schema that stand for the web: market sizes, claims, sentences, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import operand as op
from tamarack.schemas import ASSUMPTION_DDL
from tamarack import terms

# Places that stand for the numbered nations, by nation key modulo 10 (fixed values).
PLACES = ("India", "Germany", "Japan", "Brazil", "France", "Canada", "Australia", "Italy", "Spain", "China")
SUFFIXES = ("example.gov", "example.edu", "reuters.com", "medium.com", "reddit.com")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def place_of_nation(nation_key: Column) -> Column:
    return pick(PLACES, nation_key % len(PLACES))


def market_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per (nation, part type, year), summed as decimals so that the result does not depend on order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation_key"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("part_type"))
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey).join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("nation_key", "part_type", "year")
        .agg(F.round(F.sum("price"), 0).cast("double").alias("size"))
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier reports the market sizes of its nation; every seventh reports 10 % more."""
    sizes = market_sizes(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_key"), "n_name")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation_key"))
    k = F.col("s_suppkey")
    value = F.when(k % 7 == 0, F.round(F.col("size") * 1.1, 0)).otherwise(F.col("size"))
    # A few bytes per row, but much work on each of them later: spread the narrow rows over all cores.
    df = supp.join(sizes, "nation_key").join(nation, "nation_key").repartition(spark.sparkContext.defaultParallelism, "s_suppkey", "part_type")
    df = df.withColumn("value", value)
    millions = (F.col("value") / 1e6).cast("decimal(18,6)").cast("string")
    raw = F.concat(F.lit("USD "), millions, F.lit(" million"))
    context = F.concat(
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("According to house "), k.cast("string"), F.lit(", "))),
        F.lit("the "), F.col("part_type"), F.lit(" market in "), F.col("n_name"), F.lit(" reached "), raw, F.lit(" in "), F.col("year").cast("string"), F.lit("."),
    )
    url = F.concat(F.lit("https://s"), k.cast("string"), F.lit("."), pick(SUFFIXES, k % 5), F.lit("/report/"), F.lower("part_type"), F.lit("/"), F.col("year").cast("string"))
    return df.select(
        F.concat_ws("-", k.cast("string"), "part_type", F.col("year").cast("string")).alias("candidate_id"),
        F.concat(pick(("Total ", "estimated ", ""), k % 3), F.col("part_type"), F.lit(" market size")).alias("metric"),
        F.lit("market_size").alias("metric_type"), "value", raw.alias("raw_value_expression"),
        pick(("USD", "$", "dollars"), k % 3).alias("unit"), F.col("n_name").alias("geography"), "year",
        F.lit(False).alias("is_range_or_approximate"), F.lit(None).cast("double").alias("range_min"), F.lit(None).cast("double").alias("range_max"),
        F.when(k % 11 != 0, F.col("s_name")).alias("source_name"), url.alias("source_url"), context.alias("source_context"),
        F.lit("medium").alias("extraction_confidence"), F.lit(None).cast("string").alias("notes"), "nation_key", "part_type", k.alias("supp_key"),
    )


def business(rows: DataFrame) -> DataFrame:
    """Claims with a business to be judged against: the part type's industry in the claim's nation."""
    return rows.withColumns({
        "target_geography": F.when(F.col("supp_key") % 2 == 0, F.col("geography")).otherwise("NATION_3"),
        "target_industry": F.concat(F.col("part_type"), F.lit(" manufacturing")),
        "target_customer": F.lit("industrial companies"),
        "target_product": F.concat(F.lower("part_type"), F.lit(" widgets")),
    })


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of claim sentences per (supplier, type, year), in place names of the gazetteer."""
    rows = claims(spark, sf_dir)
    place, t, y = place_of_nation(F.col("nation_key")), F.lower("part_type"), F.col("year").cast("string")
    n = (F.col("value") / 1e6).cast("decimal(18,3)").cast("string")
    k = F.col("supp_key")
    count = ((k * 137 + F.col("year")) % 9000 + 1000).cast("string")
    pct = (k % 90 + 5).cast("string")
    lo, hi = (k % 40 + 10).cast("string"), (k % 40 + 25).cast("string")
    text = F.concat(
        F.lit("The "), t, F.lit(" market in "), place, F.lit(" reached USD "), n, F.lit(" million in "), y, F.lit(". "),
        F.lit("It serves "), count, F.lit(" enterprise customers across "), place, F.lit(" in "), y, F.lit(". "),
        F.lit("Urban regions hold "), pct, F.lit("% of local demand in "), place, F.lit(" in "), y, F.lit(". "),
        F.lit("There are "), lo, F.lit("–"), hi, F.lit(" million users in "), place, F.lit(".\n"),
        F.lit("More than "), lo, F.lit(" million subscribers in "), place, F.lit(" ("), y, F.lit(") pay. "),
        F.lit("Key players include Acme "), t, F.lit(", Supplier "), k.cast("string"), F.lit(" and Borealis"),
    )
    return rows.select(
        F.col("candidate_id").alias("doc_id"), F.col("source_url").alias("original_url"), "source_name", text.alias("content"),
    )


def sizing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per (nation, market segment, year): macro from order totals, customers, yearly spend."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.year("o_orderdate").alias("year"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation_key"), F.col("c_mktsegment").alias("segment"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_key"), "n_name")
    # Two levels: per customer first, so the distinct count is a plain count and no key is hot.
    per_customer = orders.groupBy("o_custkey", "year").agg(F.sum("price").alias("spend"), F.count("*").alias("n_orders"))
    base = (
        per_customer.join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation_key", "segment", "year")
        .agg(F.sum("spend").cast("double").alias("total"), F.count("*").alias("buyers"), F.sum("n_orders").alias("orders"))
        .join(nation, "nation_key")
    )
    nk, total, buyers = F.col("nation_key"), F.col("total"), F.col("buyers").cast("double")
    tier = pick((terms.TIER_1, terms.TIER_2, terms.TIER_3, terms.TIER_4), nk % 4)
    stage = pick(("verified", "validated", "validated"), nk % 3)
    published = 2026 - nk % 13
    common = {"source_quality_tier": tier, "lifecycle_stage": stage, "data_type": "sourced"}
    ranged = nk % 2 == 0

    def pct(name: str, value, assumed=False, **f) -> Column:
        return op.operand(name, value, "%", is_assumption=assumed, **common, **f)

    macro = op.operand(
        F.concat(F.col("segment"), F.lit(" market")), total * 2.71828183, "USD", currency="USD", year=F.col("year"), geography=F.col("n_name"),
        range_min=F.when(ranged, total * 2.4464536), range_max=F.when(ranged, total * 2.9901099), published_year=published, is_conflict=nk == 23, **common,
    )
    customers = op.operand(
        F.concat(F.col("segment"), F.lit(" buyers")), buyers, "customers", year=F.col("year") + F.when(nk % 5 == 0, 1).otherwise(0), geography=F.col("n_name"),
        range_min=F.when(ranged, buyers * 0.8), range_max=F.when(ranged, buyers * 1.2), published_year=published, **common,
    )
    # In (nation key mod 6 = 0) the price is a user's assumption; the basis cycles through the kinds.
    price = op.operand(
        "Average yearly spend", total / buyers * 1.0000137, "USD", currency=F.when(nk == 17, "INR").otherwise("USD"), year=F.col("year"),
        is_assumption=nk % 6 == 0, is_user_provided=nk % 6 == 0, **common,
    )
    none, empty = op.no_operand(), op.no_operands()
    return base.select(
        F.concat_ws("-", nk.cast("string"), "segment", F.col("year").cast("string")).alias("request_id"),
        F.concat(F.lower("segment"), F.lit(" platform")).alias("business_idea"), F.col("n_name").alias("target_geography"), F.lit(2026).alias("target_year"),
        pick(("per_facility", "per_provider", "per_seat", "usage_based", "monthly_flat"), nk % 5).alias("pricing_basis"),
        pick(("annual", "annual", "quarterly"), nk % 3).alias("pricing_frequency"),
        macro.alias("macro"), pct("Served regions", 25.0).alias("geo_pct"),
        F.when(nk % 7 != 0, pct("Target segment", (nk + 20).cast("double"), nk % 6 == 0)).alias("segment_pct"),
        F.when(nk % 8 != 0, pct("Obtainable share", 10.0, F.lit(True), range_min=F.lit(8.0), range_max=F.lit(12.0))).alias("td_share"),
        customers.alias("customers"), none.alias("base_organizations"), none.alias("base_segment_pct"),
        F.when(nk % 9 == 0, op.operand("Serviceable buyers", F.ceil(buyers * 0.4).cast("double"), "customers", **common)).alias("serviceable"),
        pct("Qualified buyers", 20.0).alias("target_customer_pct"), none.alias("obtainable"),
        F.when(nk % 8 != 0, pct("Obtainable share", 10.0, F.lit(True), range_min=F.lit(8.0), range_max=F.lit(12.0))).alias("bu_share"),
        price.alias("pricing"), op.operand("Providers", 3.0, "providers").alias("providers"), op.operand("Seats", 4.0, "seats").alias("seats"),
        op.operand("Orders", F.col("orders") / buyers, "orders").alias("volume"),
        F.when(nk % 2 == 1, F.array(pct("Online", 80.0), pct("Recurring", 50.0, range_min=F.lit(45.0), range_max=F.lit(55.0)))).otherwise(empty).alias("segment_percentages"),
        empty.alias("other_filters"),
        F.array(F.struct(F.lit("annual_growth_rate").alias("name"), F.lit(0.05).alias("value"), F.lit("ratio").alias("unit"), F.lit("plan").alias("justification"), F.lit(True).alias("is_user_provided"))).cast(f"array<{ASSUMPTION_DDL}>").alias("assumptions"),
        nk.alias("nation_key"), "segment", "year", "total", "buyers", "orders",
    )
