"""Reports: everything that follows from sized requests, and the choice of headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions import operand as op
from tamarack.functions.measures import cagr
from tamarack.functions.once import computed_once
from tamarack.functions.text import display_value, low
from tamarack.operators import reliability as rel
from tamarack.operators.discovery import competitor_matrix
from tamarack.operators import sizing


def report(requests: DataFrame, scenario_factors=(0.5, 1.5)) -> DataFrame:
    """One wide report row per request: funnels, comparison, registry, scenarios, reliability, confidence.

    Every step is a projection of the request row.
    """
    df = sizing.size_markets(requests, scenario_factors)
    df = sizing.scenario_bounds(sizing.double_counting(df))
    df = rel.report_status(rel.assumption_registry(df))
    df = rel.report_confidence(rel.reliability(df))
    td, bu = F.col("td_tam.status") == "calculated", F.col("bu_tam.status") == "calculated"
    message = (
        F.when(F.col("report_status") == "conflict", "Calculation completed with active evidence conflicts flagged.")
        .when(F.col("report_status") == "insufficient_evidence", "Insufficient evidence to calculate a reliable TAM/SAM/SOM.")
        .when(F.col("comparison").isNotNull(), F.concat(
            F.lit("Market sizing completed using Top-Down and Bottom-Up methodologies ("), F.col("comparison.severity"), F.lit(").")))
        .when(td, "Market sizing completed using Top-Down methodology.")
        .otherwise("Market sizing completed using Bottom-Up methodology.")
    )
    method = F.when(td & bu, "triangulated").when(td, "top_down").when(bu, "bottom_up").otherwise("none")
    warnings = F.array_distinct(F.concat(*[F.col(f"{p}_{m}.warnings") for p in ("td", "bu") for m in sizing.METRICS]))
    overlap = F.when(F.col("double_counting_risk"), F.array(F.lit("Top-down and bottom-up inputs name overlapping markets.")))
    return df.withColumns({
        "message": message, "tam_methodology": method,
        "currency": F.coalesce("td_tam.currency", "bu_tam.currency"),
        "warnings": F.concat(warnings, F.coalesce(overlap, F.array().cast("array<string>"))),
    })


def _pick(test: Column, preferred: Column, other: Column) -> Column:
    return F.when(test, preferred).otherwise(other)


def headline(reports: DataFrame, policy: str = "orchestrator") -> DataFrame:
    """Add ``headline_method, tam, sam, som, final_status``.

    ``orchestrator``: with both methods top-down wins if bottom-up is tiny, diverges beyond 5x, or
    top-down has rated evidence. ``pipeline``: top-down only if asked for or bottom-up is weak or absent;
    missing SAM and SOM are taken from the other method, SOM only from SOM.
    """
    td, bu = F.col("td_tam"), F.col("bu_tam")
    td_ok, bu_ok = td["status"] == "calculated", bu["status"] == "calculated"
    if policy == "orchestrator":
        ratio = F.when(td["estimate"] > 0, bu["estimate"] / td["estimate"]).otherwise(F.lit(1.0))
        top = (
            ((bu["estimate"] < 500.0) & (td["estimate"] >= 10_000_000.0)) | (ratio < 0.2) | (ratio > 5.0)
            | (td["evidence_quality"] != "INSUFFICIENT")
        )
        use_td = F.when(td_ok & bu_ok, top).otherwise(td_ok)
        df = computed_once(reports, {"_td": F.coalesce(use_td, F.lit(False))})
        picked = {m: _pick(F.col("_td"), F.col(f"td_{m}"), F.col(f"bu_{m}")) for m in sizing.METRICS}
    else:
        asked = F.coalesce(F.col("tam_method").isin("top_down", "top_down_market_share"), F.lit(False)) if "tam_method" in reports.columns else F.lit(False)
        weak = bu["evidence_quality"].isin("LOW", "INSUFFICIENT")
        df = computed_once(reports, {"_td": td_ok & (asked | weak | ~bu_ok)})

        def fill(metric: str) -> Column:
            a, b = F.col(f"td_{metric}"), F.col(f"bu_{metric}")
            down = F.when(a["status"] == "calculated", a).otherwise(b)
            up = F.when(b["status"] == "calculated", b).otherwise(a)
            return _pick(F.col("_td"), down, up)

        picked = {"tam": _pick(F.col("_td"), td, bu), "sam": fill("sam"), "som": fill("som")}
    df = computed_once(df, picked)
    calculated = [F.col(f"{m}.status") == "calculated" for m in sizing.METRICS]
    final = (
        F.when(F.col("report_status") == "conflict", "conflict")
        .when(calculated[0], F.when(calculated[1] & calculated[2], "completed").otherwise("partial"))
        .otherwise("insufficient_evidence")
    )
    if policy != "orchestrator":
        final = F.when(calculated[0], "completed").otherwise("partial")
    return df.withColumns({
        "headline_method": F.when(F.col("_td"), "top_down").otherwise("bottom_up"), "final_status": final,
    }).drop("_td")


def calculation_trace(reports: DataFrame) -> DataFrame:
    """Chosen evidence, factor and value per metric, as struct columns."""
    td_ok = {m: F.col(f"td_{m}.status") == "calculated" for m in sizing.METRICS}
    bu_ok = {m: F.col(f"bu_{m}.status") == "calculated" for m in sizing.METRICS}
    none = F.lit(None)

    def trace(value, ref, factor, kind) -> Column:
        return F.struct(value.alias("value"), ref.cast("string").alias("candidate_id"), factor.cast("double").alias("factor"), kind.cast("string").alias("factor_type"))

    macro, cust, price = F.col("macro"), F.col("customers"), F.col("pricing")
    geo, seg, other = F.col("geo_pct"), F.col("segment_pct"), F.try_element_at(F.coalesce("other_filters", op.no_operands()), F.lit(1))
    factor = F.coalesce(geo, seg, other)
    srv, pct, obt, share = F.col("serviceable"), F.col("target_customer_pct"), F.col("obtainable"), F.col("bu_share")
    kind = F.when(geo.isNotNull(), "geography").when(seg.isNotNull(), "segment").when(other.isNotNull(), "filter")
    return reports.select(
        "request_id",
        F.when(td_ok["tam"], trace(F.col("td_tam.estimate"), macro["evidence_id"], none, none))
        .when(bu_ok["tam"], trace(F.col("bu_tam.estimate"), cust["evidence_id"], price["value"], F.lit("price"))).alias("tam_trace"),
        F.when(td_ok["sam"], trace(F.col("td_sam.estimate"), factor["evidence_id"], factor["value"], kind))
        .when(bu_ok["sam"], trace(F.col("bu_sam.estimate"), F.coalesce(srv["evidence_id"], pct["evidence_id"]),
                                  F.coalesce(F.round(F.col("bu_sam.customer_count") / cust["value"] * 100, 2), pct["value"]),
                                  F.when(srv.isNotNull(), "serviceable_population").otherwise("serviceable_percentage"))).alias("sam_trace"),
        F.when(td_ok["som"], trace(F.col("td_som.estimate"), F.col("td_share.evidence_id"), F.col("td_share.value"), none))
        .when(bu_ok["som"], trace(F.col("bu_som.estimate"), F.coalesce(obt["evidence_id"], share["evidence_id"]),
                                  F.coalesce(F.col("bu_som.percent_of_parent"), obt["value"], share["value"]), none)).alias("som_trace"),
    )


def market_growth(inputs: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Growth per request from ``first_match_inputs``: stated rate, else two dated sizes, else a benchmark table.

    The benchmark (``request_id, benchmark_cagr``) is the caller's; without it growth stays null.
    """
    stated = F.col("first_cagr.value")
    begin, end = F.col("begin_value"), F.col("end_value")
    years = (end["year"] - begin["year"]).cast("double")
    computed = F.when(years > 0, cagr(begin["value"], end["value"], years))
    df = inputs if benchmark is None else inputs.join(benchmark, "request_id", "left")
    given = F.col("benchmark_cagr") if benchmark is not None else F.lit(None).cast("double")
    rate = F.when(stated.isNotNull(), F.round(F.when(stated > 1, stated / 100.0).otherwise(stated), 4))
    return df.select(
        "request_id", F.coalesce(rate, computed, given).alias("cagr"),
        F.when(rate.isNotNull(), "SOURCE_REPORTED_CAGR").when(computed.isNotNull(), "CALCULATED_CAGR").when(given.isNotNull(), "BENCHMARK_CAGR").alias("cagr_type"),
        F.when(rate.isNull() & computed.isNotNull(), begin["value"]).alias("current_market_size"),
        F.when(rate.isNull() & computed.isNotNull(), end["value"]).alias("projected_market_size"),
    )


def attractiveness(tam: Column, competitors: Column, clinical: Column) -> Column:
    """``struct(score, rating, size_appeal, competition, friction)``: 6.0 + size + competition + friction."""
    size = F.coalesce(tam, F.lit(0.0))
    points = (
        F.when(size >= 500_000_000, 20).when(size >= 100_000_000, 10).otherwise(0)
        + F.when(competitors <= 2, 10).when(competitors <= 5, 0).otherwise(-10)
        + F.when(F.coalesce(clinical, F.lit(False)), 0).otherwise(5) + 60
    )
    score = F.least(F.greatest(points, F.lit(10)), F.lit(95)) / F.lit(10.0)
    return F.struct(
        score.alias("score"), F.when(score >= 7.5, "HIGH").when(score >= 5.0, "MEDIUM").otherwise("LOW").alias("rating"),
        F.when(size >= 500_000_000, "HIGH").when(size >= 100_000_000, "MEDIUM").otherwise("MODERATE").alias("size_appeal"),
        F.when(competitors <= 2, "LOW").when(competitors <= 5, "MODERATE").otherwise("HIGH").alias("competition"),
        F.when(F.coalesce(clinical, F.lit(False)), "HIGH").otherwise("MODERATE").alias("friction"),
    )


def assess_attractiveness(reports: DataFrame, competitors: DataFrame) -> DataFrame:
    """Add ``attractiveness`` from the bottom-up TAM and the number of competitors per request."""
    counts = competitors.groupBy("request_id").agg(F.count("*").alias("n_competitors"))
    df = reports.join(counts, "request_id", "left").withColumn("n_competitors", F.coalesce("n_competitors", F.lit(0)))
    clinical = F.col("clinical_use") if "clinical_use" in df.columns else F.lit(False)
    return df.withColumn("attractiveness", attractiveness(F.col("bu_tam.estimate"), F.col("n_competitors"), clinical))


def report_sections(reports: DataFrame) -> DataFrame:
    """Computed sections as ``(request_id, section, json)`` rows."""
    def money(metric: str) -> Column:
        r = F.coalesce(F.when(F.col(f"bu_{metric}.status") == "calculated", F.col(f"bu_{metric}")), F.col(f"td_{metric}"))
        return F.struct(
            r["estimate"].alias("estimate"), r["unit"].alias("unit"), r["currency"].alias("currency"), r["status"].alias("status"),
            r["percent_of_parent"].alias("percent_of_parent"), r["scenarios"].alias("scenarios"),
            display_value(r["estimate"], r["currency"]).alias("display"),
        )

    sections = {
        "tam": F.to_json(money("tam")), "sam": F.to_json(money("sam")), "som": F.to_json(money("som")),
        "comparison": F.to_json("comparison"), "assumptions": F.to_json("registry"), "scenarios": F.to_json("scenarios"),
        "confidence": F.to_json(F.struct("report_confidence", "report_quality")), "reliability": F.to_json("reliability"),
        "warnings": F.to_json("warnings"),
    }
    if "attractiveness" in reports.columns:
        sections["attractiveness"] = F.to_json("attractiveness")
    rows = F.array(*[F.struct(F.lit(k).alias("section"), v.alias("json")) for k, v in sections.items()])
    return reports.select("request_id", F.explode(rows).alias("s")).select("request_id", "s.section", "s.json")


def _section(rows: DataFrame, section: str, order_key: Column, content: Column) -> DataFrame:
    return rows.select("request_id", F.lit(section).alias("section"), F.coalesce(order_key.cast("string"), F.lit("")).alias("order_key"), F.to_json(content).alias("json"))


def _fields(rows: DataFrame, **named: str) -> Column:
    """A struct of the columns that the rows have, under the names of the section."""
    return F.struct(*[F.col(c).alias(n) for n, c in named.items() if c in rows.columns])


def child_sections(reports: DataFrame, growth: DataFrame | None = None, competitors: DataFrame | None = None, sources: DataFrame | None = None,
                   evidence: DataFrame | None = None) -> DataFrame:
    """Sections that hold rows of other tables: ``request_id, section, order_key, json``, one row per item.

    ``reports`` gives the customer counts and prices (operand columns ``customers, pricing``) and the provenance; ``growth`` comes from
    :func:`market_growth`; ``competitors``, ``sources`` and ``evidence`` (triangulated claims) have any number of rows per request,
    which stay rows: within a section ``order_key`` orders them, and no request is gathered in one place.
    """
    def operand(name: str) -> Column:
        o = F.col(name)
        fields = ("name", "value", "unit", "currency", "year", "geography", "source_name", "source_url", "source_quality_tier", "is_assumption", "assumption_justification")
        return F.struct(*[o[f].alias(f) for f in fields], display_value(o["value"], F.coalesce(o["currency"], F.lit(""))).alias("display"))

    none = F.lit("")
    parts = [
        _section(reports.filter(F.col("customers.value").isNotNull()), "customer_count", none, operand("customers")),
        _section(reports.filter(F.col("pricing.value").isNotNull()), "price_evidence", none, operand("pricing")),
    ]
    if growth is not None:
        kind = F.when(F.col("cagr_type") == "CALCULATED_CAGR", " (Calculated)").when(F.col("cagr_type") == "BENCHMARK_CAGR", " (Industry Benchmark)").otherwise("")
        text = F.concat(F.format_number(F.col("cagr") * 100, 1), F.lit("% CAGR"), kind)
        told = growth.filter(F.col("cagr").isNotNull()).withColumn("_text", text)
        parts.append(_section(told, "market_growth", none, _fields(
            told, cagr="cagr", cagr_percentage="_text", cagr_type="cagr_type", current_market_size="current_market_size", projected_market_size="projected_market_size")))
    if competitors is not None:
        parts.append(_section(competitors, "competitor_analysis", F.lower("name"), _fields(
            competitors, name="name", product="product", market="target_customer", geography="geography", source="source_name", url="source_url")))
        matrix = competitor_matrix(competitors)
        parts.append(_section(matrix, "competitor_comparison", F.lower("product"), F.struct(*[c for c in matrix.columns if c != "request_id"])))
    if sources is not None:
        parts.append(_section(sources, "evidence_and_sources", F.col("url"), _fields(
            sources, title="title", url="url", source_name="source_name", tier="source_quality_tier", year="published_year")))
    if evidence is not None:
        parts.append(_section(evidence, "validated_evidence", F.concat_ws(" ", "source_url", "candidate_id"), _fields(
            evidence, metric="metric", value="value", unit="unit", geography="geography", year="year", status="validation_status", stage="lifecycle_stage",
            confidence="confidence", sources="corroborating_source_count", url="source_url", tier="source_quality_tier")))
    counted = reports
    if sources is not None:
        counted = reports.join(sources.groupBy("request_id").agg(F.count(F.lit(1)).alias("_sources")), "request_id", "left")
    total = F.coalesce(F.col("_sources"), F.lit(0)) if sources is not None else F.lit(None).cast("bigint")
    known = [F.col(c).alias(n) for n, c in (("confidence_level", "report_confidence"), ("evidence_quality_rating", "report_quality")) if c in reports.columns]
    parts.append(_section(counted, "data_provenance", none, F.struct(total.alias("total_sources_evaluated"), *known)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evidence_summary(sources: DataFrame, documents: DataFrame, checked: DataFrame, triangulated: DataFrame) -> DataFrame:
    """Counts per request: discovered, fetched, extracted, validated, verified, conflicts."""
    def counted(df: DataFrame, **aggs) -> DataFrame:
        return df.groupBy("request_id").agg(*[a.alias(n) for n, a in aggs.items()])

    parts = [
        counted(sources, total_discovered=F.count("*")),
        counted(documents, total_fetched=F.count_if(F.col("fetch_status").isin("success", "snippet_fallback"))),
        counted(checked, total_extracted=F.count("*"), total_validated=F.count_if("is_valid")),
        counted(triangulated, total_verified=F.count_if(F.col("lifecycle_stage") == "verified"),
                total_conflicts=F.countDistinct(F.when(F.col("validation_status") == "conflict", F.col("subject_key")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "request_id", "full_outer")
    return out.fillna(0)
