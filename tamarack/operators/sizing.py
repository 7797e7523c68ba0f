"""Market sizing: top-down and bottom-up funnels, comparison, scenarios, sensitivity.

A request is one row, so every function here is a projection: no shuffle, no join. Percent chains are
folds over an operand array inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import operand as op
from tamarack.functions.measures import divergence, price_multiplier
from tamarack.functions.once import computed_once

METRICS = ("tam", "sam", "som")
_TEXTS = "array<string>"


def _texts(*conditional: Column) -> Column:
    return F.array_compact(F.array(*conditional)).cast(_TEXTS)


def _assumed_names(ops: Column) -> Column:
    return F.transform(F.filter(ops, lambda o: o["is_assumption"]), lambda o: o["name"])


def _whole(value: Column) -> Column:
    return F.format_number(value, 0)


def _known(field: str, kind: str = "double") -> str:
    """A field of the raw result that is null unless the result is calculated."""
    return f"cast(if(_x.status = 'calculated', _x.{field}, null) as {kind})"


_SCENARIOS = "struct<conservative:double,base:double,optimistic:double>"
# The result struct from its raw parts (column ``_x``), as one parsed expression.
_RESULT_SQL = f"""named_struct(
  'status', _x.status, 'estimate', {_known('point')}, 'low', {_known('lower')}, 'high', {_known('upper')},
  'percent_of_parent', if(_x.status = 'calculated' and _x.parent > 0, round(_x.point / _x.parent * 100, 2), cast(null as double)),
  'customer_count', {_known('count')}, 'scenarios', {_known('scenarios', _SCENARIOS)},
  'unit', _x.unit, 'currency', _x.currency, 'year', _x.year, 'geography', _x.geography, 'formula', {_known('formula', 'string')},
  'confidence', if(_x.status = 'calculated', {op.confidence_sql('_x.inputs')}, 'low'),
  'evidence_quality', if(_x.status = 'calculated', {op.evidence_quality_sql('_x.inputs', '(size(_x.warnings) > 0)')}, 'INSUFFICIENT'),
  'evidence_reasons', if(_x.status = 'calculated', {op.quality_reasons_sql('_x.inputs')}, cast(array() as array<string>)),
  'assumptions_used', if(_x.status = 'calculated', _x.assumptions, cast(array() as array<string>)),
  'warnings', if(_x.status = 'calculated', _x.warnings, cast(array() as array<string>)))"""


def _add_result(df: DataFrame, name: str, status: Column, point, lower, upper, *, parent=None, unit, currency, year, geography,
                inputs, warnings, assumptions, count=None, scenarios=None, formula=None) -> DataFrame:
    """Add one result struct; everything numeric in it is null unless the status is ``calculated``."""
    raw = {
        "status": status, "point": point, "lower": lower, "upper": upper, "parent": parent, "count": count, "scenarios": scenarios,
        "unit": unit, "currency": currency, "year": year, "geography": geography, "inputs": inputs, "warnings": warnings,
        "assumptions": assumptions, "formula": formula,
    }
    kinds = {"parent": "double", "count": "double", "scenarios": _SCENARIOS, "formula": "string"}
    parts = [(F.expr(f"cast(null as {kinds[k]})") if v is None else v).alias(k) for k, v in raw.items()]
    return computed_once(df.withColumn("_x", F.struct(*parts)), {name: F.expr(_RESULT_SQL)}).drop("_x")


def _chain(start: Column, percents: Column) -> Column:
    """Running product through percent filters: struct(point, low, high)."""
    def step(acc, p):
        return F.struct(
            (acc["point"] * (p["value"] / 100.0)).alias("point"),
            (acc["low"] * (op.low_of(p) / 100.0)).alias("low"),
            (acc["high"] * (op.high_of(p) / 100.0)).alias("high"),
        )

    return F.aggregate(percents, start, step)


def _interval(point: Column, lower: Column, upper: Column) -> Column:
    return F.struct(point.alias("point"), lower.alias("low"), upper.alias("high"))


def _valued(ops: Column) -> Column:
    return F.filter(F.coalesce(ops, op.no_operands()), lambda o: o["value"].isNotNull())


def _any_conflict(ops: Column) -> Column:
    return F.exists(ops, lambda o: o["is_conflict"])


def _clamp(point: Column, ceiling: Column) -> Column:
    return F.greatest(F.least(point, ceiling), F.lit(0.0))


def _clamp_note(name: str, parent: str, point: Column, ceiling: Column) -> Column:
    return F.when(point > ceiling, F.concat(F.lit(f"{name} was clamped to {parent} ("), _whole(ceiling), F.lit(").")))


def _scenarios(point: Column, lower: Column, upper: Column, ranged: Column, factors) -> Column:
    return F.struct(
        F.round(F.when(ranged, lower).otherwise(point * factors[0]), 2).alias("conservative"),
        F.round(point, 2).alias("base"),
        F.round(F.when(ranged, upper).otherwise(point * factors[1]), 2).alias("optimistic"),
    )


def _ranged(o: Column) -> Column:
    return F.coalesce(o["range_min"] < o["range_max"], F.lit(False))


# -- top-down -----------------------------------------------------------------------------------


def top_down(requests: DataFrame, scenario_factors=(0.5, 1.5)) -> DataFrame:
    """Add ``td_tam, td_sam, td_som``: macro size through segment, serviceable and obtainable percents."""
    macro, share = F.col("macro"), F.col("td_share")
    df = requests.withColumns({
        "_segs": _valued(F.col("segment_percentages")),
        "_narrow": _valued(F.concat(F.array("geo_pct", "segment_pct"), F.coalesce("other_filters", op.no_operands()))),
    })
    df = df.withColumn("_t", _chain(_interval(macro["value"], op.low_of(macro), op.high_of(macro)), F.col("_segs")))
    status = (
        F.when(macro["value"].isNull(), "insufficient_evidence")
        .when(macro["is_conflict"] | _any_conflict(F.col("_segs")), "conflict")
        .otherwise("calculated")
    )
    parent_market = F.lower(macro["market_scope"]).isin("parent market", "parent_market") | F.lower(
        macro["entity_concept"]
    ).contains("parent market")
    unsegmented = F.coalesce(parent_market, F.lit(False)) & (F.size(F.coalesce("segment_percentages", op.no_operands())) == 0)
    inputs = F.concat(op.present(macro), F.coalesce("segment_percentages", op.no_operands()))
    df = _add_result(
        df, "td_tam",
        status, F.col("_t.point"), F.col("_t.low"), F.col("_t.high"),
        unit=macro["unit"], currency=macro["currency"], year=macro["year"], geography=macro["geography"],
        inputs=inputs, assumptions=_assumed_names(F.concat(op.present(macro), F.col("_segs"))),
        warnings=_texts(F.when(unsegmented, F.concat(
            F.lit("Parent-market warning: '"), macro["name"], F.lit("' is an aggregate parent market without segmentation.")
        ))),
        formula=F.array_join(F.concat(
            F.array(F.coalesce(macro["name"], F.lit("macro_market_size"))),
            F.transform(F.col("_segs"), lambda o: F.concat(F.lit("("), o["name"], F.lit(" / 100)"))),
        ), " × "),
    )

    tam, narrow = F.col("td_tam"), F.col("_narrow")
    df = df.withColumn("_t", _chain(_interval(tam["estimate"], tam["low"], tam["high"]), narrow))
    status = (
        F.when(tam["status"] != "calculated", tam["status"])
        .when(_any_conflict(narrow), "conflict")
        .when(F.size(narrow) == 0, "insufficient_evidence")
        .otherwise("calculated")
    )
    df = _add_result(
        df, "td_sam",
        status, _clamp(F.col("_t.point"), tam["estimate"]), F.col("_t.low"), F.col("_t.high"), parent=tam["estimate"],
        unit=tam["unit"], currency=tam["currency"], year=tam["year"], geography=tam["geography"], inputs=narrow,
        assumptions=F.concat(tam["assumptions_used"], _assumed_names(narrow)),
        warnings=F.concat(tam["warnings"], _texts(_clamp_note("SAM", "TAM", F.col("_t.point"), tam["estimate"]))),
    )

    sam = F.col("td_sam")
    df = df.withColumn("_t", _interval(
        sam["estimate"] * (share["value"] / 100.0), sam["low"] * (op.low_of(share) / 100.0),
        sam["high"] * (op.high_of(share) / 100.0),
    ))
    status = (
        F.when(sam["status"] != "calculated", sam["status"])
        .when(share["value"].isNull(), "insufficient_evidence")
        .when(share["is_conflict"], "conflict")
        .otherwise("calculated")
    )
    point = _clamp(F.col("_t.point"), sam["estimate"])
    df = _add_result(
        df, "td_som",
        status, point, F.col("_t.low"), F.col("_t.high"), parent=sam["estimate"],
        unit=sam["unit"], currency=sam["currency"], year=sam["year"], geography=sam["geography"],
        inputs=op.present(share), assumptions=F.concat(sam["assumptions_used"], _assumed_names(op.present(share))),
        warnings=F.concat(sam["warnings"], _texts(_clamp_note("SOM", "SAM", F.col("_t.point"), sam["estimate"]))),
        scenarios=_scenarios(point, F.col("_t.low"), F.col("_t.high"), _ranged(share), scenario_factors),
    )
    return df.drop("_segs", "_narrow", "_t")


# -- bottom-up ----------------------------------------------------------------------------------


def bottom_up(requests: DataFrame, scenario_factors=(0.5, 1.5)) -> DataFrame:
    """Add ``bu_tam, bu_sam, bu_som`` and ``annual_revenue``: customers times yearly revenue per customer."""
    given, base, seg, price = F.col("customers"), F.col("base_organizations"), F.col("base_segment_pct"), F.col("pricing")
    basis = F.lower(F.trim(F.coalesce("pricing_basis", F.lit("per_facility"))))
    derive = given["value"].isNull() & base.isNotNull() & seg.isNotNull()
    derived_value = base["value"] * (seg["value"] / 100.0)
    derived = op.operand(
        F.concat(F.lit("Target "), F.coalesce(base["unit"], F.lit("Organizations"))), derived_value,
        F.coalesce(base["unit"], F.lit("organizations")),
        range_min=F.coalesce(base["range_min"] * (seg["range_min"] / 100.0), derived_value),
        range_max=F.coalesce(base["range_max"] * (seg["range_max"] / 100.0), derived_value),
        year=F.coalesce(base["year"], seg["year"]), geography=F.coalesce(base["geography"], seg["geography"]),
        data_type="derived", source_url=F.coalesce(base["source_url"], seg["source_url"]),
        is_assumption=base["is_assumption"] | seg["is_assumption"],
        confidence=F.coalesce(seg["confidence"], base["confidence"], F.lit("medium")),
    )
    usage = (
        F.when(basis.isin(*terms.PROVIDER_BASES), F.col("providers"))
        .when(basis.isin(*terms.SEAT_BASES), F.col("seats"))
        .when(basis.isin(*terms.VOLUME_BASES), F.col("volume"))
    )
    df = requests.withColumns({
        "_basis": basis,
        "_cust": F.when(derive, derived).otherwise(given),
        "_use": F.when(usage["value"] > 0, usage),
        "_freq": price_multiplier(basis, F.col("pricing_frequency")),
    })
    use, cust = F.col("_use"), F.col("_cust")

    def per_customer(price_value: Column, use_value: Column) -> Column:
        return price_value * F.col("_freq") * F.coalesce(use_value, F.lit(1.0))

    df = computed_once(df, {"annual_revenue": _interval(
        per_customer(price["value"], use["value"]),
        per_customer(op.low_of(price), op.low_of(use)),
        per_customer(op.high_of(price), op.high_of(use)),
    )})
    rev = F.col("annual_revenue")
    status = (
        F.when(derive & (base["value"].isNull() | seg["value"].isNull()), "insufficient_evidence")
        .when(derive & ((base["value"] <= 0) | (seg["value"] <= 0) | (seg["value"] > 100)), "invalid_input")
        .when(derive & (base["is_conflict"] | seg["is_conflict"]), "conflict")
        .when(cust["value"].isNull() | price["value"].isNull(), "insufficient_evidence")
        .when((cust["value"] <= 0) | (price["value"] <= 0), "invalid_input")
        .when(cust["is_conflict"] | price["is_conflict"], "conflict")
        .otherwise("calculated")
    )
    currency = F.coalesce(price["currency"], F.lit("INR"))
    unit = F.concat(currency, F.lit("/year"))
    year_gap = F.coalesce((cust["year"] != price["year"]) & (cust["year"] != 0) & (price["year"] != 0), F.lit(False))
    warnings = F.concat(
        _texts(F.when(year_gap, F.concat(
            F.lit("Year mismatch: customers "), cust["year"].cast("string"), F.lit(", pricing "), price["year"].cast("string"),
        ))),
        op.compatibility_warnings(cust, price),
        _texts(
            F.when(cust["is_prior_year"], "Prior-year benchmark used for the customer population."),
            F.when(price["is_prior_year"], "Prior-year benchmark used for pricing."),
        ),
    )
    formula = (
        F.when(basis.isin(*terms.PROVIDER_BASES), F.when(use.isNotNull(), "organizations × providers × annual price per provider")
               .otherwise("providers × annual price per provider"))
        .when(basis.isin(*terms.SEAT_BASES), F.when(use.isNotNull(), "organizations × seats × annual price per seat")
              .otherwise("seats × annual price per seat"))
        .when(basis.isin(*terms.VOLUME_BASES), F.when(use.isNotNull(), "organizations × annual volume × fee per unit")
              .otherwise("volume × fee per unit"))
        .when(F.col("_freq") == 12, "customers × (monthly price × 12)")
        .when(F.col("_freq") == 4, "customers × (quarterly price × 4)")
        .otherwise("customers × annual revenue per customer")
    )
    df = _add_result(
        df.withColumn("_w", warnings), "bu_tam",
        status, cust["value"] * rev["point"], op.low_of(cust) * rev["low"], op.high_of(cust) * rev["high"],
        unit=unit, currency=currency, year=F.coalesce(cust["year"], price["year"]), geography=cust["geography"],
        inputs=op.present(cust, price, base, seg, F.col("providers"), F.col("seats"), F.col("volume")),
        assumptions=_assumed_names(op.present(cust, price)), warnings=F.col("_w"), count=cust["value"], formula=formula,
    )

    tam, srv, pct = F.col("bu_tam"), F.col("serviceable"), F.col("target_customer_pct")
    direct = srv["value"].isNotNull()
    count = F.when(direct, srv["value"]).otherwise(given["value"] * (pct["value"] / 100.0))
    count_low = F.when(direct, op.low_of(srv)).otherwise(op.low_of(given) * (op.low_of(pct) / 100.0))
    count_high = F.when(direct, op.high_of(srv)).otherwise(op.high_of(given) * (op.high_of(pct) / 100.0))
    df = df.withColumn("_n", _interval(count, count_low, count_high))
    n = F.col("_n")
    status = (
        F.when(tam["status"] != "calculated", tam["status"])
        .when(~direct & pct["value"].isNull(), "insufficient_evidence")
        .when(F.when(direct, srv["is_conflict"]).otherwise(pct["is_conflict"]), "conflict")
        .when(~direct & given["value"].isNull(), "insufficient_evidence")
        .when(n["point"] > given["value"], "not_calculable")
        .otherwise("calculated")
    )
    raw = n["point"] * rev["point"]
    inputs = F.when(direct, op.present(price, srv)).otherwise(op.present(price, given, pct))
    used = F.when(direct, op.present(srv)).otherwise(op.present(pct))
    df = _add_result(
        df, "bu_sam",
        status, _clamp(raw, tam["estimate"]), n["low"] * rev["low"], n["high"] * rev["high"], parent=tam["estimate"],
        unit=tam["unit"], currency=tam["currency"], year=tam["year"], geography=tam["geography"], inputs=inputs,
        assumptions=F.concat(tam["assumptions_used"], _assumed_names(used)), count=n["point"],
        warnings=F.concat(tam["warnings"], _texts(_clamp_note("SAM", "TAM", raw, tam["estimate"]))),
        formula=F.lit("serviceable customers × annual revenue per customer"),
    )

    sam, obt, share = F.col("bu_sam"), F.col("obtainable"), F.col("bu_share")
    counted = obt["value"].isNotNull()
    raw = F.when(counted, obt["value"] * rev["point"]).otherwise(sam["estimate"] * (share["value"] / 100.0))
    lower = F.when(counted, op.low_of(obt) * rev["low"]).otherwise(sam["low"] * (op.low_of(share) / 100.0))
    upper = F.when(counted, op.high_of(obt) * rev["high"]).otherwise(sam["high"] * (op.high_of(share) / 100.0))
    df = df.withColumn("_n", _interval(raw, lower, upper))
    n = F.col("_n")
    status = (
        F.when(sam["status"] != "calculated", sam["status"])
        .when(~counted & share["value"].isNull(), "insufficient_evidence")
        .when(F.when(counted, obt["is_conflict"]).otherwise(share["is_conflict"]), "conflict")
        .when(F.when(counted, obt["value"] < 0).otherwise((share["value"] < 0) | (share["value"] > 100)), "invalid_input")
        .when(counted & (obt["value"] > sam["customer_count"]), "not_calculable")
        .otherwise("calculated")
    )
    point = _clamp(n["point"], sam["estimate"])
    one = F.when(counted, op.present(obt)).otherwise(op.present(share))
    df = _add_result(
        df, "bu_som",
        status, point, n["low"], n["high"], parent=sam["estimate"],
        unit=sam["unit"], currency=F.coalesce(sam["currency"], price["currency"]), year=sam["year"], geography=sam["geography"],
        inputs=F.concat(op.present(price), one), assumptions=F.concat(sam["assumptions_used"], _assumed_names(one)),
        warnings=F.concat(sam["warnings"], _texts(_clamp_note("SOM", "SAM", n["point"], sam["estimate"]))),
        count=F.when(counted, obt["value"]).otherwise(sam["customer_count"] * (share["value"] / 100.0)),
        scenarios=_scenarios(
            point, n["low"], n["high"], F.when(obt.isNotNull(), _ranged(obt)).otherwise(_ranged(share)), scenario_factors
        ),
        formula=F.when(counted, "obtainable customers × annual revenue per customer")
        .otherwise("SAM × (obtainable share / 100)"),
    )
    return df.drop("_basis", "_cust", "_use", "_freq", "_n", "_w")


# -- comparison ---------------------------------------------------------------------------------


def _both(td: Column, bu: Column) -> Column:
    return (td["status"] == "calculated") & (bu["status"] == "calculated")


def compare_methods(sized: DataFrame) -> DataFrame:
    """Add ``comparison`` (null unless both TAMs exist) with divergence of all three metrics and diagnostics."""
    td, bu = F.col("td_tam"), F.col("bu_tam")
    mismatch = F.coalesce(F.upper(td["currency"]) != F.upper(bu["currency"]), F.lit(False))
    d = divergence(td["estimate"], bu["estimate"])

    def other(metric: str) -> Column:
        a, b = F.col(f"td_{metric}"), F.col(f"bu_{metric}")
        x = divergence(a["estimate"], b["estimate"])
        return F.when(_both(a, b) & ~mismatch, F.struct(x["absolute"].alias("absolute"), x["percent"].alias("percent"), x["ratio"].alias("ratio")))

    parent = F.exists(td["warnings"], lambda w: F.lower(w).contains("parent"))
    n_td, n_bu = F.size(td["assumptions_used"]), F.size(bu["assumptions_used"])
    diagnostics = F.when(mismatch, _texts(F.lit("currency_mismatch"))).otherwise(_texts(
        F.when(parent, "market_scope_mismatch").when(td["estimate"] > bu["estimate"] * 3.0, "market_definition_divergence"),
        F.when(F.lower(td["geography"]) != F.lower(bu["geography"]), "geographic_scope_mismatch"),
        F.when(F.abs(td["year"] - bu["year"]) >= 2, "temporal_gap"),
        F.when(td["evidence_quality"] != bu["evidence_quality"], "evidence_quality_difference"),
        F.when((n_td > 0) | (n_bu > 0), F.concat(
            F.lit("modeling_assumptions("), n_td.cast("string"), F.lit(","), n_bu.cast("string"), F.lit(")")
        )),
    ))
    confidence = F.when(mismatch, "low").when(d["severity"] == "acceptable", "high").when(d["severity"] == "warning", "medium").otherwise("low")
    return computed_once(sized, {"comparison": F.when(_both(td, bu), F.struct(
        td["estimate"].alias("top_down"), bu["estimate"].alias("bottom_up"),
        F.when(mismatch, "MISMATCH").otherwise(F.coalesce(td["currency"], bu["currency"])).alias("currency"),
        F.when(~mismatch, d["absolute"]).alias("absolute"), F.when(~mismatch, d["percent"]).alias("percent"),
        F.when(~mismatch, d["ratio"]).alias("ratio"),
        F.when(mismatch, "warning").otherwise(d["severity"]).alias("severity"), confidence.alias("confidence"),
        diagnostics.alias("diagnostics"), other("sam").alias("sam"), other("som").alias("som"),
    ))})


def size_markets(requests: DataFrame, scenario_factors=(0.5, 1.5)) -> DataFrame:
    """Both funnels and their comparison for a table of sizing requests."""
    return compare_methods(bottom_up(top_down(requests, scenario_factors), scenario_factors))


def results_long(sized: DataFrame) -> DataFrame:
    """One row per request, method and metric."""
    rows = F.array(*[
        F.struct(F.lit(method).alias("method"), F.lit(m).alias("metric"), F.col(f"{p}_{m}").alias("r"))
        for method, p in (("top_down", "td"), ("bottom_up", "bu")) for m in METRICS
    ])
    return sized.select("request_id", F.explode(rows).alias("x")).select("request_id", "x.method", "x.metric", "x.r.*")


def calculation_steps(sized: DataFrame) -> DataFrame:
    """Numbered steps of both methods with the running interval, one row per step."""
    def step(method, name, operands, point, lower, upper, ref) -> Column:
        return F.struct(
            F.lit(method).alias("method"), name.alias("name"), operands.alias("operand"), point.alias("result"),
            lower.alias("low"), upper.alias("high"), ref.alias("evidence"),
        )

    macro = F.col("macro")
    percents = _valued(F.concat(
        F.coalesce("segment_percentages", op.no_operands()), F.array("geo_pct", "segment_pct"),
        F.coalesce("other_filters", op.no_operands()), F.array("td_share"),
    ))
    first = step("top_down", macro["name"], macro["value"], macro["value"], op.low_of(macro), op.high_of(macro), macro["source_url"])

    def extend(acc, p):
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(step(
            "top_down", p["name"], p["value"], last["result"] * (p["value"] / 100.0),
            last["low"] * (op.low_of(p) / 100.0), last["high"] * (op.high_of(p) / 100.0), p["source_url"],
        )))

    ddl = "array<struct<method:string,name:string,operand:double,result:double,low:double,high:double,evidence:string>>"
    td = F.when(F.col("td_tam.status") == "calculated", F.aggregate(percents, F.array(first).cast(ddl), extend))
    none, price = F.lit(None).cast("double"), F.col("pricing")

    def bu_step(name, metric, operand_col) -> Column:
        r = F.col(f"bu_{metric}")
        return F.when(r["status"] == "calculated", step("bottom_up", F.lit(name), operand_col, r["estimate"], r["low"], r["high"], price["source_url"]))

    rev = F.col("annual_revenue")
    bu = F.array_compact(F.array(
        F.when(F.col("bu_tam.status") == "calculated", step("bottom_up", F.lit("annual revenue per customer"), price["value"], rev["point"], rev["low"], rev["high"], price["source_url"])),
        bu_step("tam", "tam", F.col("bu_tam.customer_count")),
        bu_step("sam", "sam", F.col("bu_sam.customer_count")),
        bu_step("som", "som", F.coalesce(F.col("bu_som.customer_count"), none)),
    )).cast(ddl)
    empty = F.array().cast(ddl)
    return sized.select("request_id", F.posexplode(F.concat(F.coalesce(td, empty), F.coalesce(bu, empty))).alias("i", "s")).select(
        "request_id", (F.col("i") + 1).alias("step_number"), "s.*"
    )


# -- scenarios and sensitivity ------------------------------------------------------------------


def scenario_bounds(sized: DataFrame) -> DataFrame:
    """Add ``scenarios``: low/base/high of the three metrics, only where a source gave a range."""
    c, p, m = F.col("customers"), F.col("pricing"), F.col("macro")
    bu, td = F.col("bu_tam"), F.col("td_tam")

    def bounds(lo, base, hi) -> Column:
        return F.struct(F.round(lo, 2).alias("low"), F.round(base, 2).alias("base"), F.round(hi, 2).alias("high"))

    has_bu = (
        (bu["status"] == "calculated") & c["value"].isNotNull() & (bu["low"] != 0) & (bu["high"] != 0)
        & F.coalesce(c["range_min"], c["range_max"], p["range_min"], p["range_max"]).isNotNull()
    )
    has_td = (td["status"] == "calculated") & m["range_min"].isNotNull() & m["range_max"].isNotNull()
    tam = F.when(has_bu, bounds(bu["low"], bu["estimate"], bu["high"])).when(
        has_td, bounds(m["range_min"], td["estimate"], m["range_max"])
    )
    df = sized.withColumn("_tam", tam)

    def narrowed(parent: Column, result: str, o: Column) -> Column:
        r = F.col(result)
        ok = (r["status"] == "calculated") & (parent["low"] != 0) & (parent["high"] != 0) & (o["value"] != 0)
        return F.when(ok, bounds(
            parent["low"] * (op.low_of(o) / 100.0), r["estimate"], parent["high"] * (op.high_of(o) / 100.0)
        ))

    df = df.withColumn("_sam", narrowed(F.col("_tam"), "bu_sam", F.col("target_customer_pct")))
    df = df.withColumn("_som", narrowed(F.col("_sam"), "bu_som", F.col("bu_share")))
    status = F.when(F.col("_tam").isNotNull(), "AVAILABLE").otherwise("INSUFFICIENT_EVIDENCE")
    return computed_once(df, {"scenarios": F.struct(
        status.alias("status"), F.col("_tam").alias("tam"), F.col("_sam").alias("sam"), F.col("_som").alias("som"),
    )}).drop("_tam", "_sam", "_som")


def sensitivity(sized: DataFrame) -> DataFrame:
    """Ranked drivers per request: HIGH before MEDIUM, ties in fixed order. Sorted inside the row."""
    def driver(order: int, name, value, unit, impact: str) -> Column:
        return F.when(value.isNotNull(), F.struct(
            F.lit(0 if impact == "HIGH" else 1).alias("rank"), F.lit(order).alias("ord"),
            (name if isinstance(name, Column) else F.lit(name)).alias("parameter"), value.cast("double").alias("base_value"),
            unit.alias("unit"), F.lit(impact).alias("impact"), F.lit(1.0).alias("elasticity"),
        ))

    p, c, t, s, m = (F.col(x) for x in ("pricing", "customers", "target_customer_pct", "bu_share", "macro"))
    yearly = F.when(F.lower("pricing_frequency") == "monthly", 12.0).otherwise(1.0)
    fixed = F.array(
        driver(0, "annual_price", p["value"] * yearly, F.coalesce(p["currency"], F.lit("currency/year")), "HIGH"),
        driver(1, "potential_customers", c["value"], F.coalesce(c["unit"], F.lit("customers")), "HIGH"),
        driver(2, "target_customer_percentage", t["value"], F.lit("%"), "MEDIUM"),
        driver(3, "obtainable_market_share", s["value"], F.lit("%"), "HIGH"),
        driver(4, "macro_market_size", m["value"], F.coalesce(m["currency"], F.lit("currency/year")), "HIGH"),
    )
    segments = F.transform(_valued(F.col("segment_percentages")), lambda o, i: F.struct(
        F.lit(1).alias("rank"), (i + 5).alias("ord"), o["name"].alias("parameter"), o["value"].alias("base_value"),
        F.lit("%").alias("unit"), F.lit("MEDIUM").alias("impact"), F.lit(1.0).alias("elasticity"),
    ))
    ordered = F.array_sort(F.concat(F.array_compact(fixed), segments))
    return sized.select("request_id", F.posexplode(ordered).alias("i", "d")).select(
        "request_id", (F.col("i") + 1).alias("rank"), "d.parameter", "d.base_value", "d.unit", "d.impact", "d.elasticity"
    )


def double_counting(sized: DataFrame) -> DataFrame:
    """Add ``double_counting_risk``: the names of the two starting operands contain each other."""
    a, b = F.lower("macro.name"), F.lower("customers.name")
    return sized.withColumn(
        "double_counting_risk", F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a)), F.lit(False))
    )
