"""From claims to operands: roles, scores, the best operand per request and slot.

Claims stay a long table until the end. The winner per (request, slot) is a ``max_by`` aggregate, not a
window: partial aggregation keeps one candidate per task, so a slot with a third of all claims is no
hot partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import operand as op
from tamarack.functions.once import computed_once
from tamarack.functions.text import has_any, low, unit_currency
from tamarack.schemas import ASSUMPTION_DDL

SLOTS = ("macro", "price", "customers", "serviceable", "geo_pct", "segment_pct", "share")


def _word_array(text: Column, longer_than: int) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)), lambda w: F.length(w) > longer_than)


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _prepared(items: DataFrame) -> DataFrame:
    """Items with the lower-case texts, the effective value and the request terms that the roles read."""
    idea = low(_column(items, "business_idea"))
    idea_words = F.filter(
        F.regexp_extract_all(idea, F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0)), lambda w: ~w.isin(*terms.IDEA_STOP_WORDS)
    )
    hot = F.col("conflict_min").isNotNull() if "conflict_min" in items.columns else F.lit(False)
    own = F.coalesce("value", "range_min")
    df = computed_once(items, {
        "_v": own,
        "_unit": low(F.col("unit")), "_metric": low(F.col("metric")),
        "_raw": low(_column(items, "raw_value_expression")), "_ctx": low(_column(items, "source_context")),
        "_cur": unit_currency(F.trim("unit")),
        "_tgt": low(F.col("target_geography")), "_geo": low(F.col("geography")),
        "_year": F.coalesce("year", "target_year"),
        "_lo": F.when(hot, F.least(own, _column(items, "conflict_min", "double"))).otherwise(F.col("range_min")),
        "_hi": F.when(hot, F.greatest(own, _column(items, "conflict_max", "double"))).otherwise(F.col("range_max")),
        "_idea": idea, "_prod": low(_column(items, "target_product")), "_ind": low(_column(items, "target_industry")),
        "_cust": low(_column(items, "target_customer")), "_words": idea_words,
    })
    full = F.concat_ws(" ", "_metric", "_raw", "_ctx", low(_column(items, "source_name")), low(_column(items, "source_url")))
    return computed_once(df.filter(F.col("_v").isNotNull()), {"_full": full})


def base_score(items: DataFrame) -> Column:
    """Year, tier, corroboration and stage points shared by all slots."""
    gap = F.abs(F.col("_year") - F.col("target_year"))
    year = F.when(gap == 0, 40.0).when(gap == 1, 30.0).when(gap <= 3, 15.0).otherwise(5.0)
    tier_col = _column(items, "source_quality_tier")
    tier = F.when(tier_col == terms.TIER_1, 40.0).when(tier_col == terms.TIER_2, 30.0).when(tier_col == terms.TIER_3, 20.0).otherwise(10.0)
    # The count itself is scaled (not the count less one): a single source already earns 7.5 points.
    corroboration = F.least(F.lit(15.0), F.coalesce(_column(items, "corroborating_source_count", "bigint"), F.lit(1)) * 7.5)
    stage_col = F.lower(_column(items, "lifecycle_stage"))
    stage = F.when(stage_col == "verified", 15.0).when(stage_col == "validated", 10.0).otherwise(5.0)
    return year + tier + corroboration + F.coalesce(stage, F.lit(5.0))


def _is_count() -> Column:
    unit, metric, raw, v = F.col("_unit"), F.col("_metric"), F.col("_raw"), F.col("_v")
    lo, hi = F.col("range_min"), F.col("range_max")
    years = F.coalesce(lo.between(1990, 2040) & hi.between(1990, 2040), F.lit(False)) | (
        v.between(1990, 2040) & has_any(raw, ("-", "–", "to", "forecast", "cagr", "period", "growth"))
    )
    rate = has_any(metric, ("cagr", "growth", "forecast", "year", "period", "trend", "tariff", "rate")) | raw.contains("%")
    return (
        (has_any(unit, terms.POPULATION_WORDS) | has_any(metric, terms.POPULATION_WORDS))
        & ~years & ~rate & ~unit.isin(*terms.PERCENT_UNITS) & F.col("_cur").isNull()
    )


def percent_rejection() -> Column:
    """Why a percentage may not narrow a market, null when it may."""
    metric, raw, ctx, v = F.col("_metric"), F.col("_raw"), F.col("_ctx"), F.col("_v")
    tgt, geo = F.col("_tgt"), F.col("_geo")
    texts = F.concat_ws(" ", metric, raw, ctx)

    def anywhere(words) -> Column:
        return has_any(metric, words) | has_any(raw, words) | has_any(ctx, words)

    signed = texts.rlike(r"\b[+-][0-9]+(?:\.[0-9]+)?\s*%")
    foreign_named = (geo != "") & ~geo.isin("global", "worldwide", "world") & (tgt != "") & (geo != tgt) & ~geo.contains(tgt)
    foreign_words = F.exists(
        F.array(*[F.lit(t) for t in terms.FOREIGN_CONTEXT_TERMS]),
        lambda t: ctx.contains(t) & ((tgt == "") | ~tgt.contains(t)),
    )
    # The clause that holds the number decides whether the percentage is about an unrelated product.
    clauses = F.filter(F.split(ctx, r"[,;]|\bwhile\b|\bwhereas\b|\bbut\b"), lambda c: F.trim(c) != "")
    whole, tenth = v.try_cast("bigint").cast("string"), F.round(v, 1).try_cast("decimal(20,1)").cast("string")
    own = F.filter(clauses, lambda c: c.contains(whole) | c.contains(tenth) | c.contains(raw))
    clause = F.coalesce(F.try_element_at(own, F.lit(1)), ctx)
    food_business = has_any(F.col("_prod"), ("food", "feed", "supplies", "accessories")) | F.col("_idea").contains("pet food")
    other_product = (
        ~food_business
        & (has_any(metric, terms.UNRELATED_CATEGORY_TERMS) | has_any(clause, terms.UNRELATED_CATEGORY_TERMS))
        & ~has_any(clause, terms.SERVICE_CLAUSE_TERMS)
    )
    return (
        F.when(~v.between(0, 100), "out_of_bounds")
        .when(anywhere(terms.GROWTH_PERCENT_TERMS) | signed, "growth")
        .when(anywhere(terms.OPERATIONAL_TERMS), "operational")
        .when(has_any(ctx, terms.SPECIES_TERMS), "demographic")
        .when(foreign_named | foreign_words, "foreign_place")
        .when(other_product, "unrelated_product")
        .when(has_any(ctx, terms.COMPETITOR_SHARE_TERMS), "competitor_share")
    )


def _percent_role() -> Column:
    metric, ctx, full, tgt, geo = (F.col(c) for c in ("_metric", "_ctx", "_full", "_tgt", "_geo"))
    region = has_any(metric, terms.REGION_SHARE_TERMS) | has_any(ctx, terms.REGION_SHARE_TERMS)
    is_geo = region & (tgt != "") & (full.contains(tgt) | geo.contains(tgt))
    geo_match = (geo == "") | (tgt == "") | (geo == tgt) | ctx.contains(tgt)
    is_share = has_any(metric, terms.SOM_METRIC_TERMS) | has_any(ctx, terms.SOM_CONTEXT_TERMS)
    named = F.trim(F.regexp_replace(metric, "market share / segment percentage", ""))
    customer_words = _word_array(F.col("_cust"), 3)
    intent = ~region & (
        F.col("metric_type").isin(*terms.SEGMENT_TYPES)
        | ((F.col("_cust") != "") & (named.contains(F.col("_cust")) | ctx.contains(F.col("_cust"))))
        | F.exists(customer_words, lambda w: named.contains(w))
        | (has_any(ctx, terms.SEGMENT_VERB_TERMS) & F.exists(customer_words, lambda w: ctx.contains(w)))
        | has_any(named, terms.SEGMENT_METRIC_TERMS)
        | has_any(ctx, terms.SEGMENT_CONTEXT_TERMS)
    )
    on_topic = _topic_match() | (F.coalesce("business_idea", F.lit("")) == "")
    return (
        F.when(is_geo & geo_match, "geo_pct").when(is_geo, F.lit(None).cast("string"))
        .when(is_share, "share").when(F.coalesce(intent, F.lit(False)) & on_topic, "segment_pct")
    )


def _idea_match() -> Column:
    return F.exists(F.col("_words"), lambda w: F.col("_full").contains(w))


def _product_match() -> Column:
    return F.exists(F.filter(F.split("_prod", r"\s+"), lambda w: F.length(w) > 3), lambda w: F.col("_full").contains(w))


def _industry_match() -> Column:
    return (F.col("_ind") != "") & F.col("_full").contains(F.col("_ind"))


def _topic_match() -> Column:
    return _idea_match() | _industry_match() | _product_match()


def _money_role() -> Column:
    unit, metric, raw, ctx, v = (F.col(c) for c in ("_unit", "_metric", "_raw", "_ctx", "_v"))

    def anywhere(words) -> Column:
        return has_any(metric, words) | has_any(raw, words) | has_any(ctx, words)

    tariff = (
        has_any(unit, terms.COMMODITY_TERMS) | has_any(metric, terms.COMMODITY_TERMS) | has_any(raw, terms.COMMODITY_TERMS)
        | has_any(ctx, terms.COMMODITY_CONTEXT_TERMS)
    )
    funding = anywhere(terms.OPERAND_FUNDING_TERMS) & ~has_any(metric, ("market size", "industry size"))
    company = (has_any(metric, terms.COMPANY_REVENUE_TERMS) | has_any(ctx, terms.COMPANY_REVENUE_TERMS)) & ~has_any(
        metric, ("market size", "industry size", "sector size")
    )
    per_unit = anywhere(terms.UNIT_ECONOMICS_TERMS)
    kind = F.coalesce("metric_type", F.lit(""))
    macro = (
        ~tariff & ~funding & ~company & ~per_unit & (v >= terms.MACRO_SCALE)
        & (kind.isin("market_size", "market_revenue") | has_any(metric, terms.MACRO_METRIC_TERMS) | ~has_any(metric, terms.MICRO_METRIC_TERMS))
    )
    price = ~macro & ~tariff & ~funding & (
        (v < terms.MACRO_SCALE) | per_unit | kind.isin(*terms.PRICE_TYPES) | has_any(metric, terms.PRICE_METRIC_TERMS)
    )
    return F.when(macro, "macro").when(price, "price")


def _macro_place() -> Column:
    global_market = has_any(F.col("_metric"), ("global market", "worldwide market", "global industry", "global revenue"))
    return (
        F.when(F.col("_geo").isin("global", "worldwide", "world"), "Global")
        .when(F.col("_geo") != "", F.col("geography")).when(global_market, "Global")
        .otherwise(F.col("target_geography"))
    )


def _macro_excluded(place: Column) -> Column:
    tgt = F.col("_tgt")
    foreign = (tgt != "") & place.isin(*terms.FOREIGN_COUNTRIES) & (place != tgt) & ~place.contains(tgt)
    service = has_any(F.concat_ws(" ", "_prod", "_idea"), terms.SERVICE_BUSINESS_TERMS)
    odd = (
        service & (has_any(F.col("_metric"), terms.DISCORDANT_PRODUCTS) | has_any(F.col("_ctx"), terms.DISCORDANT_PRODUCTS))
        & ~has_any(F.col("_prod"), terms.DISCORDANT_PRODUCTS) & ~has_any(F.col("_idea"), terms.DISCORDANT_PRODUCTS)
    )
    return F.coalesce(foreign | odd, F.lit(False))


def operand_candidates(items: DataFrame, only_valid: bool = True) -> DataFrame:
    """Long table of scored operand candidates: ``request_id, slot, score, cand_year, candidate_id, operand``.

    ``items`` are triangulated claims joined with their request: besides the claim columns they carry
    ``request_id, business_idea, target_geography, target_year`` and optionally ``target_product,
    target_industry, target_customer``. Rejected claims never become operands.
    """
    if only_valid and "is_valid" in items.columns:
        items = items.filter("is_valid")
    df = _prepared(items)
    percent = F.col("_unit").isin(*terms.PERCENT_UNITS)
    money = F.col("_cur").isNotNull() | F.col("_unit").isin("usd", "inr", "eur", "gbp", "dollars", "rupees")
    subset = has_any(F.col("_metric"), terms.SERVICEABLE_METRIC_TERMS)
    slot = (
        F.when(_is_count(), F.when(subset, "serviceable").otherwise("customers"))
        .when(percent, F.when(percent_rejection().isNull(), _percent_role()))
        .when(money, _money_role())
    )
    df = computed_once(df, {"slot": slot}).filter(F.col("slot").isNotNull())
    df = df.withColumn("_place", F.when(F.col("slot") == "macro", _macro_place()).otherwise(F.coalesce("geography", "target_geography")))
    place = low(F.col("_place"))
    df = df.filter(~((F.col("slot") == "macro") & _macro_excluded(place)))

    tgt, geo = F.col("_tgt"), F.col("_geo")
    count_points = F.when((tgt != "") & (geo == tgt), 50.0).when((tgt != "") & geo.contains(tgt), 30.0).otherwise(10.0)
    generic = has_any(F.col("_ctx"), terms.GENERIC_MACRO_TERMS) & ~F.exists(
        F.col("_words"), lambda w: w.isin("national", "gdp", "macro", "entire", "overall")
    )
    macro_points = (
        F.when((tgt != "") & (place == tgt), 100.0).when((tgt != "") & place.contains(tgt), 85.0)
        .when(place.isin("global", "worldwide", "world"), 40.0).otherwise(10.0)
        + F.when(_industry_match(), 40.0).otherwise(0.0)
        + F.when(_product_match(), 30.0).otherwise(0.0)
        + F.least(F.lit(50.0), F.size(F.filter(F.col("_words"), lambda w: F.col("_full").contains(w))) * 15.0)
        - F.when(generic, 80.0).otherwise(0.0)
    )
    slot_points = (
        F.when(F.col("slot").isin("customers", "serviceable"), count_points)
        .when(F.col("slot") == "geo_pct", F.when((tgt != "") & F.col("_full").contains(tgt), 100.0).otherwise(60.0))
        .when(F.col("slot") == "share", 80.0)
        .when(F.col("slot") == "segment_pct", F.when(_idea_match(), 50.0).otherwise(30.0))
        .when(F.col("slot") == "macro", macro_points)
        .otherwise(50.0)
    )
    is_macro = F.col("slot") == "macro"
    is_percent = F.col("slot").isin("geo_pct", "segment_pct", "share")

    def bound(column: str, own: str) -> Column:
        inside = F.when(F.col(column).between(0, 100), F.col(column))
        stated = F.when(F.col(own) >= terms.MACRO_SCALE, F.col(own))
        return F.when(is_percent, inside).when(is_macro, stated).otherwise(F.col(column))

    built = op.operand(
        F.col("metric"), F.col("_v"), F.when(is_percent, "%").otherwise(F.coalesce("unit", F.lit("units"))),
        currency=F.when(F.col("slot").isin("macro", "price"), F.coalesce("_cur", F.lit("USD"))),
        year=F.col("_year"), geography=F.col("_place"), range_min=bound("_lo", "range_min"), range_max=bound("_hi", "range_max"),
        lifecycle_stage=_column(items, "lifecycle_stage"), source_quality_tier=_column(items, "source_quality_tier"),
        source_url=_column(items, "source_url"), source_name=_column(items, "source_name"),
        confidence=F.when(~is_percent, _column(items, "confidence")), data_type="sourced",
        entity_concept=F.when(is_percent, F.lit(None)).when(F.col("slot").isin("macro", "price"), F.col("metric")).otherwise(F.col("_unit")),
        market_scope=_column(items, "market_scope"),
        is_prior_year=F.coalesce(F.col("year") < F.col("target_year"), F.lit(False)), evidence_id=F.col("candidate_id"),
    )
    out = computed_once(df, {"score": slot_points + base_score(items), "operand": built}).filter(op.is_usable(F.col("operand")))
    return out.select("request_id", "target_geography", "slot", "score", F.col("_year").cast("double").alias("cand_year"), "candidate_id", "operand")


def best_operands(candidates: DataFrame) -> DataFrame:
    """Top candidate per (request, slot) by score, year, id.

    A macro operand without a stated range gets the range of all macro candidates of its place. Two
    levels of partial aggregation: per place, then per slot.
    """
    rank = F.struct("score", "cand_year", "candidate_id")
    place = F.when(F.col("slot") == "macro", low(F.col("operand.geography")))
    per_place = candidates.withColumn("_place", place).groupBy("request_id", "slot", "_place").agg(
        F.max_by(F.struct("operand", "score", "cand_year", "candidate_id"), rank).alias("top"),
        F.min("operand.value").alias("lo"), F.max("operand.value").alias("hi"), F.count("*").alias("n"),
    )
    best = per_place.groupBy("request_id", "slot").agg(
        F.max_by(F.struct("top", "lo", "hi", "n"), F.struct("top.score", "top.cand_year", "top.candidate_id")).alias("b"),
        F.sum("n").alias("n_candidates"),
    )
    o = F.col("b.top.operand")
    stated = o["range_min"].isNotNull() & o["range_max"].isNotNull()
    widen = (F.col("slot") == "macro") & ~stated
    several = F.col("b.n") > 1
    ranged = o.withField("range_min", F.when(several, F.col("b.lo"))).withField("range_max", F.when(several, F.col("b.hi")))
    return best.select(
        "request_id", "slot", F.col("b.top.score").alias("score"), F.col("b.top.candidate_id").alias("candidate_id"),
        "n_candidates", F.when(widen, ranged).otherwise(o).alias("operand"),
    )


def pivot_operands(best: DataFrame) -> DataFrame:
    """One row per request with one operand column per slot."""
    return best.groupBy("request_id").agg(
        *[F.any_value(F.when(F.col("slot") == s, F.col("operand")), ignoreNulls=True).alias(s) for s in SLOTS]
    )


def _assumed(a: Column, unit: Column, currency: Column) -> Column:
    return op.operand(a["name"], a["value"], unit, currency=currency, is_assumption=True, assumption_justification=a["justification"], data_type="sourced")


def apply_assumptions(pivoted: DataFrame) -> DataFrame:
    """Override slots by the request's ``assumptions`` array: by name keyword, the last usable one wins.

    A second pass lets top-down names replace the macro figure. Duplicate names (ignoring case) count once,
    with the last value.
    """
    given = F.coalesce("assumptions", F.array().cast(f"array<{ASSUMPTION_DDL}>"))
    names = F.transform(given, lambda a: F.lower(a["name"]))
    last = F.filter(given, lambda a, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), F.lower(a["name"])))
    df = pivoted.withColumn("_a", last)

    def slot_of(name: Column) -> Column:
        out = None
        for slot, words in terms.ASSUMPTION_SLOTS:
            hit = has_any(name, words)
            out = F.when(hit, slot) if out is None else out.when(hit, slot)
        return out

    percent = ("share", "geo_pct", "segment_pct")

    def winner(matches) -> Column:
        return F.try_element_at(F.filter(matches, lambda o: op.is_usable(o)), F.lit(-1))

    def code(unit: Column) -> Column:
        return F.when(F.upper(unit).isin("USD", "INR", "EUR", "GBP"), F.upper(unit))

    def for_slot(slot: str) -> Column:
        chosen = F.filter(F.col("_a"), lambda a: slot_of(F.lower(a["name"])) == slot)
        if slot in percent:
            made = F.transform(chosen, lambda a: _assumed(a, F.lit("%"), F.lit(None)))
        elif slot == "serviceable":
            made = F.transform(chosen, lambda a: _assumed(a, F.coalesce(a["unit"], F.lit("units")), F.lit(None)))
        else:
            made = F.transform(chosen, lambda a: _assumed(a, a["unit"], code(a["unit"])))
        return winner(made)

    top_down = winner(F.transform(
        F.filter(F.col("_a"), lambda a: has_any(F.lower(a["name"]), terms.TOP_DOWN_ASSUMPTIONS)),
        lambda a: _assumed(a, a["unit"], code(a["unit"])),
    ))
    slots = {s: F.coalesce(for_slot(s), F.col(s)) for s, _ in terms.ASSUMPTION_SLOTS}
    slots["macro"] = F.coalesce(top_down, slots["macro"])
    return computed_once(df, slots).drop("_a")


def sizing_requests(requests: DataFrame, best: DataFrame) -> DataFrame:
    """Requests with their chosen operands in the columns that the sizing operators read.

    A geographic share is dropped when the macro figure is already local to the target place.
    ``requests`` carries ``request_id, business_idea, target_geography, target_year`` and optionally
    ``assumptions, pricing_basis, pricing_frequency``.
    """
    joined = requests.join(pivot_operands(best), "request_id", "left")
    if "assumptions" not in joined.columns:
        joined = joined.withColumn("assumptions", F.array().cast(f"array<{ASSUMPTION_DDL}>"))
    df = apply_assumptions(joined)
    place, target = F.lower("macro.geography"), F.lower("target_geography")
    local = F.coalesce((place == target) | place.contains(target), F.lit(False))
    none, empty = op.no_operand(), op.no_operands()
    return df.withColumns({
        "geo_pct": F.when(~local, F.col("geo_pct")),
        "td_share": F.col("share"), "bu_share": F.col("share"), "pricing": F.col("price"),
        "target_customer_pct": F.col("segment_pct"), "obtainable": none, "base_organizations": none,
        "base_segment_pct": none, "providers": none, "seats": none, "volume": none,
        "segment_percentages": empty, "other_filters": empty,
        "pricing_basis": _column(joined, "pricing_basis"),
        "pricing_frequency": F.coalesce(_column(joined, "pricing_frequency"), F.lit("annual")),
    }).drop("share", "price")
