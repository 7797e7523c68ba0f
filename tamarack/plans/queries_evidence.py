"""Registered queries: claim checks, grouping, corroboration, operands."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import claim_rules as rules
from tamarack.functions import source_rules as src
from tamarack.functions import text as tx
from tamarack.operators import evidence as ev
from tamarack.operators import incremental as inc
from tamarack.operators import operands as opd
from tamarack.operators import requests as req
from tamarack.plans import corpus
from tamarack.plans import report as rep
from tamarack.plans.registry import CLAIMS, GROUPS, query
from tamarack.sources.shared import written_once

_RELEVANCE = CLAIMS + """,
rel AS (
  SELECT *, CASE WHEN k % 2 = 0 OR n_name = 'NATION_3' THEN 100.0 ELSE 70.0 END AS geo, round(q * 100, 1) AS qp FROM quality
),
scored AS (
  SELECT *, round((75.0 * 20.0 + 85.0 * 20.0 + geo * 15.0 + 45.0 * 15.0 + qp * 15.0 + 85.0 * 10.0 + 25.0 * 5.0) / 100.0, 1) AS relevance FROM rel
)"""


@query("source_quality", f"""
WITH {CLAIMS} SELECT candidate_id, domain, q AS score, tier FROM quality""")
def source_quality(spark, sf):
    df = ev.score_sources(corpus.claims(spark, sf))
    return df.select("candidate_id", "domain", F.col("source_quality_score").alias("score"), F.col("source_quality_tier").alias("tier"))


@query("claim_validation", f"""
WITH {_RELEVANCE}
SELECT candidate_id, CASE WHEN k % 5 = 4 THEN 'rejected' ELSE 'valid' END AS validation_status,
  CASE WHEN k % 5 = 4 THEN 'UNUSABLE_SOURCE' END AS rejection_category,
  CASE WHEN k % 5 <> 4 AND q >= 0.70 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN k % 5 = 4 THEN 'extracted' ELSE 'validated' END AS lifecycle_stage FROM scored""")
def claim_validation(spark, sf):
    df = ev.validate_claims(corpus.business(corpus.claims(spark, sf)))
    return df.select("candidate_id", "validation_status", "rejection_category", "confidence", "lifecycle_stage")


@query("structural_errors", f"""
WITH {CLAIMS}, broken AS (SELECT *, k % 6 AS kind FROM cl)
SELECT candidate_id, CASE kind WHEN 1 THEN 'missing_value' WHEN 2 THEN 'negative_value' WHEN 3 THEN 'unknown_unit'
  WHEN 4 THEN 'year_out_of_bounds,url_not_http' WHEN 5 THEN 'missing_context' ELSE '' END AS errors FROM broken""")
def structural_errors(spark, sf):
    kind = F.col("supp_key") % 6
    df = corpus.claims(spark, sf).withColumns({
        "value": F.when(kind == 2, -F.col("value")).when(kind != 1, F.col("value")),
        "unit": F.when(kind == 3, "parsecs").otherwise(F.col("unit")), "year": F.when(kind == 4, F.col("year") - 200).otherwise(F.col("year")),
        "source_url": F.when(kind == 4, F.regexp_replace("source_url", "^https", "ftp")).otherwise(F.col("source_url")),
        "source_context": F.when(kind == 5, " ").otherwise(F.col("source_context")),
    })
    return df.select("candidate_id", F.array_join(ev.structural_errors(df), ",").alias("errors"))


@query("relevance_score", f"""
WITH {_RELEVANCE} SELECT candidate_id, geo AS geography_score, 75.0 AS industry_score, 45.0 AS customer_score, 85.0 AS product_score,
  relevance AS relevance_score FROM scored""")
def relevance_score(spark, sf):
    df = ev.relevance(ev.score_sources(corpus.business(corpus.claims(spark, sf))))
    return df.select("candidate_id", "geography_score", "industry_score", "customer_score", "product_score", "relevance_score")


@query("market_scope", f"""
WITH {CLAIMS} SELECT pt AS part_type, 'Addressable market' AS market_scope, CAST(count(*) AS BIGINT) AS claims FROM cl GROUP BY 1""")
def market_scope(spark, sf):
    df = ev.relevance(ev.score_sources(corpus.business(corpus.claims(spark, sf))))
    return df.groupBy("part_type", "market_scope").agg(F.count("*").alias("claims"))


_NOISE_SQL = terms.PHONE_PATTERN.replace("'", "''")


def _sql_any(col: str, words) -> str:
    return f"regexp_matches({col}, '{terms.alternation(words)}')".replace("''", "'")


@query("noise_gate", f"""
WITH d AS (SELECT doc_id, lower(trim(text)) AS c, lower(lang) AS u, CAST(n_chars AS DOUBLE) AS v FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(c, '{_NOISE_SQL}') OR {_sql_any('c', terms.CONTACT_TERMS)} THEN 'NOISE_CONTACT_INFO'
  WHEN {_sql_any('c', terms.NAVIGATION_TERMS)} THEN 'NAVIGATION_TEXT' END AS noise FROM d""")
def noise_gate(spark, sf):
    d = corpus.table(spark, sf, "documents")
    return d.select("doc_id", rules.noise_category(F.lit("size"), F.col("lang"), F.col("text"), F.col("n_chars").cast("double")).alias("noise"))


@query("suitability", f"""
WITH {CLAIMS}
SELECT candidate_id, k % 2 = 0 OR n_name = 'NATION_3' AS geographic_match,
  CASE WHEN k % 2 = 0 OR n_name = 'NATION_3' THEN 'LOW' ELSE 'UNSUITABLE' END AS rating FROM cl""")
def suitability(spark, sf):
    df = ev.validate_claims(corpus.business(corpus.claims(spark, sf)))
    return df.select("candidate_id", F.col("suitability.geographic_match").alias("geographic_match"), F.col("suitability.overall").alias("rating"))


def _valid(spark, sf):
    return ev.validate_claims(corpus.claims(spark, sf)).filter("is_valid")


@query("dup_groups", f"""
WITH {GROUPS} SELECT group_id, candidate_id, v AS value, n_claims, n_urls, n_domains, max_q AS max_quality, strong AS has_authority FROM grp""")
def dup_groups(spark, sf):
    g = ev.duplicate_groups(ev.with_claim_keys(_valid(spark, sf)))
    return g.select("group_id", "candidate_id", "value", "n_claims", "n_urls", "n_domains", F.col("max_quality_score").alias("max_quality"), "has_authority")


@query("group_members", f"""
WITH {CLAIMS} SELECT group_id, subject_id, candidate_id, domain FROM keyed""")
def group_members(spark, sf):
    return ev.group_members(corpus.claims(spark, sf)).select("group_id", "subject_id", "candidate_id", "domain")


@query("conflicts", f"""
WITH {GROUPS} SELECT subject_id, n_values, min_value, max_value, subject_claims FROM conf""")
def conflicts(spark, sf):
    c = ev.conflicts(ev.duplicate_groups(ev.with_claim_keys(_valid(spark, sf))))
    return c.select("subject_id", "n_values", "min_value", "max_value", "subject_claims")


@query("conflicting_values", f"""
WITH {GROUPS} SELECT g.subject_id, g.group_id, g.v AS value, g.n_claims FROM grp g JOIN conf c USING (subject_id)""")
def conflicting_values(spark, sf):
    return ev.conflicting_values(ev.duplicate_groups(ev.with_claim_keys(_valid(spark, sf)))).select("subject_id", "group_id", "value", "n_claims")


@query("triangulation", f"""
WITH {GROUPS}
SELECT group_id, candidate_id, v AS value, validation_status, lifecycle_stage, confidence, n_domains AS corroborating_source_count,
  CAST(CASE WHEN n_values IS NOT NULL THEN subject_claims - n_claims ELSE 0 END AS BIGINT) AS conflicting_source_count, is_syndicated FROM tri""")
def triangulation(spark, sf):
    t = ev.triangulate(corpus.claims(spark, sf))
    return t.select("group_id", "candidate_id", "value", "validation_status", "lifecycle_stage", "confidence", "corroborating_source_count",
                    "conflicting_source_count", "is_syndicated")


@query("triangulation_batches", f"""
WITH {GROUPS}
SELECT group_id, candidate_id, v AS value, validation_status, lifecycle_stage, confidence, n_claims, n_urls, n_domains AS corroborating_source_count,
  CAST(CASE WHEN n_values IS NOT NULL THEN subject_claims - n_claims ELSE 0 END AS BIGINT) AS conflicting_source_count, is_syndicated FROM tri""")
def triangulation_batches(spark, sf):
    """Three batches of claims, each reduced to facts by itself; the facts merge to the statuses of one run."""
    checked = ev.validate_claims(corpus.claims(spark, sf))
    parts = [inc.claim_facts(checked.filter(F.col("supp_key") % 3 == i)) for i in range(3)]
    groups = inc.groups_of_facts(inc.merge_facts(inc.merge_facts(parts[0], parts[1]), parts[2]))
    t = ev.statuses(written_once(groups, "claim-groups"))
    return t.select("group_id", "candidate_id", "value", "validation_status", "lifecycle_stage", "confidence", "n_claims", "n_urls",
                    "corroborating_source_count", "conflicting_source_count", "is_syndicated")


@query("corroborated", f"""
WITH {GROUPS} SELECT group_id, metric, n_name AS geography, yr AS year, n_domains AS domains FROM tri WHERE lifecycle_stage = 'verified'""")
def corroborated(spark, sf):
    t = ev.triangulate(corpus.claims(spark, sf)).filter(F.col("lifecycle_stage") == "verified")
    return t.select("group_id", "metric", "geography", "year", F.col("corroborating_source_count").alias("domains"))


@query("syndicated", """
WITH d AS (SELECT coalesce(source, '') AS source, 'd' || doc_id AS url, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS c FROM documents)
SELECT source, CAST(count(*) AS BIGINT) AS documents, count(*) FILTER (length(c) > 30) > count(DISTINCT c) FILTER (length(c) > 30) AS is_syndicated
FROM d GROUP BY source""")
def syndicated(spark, sf):
    """Groups of one claim per source: whether a text of theirs is republished."""
    none = F.lit(None).cast("double")
    claims = corpus.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("candidate_id"), F.coalesce("source", F.lit("")).alias("metric"), F.lit("count").alias("metric_type"), F.lit(1.0).alias("value"),
        none.alias("range_min"), none.alias("range_max"), F.lit("users").alias("unit"), F.lit("India").alias("geography"), F.lit(2024).alias("year"),
        F.concat(F.lit("https://d.org/"), F.col("doc_id").cast("string")).alias("source_url"), F.col("text").alias("source_context"))
    g = ev.duplicate_groups(claims)
    return g.select(F.col("metric").alias("source"), F.col("n_claims").alias("documents"), "is_syndicated")


@query("distinct_provenance", f"""
WITH {CLAIMS} SELECT group_id, source_url, min(q) AS score FROM keyed WHERE k % 5 <> 4 GROUP BY ALL""")
def distinct_provenance(spark, sf):
    p = ev.distinct_provenance(ev.validate_claims(corpus.claims(spark, sf)))
    return p.select("group_id", "source_url", F.col("source_quality_score").alias("score"))


@query("evidence_rating", f"""
WITH {GROUPS}, r AS (
  SELECT yr, count(*) AS n, count(*) FILTER (tier LIKE 'Tier 1%') AS t1, count(*) FILTER (tier LIKE 'Tier 2%') AS t2,
    count(*) FILTER (tier LIKE 'Tier 3%') AS t3, count(*) FILTER (lifecycle_stage = 'verified') AS ver, bool_or(validation_status = 'conflict') AS hot
  FROM tri GROUP BY yr)
SELECT yr AS year, CAST(n AS BIGINT) AS n_valid, CAST(ver AS BIGINT) AS n_verified,
  CASE WHEN hot THEN 'LOW' WHEN t1 >= 1 AND ver >= 1 THEN 'HIGH'
    WHEN (t1 >= 1 OR t2 >= 1) AND n >= 2 THEN CASE WHEN ver >= 1 THEN 'HIGH' ELSE 'MEDIUM' END
    WHEN t3 >= 1 OR n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS evidence_rating FROM r""")
def evidence_rating(spark, sf):
    return ev.evidence_rating(ev.triangulate(corpus.claims(spark, sf)), by=("year",)).select("year", "n_valid", "n_verified", "evidence_rating")


@query("evidence_summary", f"""
WITH {GROUPS},
d AS (SELECT n_name, count(*) AS found, count(*) FILTER (s_suppkey % 4 <> 3) AS fetched FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
x AS (SELECT n_name, count(*) AS n, count(*) FILTER (k % 5 <> 4) AS ok FROM cl GROUP BY 1),
t AS (SELECT n_name, count(*) FILTER (lifecycle_stage = 'verified') AS verified,
        count(DISTINCT CASE WHEN validation_status = 'conflict' THEN subject_id END) AS conflicts FROM tri GROUP BY 1)
SELECT n_name AS request_id, found AS total_discovered, fetched AS total_fetched, coalesce(n, 0) AS total_extracted, coalesce(ok, 0) AS total_validated,
  coalesce(verified, 0) AS total_verified, coalesce(conflicts, 0) AS total_conflicts
FROM d LEFT JOIN x USING (n_name) LEFT JOIN t USING (n_name)""")
def evidence_summary(spark, sf):
    checked = ev.validate_claims(corpus.claims(spark, sf).withColumn("request_id", F.col("geography")))
    checked = written_once(checked.select("request_id", "is_valid", "domain", "source_quality_score", *ev._CANONICAL, *ev.KEPT), "checked-claims")
    tri = ev.triangulate(checked, validated=True)
    nation = corpus.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("request_id"))
    sources = corpus.table(spark, sf, "supplier").join(nation, "s_nationkey").select("request_id", "s_suppkey")
    status = F.when(F.col("s_suppkey") % 4 == 3, "fetch_failed").when(F.col("s_suppkey") % 4 == 2, "snippet_fallback").otherwise("success")
    return rep.evidence_summary(sources, sources.withColumn("fetch_status", status), checked, tri)


@query("coverage_cube", f"""
WITH {CLAIMS} SELECT n_name AS geography, tier, CAST(count(*) AS BIGINT) AS claims, CAST(count(DISTINCT domain) AS BIGINT) AS domains
FROM quality GROUP BY CUBE (n_name, tier)""")
def coverage_cube(spark, sf):
    df = ev.score_sources(corpus.claims(spark, sf)).withColumnRenamed("source_quality_tier", "tier")
    return df.cube("geography", "tier").agg(F.count("*").alias("claims"), F.countDistinct("domain").alias("domains"))


@query("evidence_items", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 2 AND s_suppkey % 3 = 0 THEN 'assumption' ELSE (['unknown','government','news'])[CAST(s_suppkey % 3 + 1 AS INTEGER)] END AS source_type,
  concat_ws(',', CASE WHEN s_suppkey % 5 = 0 THEN 'value_without_unit' END, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 7 = 0 THEN 'verified_without_source' END,
    CASE WHEN s_suppkey % 4 = 3 THEN 'unknown_with_value' END, CASE WHEN s_suppkey % 4 = 2 AND s_suppkey % 3 = 1 THEN 'assumed_as_official' END) AS errors,
  concat_ws(',', CASE WHEN s_suppkey % 4 = 2 THEN 'unverified_assumption' END, CASE WHEN s_suppkey % 4 = 0 THEN 'no_source_url' END,
    CASE WHEN s_suppkey % 20 < 10 THEN 'historical_data' END) AS warnings
FROM supplier""")
def evidence_items(spark, sf):
    s, k = corpus.table(spark, sf, "supplier"), F.col("s_suppkey")
    items = s.select(
        "s_suppkey", F.lit("balance").alias("metric"), F.col("s_acctbal").alias("value"), F.when(k % 5 != 0, "USD").alias("unit"),
        F.lit("India").alias("geography"), (k % 20 + 2010).cast("int").alias("year"), F.when(k % 7 != 0, F.col("s_name")).alias("source_name"),
        F.lit(None).cast("string").alias("source_url"), corpus.pick(("unknown", "government", "news"), k % 3).alias("source_type"),
        corpus.pick(("verified", "inferred", "assumed", "unknown"), k % 4).alias("evidence_status"),
    )
    out = ev.check_evidence_items(items)
    return out.select("s_suppkey", "source_type", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


# -- operands -----------------------------------------------------------------------------------


def _items(spark, sf):
    """Triangulated claims of every nation, joined with that nation's request."""
    checked = ev.validate_claims(corpus.claims(spark, sf).withColumn("request_id", F.col("geography")))
    groups = written_once(ev.claim_groups(checked), "claim-groups")
    return ev.statuses(groups).withColumns({
        "business_idea": F.lit("Economy goods platform"), "target_geography": F.col("request_id"), "target_year": F.lit(1998),
    })


_SCORED = GROUPS + """,
cand AS (
  SELECT n_name AS request_id, CASE WHEN v >= 1e6 THEN 'macro' ELSE 'price' END AS slot, candidate_id, v, yr,
    CASE WHEN v >= 1e6 THEN 100.0 + CASE WHEN pt = 'ECONOMY' THEN 15.0 ELSE 0.0 END ELSE 50.0 END
    + CASE abs(yr - 1998) WHEN 0 THEN 40.0 WHEN 1 THEN 30.0 ELSE CASE WHEN abs(yr - 1998) <= 3 THEN 15.0 ELSE 5.0 END END
    + CASE substr(tier, 6, 1) WHEN '1' THEN 40.0 WHEN '2' THEN 30.0 WHEN '3' THEN 20.0 ELSE 10.0 END
    + least(15.0, n_domains * 7.5) + CASE WHEN lifecycle_stage = 'verified' THEN 15.0 ELSE 10.0 END AS score
  FROM tri
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, slot ORDER BY score DESC, yr DESC, candidate_id DESC) AS rn,
    min(v) OVER (PARTITION BY request_id, slot) AS lo, max(v) OVER (PARTITION BY request_id, slot) AS hi,
    count(*) OVER (PARTITION BY request_id, slot) AS n FROM cand
)"""


@query("operand_topk", f"""
WITH {_SCORED} SELECT request_id, slot, candidate_id, score, v AS value, CAST(n AS BIGINT) AS n_candidates FROM top WHERE rn = 1""")
def operand_topk(spark, sf):
    best = opd.best_operands(opd.operand_candidates(_items(spark, sf)))
    return best.select("request_id", "slot", "candidate_id", "score", F.col("operand.value").alias("value"), "n_candidates")


@query("operand_range", f"""
WITH {_SCORED} SELECT request_id, CASE WHEN n > 1 THEN lo END AS range_min, CASE WHEN n > 1 THEN hi END AS range_max FROM top WHERE rn = 1 AND slot = 'macro'""")
def operand_range(spark, sf):
    best = opd.best_operands(opd.operand_candidates(_items(spark, sf))).filter(F.col("slot") == "macro")
    return best.select("request_id", F.col("operand.range_min").alias("range_min"), F.col("operand.range_max").alias("range_max"))


@query("operand_pivot", f"""
WITH {_SCORED} SELECT request_id, max(v) FILTER (slot = 'macro') AS macro, max(v) FILTER (slot = 'price') AS price FROM top WHERE rn = 1 GROUP BY 1""")
def operand_pivot(spark, sf):
    p = opd.pivot_operands(opd.best_operands(opd.operand_candidates(_items(spark, sf))))
    return p.select("request_id", F.col("macro.value").alias("macro"), F.col("price.value").alias("price"))


@query("assumption_override", f"""
WITH {_SCORED}, n AS (SELECT request_id, max(v) FILTER (slot = 'price') AS price FROM top WHERE rn = 1 GROUP BY 1)
SELECT request_id, 5e9 AS macro, 12.5 AS share, 40.0 AS segment_pct, price FROM n""")
def assumption_override(spark, sf):
    best = opd.best_operands(opd.operand_candidates(_items(spark, sf)))
    given = F.expr("""array(
      named_struct('name', 'Market_Size', 'value', 4e9D, 'unit', 'USD', 'justification', 'first', 'is_user_provided', true),
      named_struct('name', 'market_size', 'value', 5e9D, 'unit', 'USD', 'justification', 'last wins', 'is_user_provided', true),
      named_struct('name', 'obtainable_share', 'value', 12.5D, 'unit', '%', 'justification', '', 'is_user_provided', true),
      named_struct('name', 'target_segment', 'value', 40D, 'unit', '%', 'justification', '', 'is_user_provided', true),
      named_struct('name', 'segment_share', 'value', 140D, 'unit', '%', 'justification', 'out of bounds: ignored', 'is_user_provided', true))""")
    p = opd.apply_assumptions(opd.pivot_operands(best).withColumn("assumptions", given))
    return p.select("request_id", *[F.col(f"{s}.value").alias(s) for s in ("macro", "share", "segment_pct", "price")])


@query("ranked_sizing", f"""
WITH {_SCORED}
SELECT request_id, max(v) FILTER (slot = 'macro') AS tam,
  CASE WHEN max(v) FILTER (slot = 'macro') IS NULL THEN 'insufficient_evidence' ELSE 'calculated' END AS status FROM top WHERE rn = 1 GROUP BY 1""")
def ranked_sizing(spark, sf):
    best = opd.best_operands(opd.operand_candidates(_items(spark, sf)))
    requests = corpus.table(spark, sf, "nation").join(best.select("request_id").distinct(), F.col("n_name") == F.col("request_id")).select(
        "request_id", F.lit("Economy goods platform").alias("business_idea"), F.col("request_id").alias("target_geography"), F.lit(1998).alias("target_year"),
    )
    from tamarack.operators.sizing import top_down

    return top_down(opd.sizing_requests(requests, best)).select("request_id", F.col("td_tam.estimate").alias("tam"), F.col("td_tam.status").alias("status"))


def _first_match(spark, sf):
    checked = ev.validate_claims(corpus.claims(spark, sf).withColumn("request_id", F.col("geography")))
    return req.first_match_inputs(ev.triangulate(checked, validated=True))


@query("first_match_inputs", f"""
WITH {GROUPS}
SELECT n_name AS request_id, arg_min(v, (source_url, candidate_id)) FILTER (v > 1e7) AS macro, arg_min(v, (source_url, candidate_id)) FILTER (yr <= 2024 AND v > 1e6) AS begin_value
FROM tri GROUP BY 1""")
def first_match_inputs(spark, sf):
    return _first_match(spark, sf).select("request_id", F.col("first_macro.value").alias("macro"), F.col("begin_value.value").alias("begin_value"))


@query("percent_roles", """
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS kind FROM supplier)
SELECT k AS s_suppkey, CASE kind WHEN 0 THEN 'growth' WHEN 1 THEN 'operational' WHEN 2 THEN 'foreign_place' WHEN 3 THEN 'competitor_share' END AS rejection,
  CASE kind WHEN 4 THEN 'segment_pct' WHEN 5 THEN 'share' END AS slot FROM s""")
def percent_roles(spark, sf):
    k = F.col("s_suppkey")
    texts = (
        "demand is growing fast", "the churn of clients is known", "the share in europe is known", "the market leader holds this part",
        "tutors represent this portion of the market", "the obtainable market share of a newcomer",
    )
    items = corpus.table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("r"), k.cast("string")).alias("request_id"), F.lit("tutoring platform for tutors").alias("business_idea"),
        F.lit("India").alias("target_geography"), F.lit(2025).alias("target_year"), F.lit("tutors").alias("target_customer"),
        F.lit("share of buyers").alias("metric"), F.lit("market_share").alias("metric_type"), (k % 90 + 5).cast("double").alias("value"),
        F.lit("%").alias("unit"), F.lit("India").alias("geography"), F.lit(2025).alias("year"), F.lit(None).cast("double").alias("range_min"),
        F.lit(None).cast("double").alias("range_max"), F.concat((k % 90 + 5).cast("string"), F.lit("%")).alias("raw_value_expression"),
        corpus.pick(texts, k % 6).alias("source_context"), k.cast("string").alias("candidate_id"), F.lit(True).alias("is_valid"),
        F.lit(terms.TIER_1).alias("source_quality_tier"), F.lit("validated").alias("lifecycle_stage"),
    )
    why = opd._prepared(items).select("s_suppkey", "candidate_id", opd.percent_rejection().alias("rejection"))
    roles = opd.operand_candidates(items).select("candidate_id", "slot")
    return why.join(roles, "candidate_id", "left").select("s_suppkey", "rejection", "slot")
