"""Registered queries: sizing, comparison, reliability, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarack.functions.measures import cagr, freshness, freshness_age
from tamarack.operators import reliability as rel
from tamarack.operators import sizing
from tamarack.plans import corpus
from tamarack.plans import report as rep
from tamarack.plans.registry import REQUESTS, query


def _r(col: str, digits: int = 2):
    return F.round(F.col(col), digits)


@query("td_funnel", f"""
WITH {REQUESTS}
SELECT request_id, td_status AS tam_status, CASE WHEN NOT bad THEN round(tam, 2) END AS tam, td_status AS sam_status,
  CASE WHEN NOT bad THEN round(sam, 2) END AS sam, td_som_status AS som_status, round(som, 2) AS som,
  CASE WHEN NOT bad THEN round(sam / tam * 100, 2) END AS sam_percent
FROM sized""")
def td_funnel(spark, sf):
    df = sizing.top_down(corpus.sizing_requests(spark, sf))
    return df.select(
        "request_id", F.col("td_tam.status").alias("tam_status"), _r("td_tam.estimate").alias("tam"), F.col("td_sam.status").alias("sam_status"),
        _r("td_sam.estimate").alias("sam"), F.col("td_som.status").alias("som_status"), _r("td_som.estimate").alias("som"),
        F.col("td_sam.percent_of_parent").alias("sam_percent"),
    )


@query("bu_funnel", f"""
WITH {REQUESTS}
SELECT request_id, round(bu_tam, 2) AS tam, round(bu_sam, 2) AS sam, bu_som_status AS som_status, round(bu_som, 2) AS som,
  round(srv, 4) AS serviceable, round(rev, 2) AS annual_revenue
FROM sized""")
def bu_funnel(spark, sf):
    df = sizing.bottom_up(corpus.sizing_requests(spark, sf))
    return df.select(
        "request_id", _r("bu_tam.estimate").alias("tam"), _r("bu_sam.estimate").alias("sam"), F.col("bu_som.status").alias("som_status"),
        _r("bu_som.estimate").alias("som"), _r("bu_sam.customer_count", 4).alias("serviceable"), _r("annual_revenue.point").alias("annual_revenue"),
    )


@query("bu_funnel_by_basis", f"""
WITH {REQUESTS}
SELECT (['per_facility','per_provider','per_seat','usage_based','monthly_flat'])[CAST(nk % 5 + 1 AS INTEGER)] AS pricing_basis,
  CAST(count(*) AS BIGINT) AS requests, CAST(sum(CAST(round(bu_tam, 0) AS DECIMAL(28,0))) AS DOUBLE) AS total_tam, max(round(rev, 2)) AS top_revenue
FROM sized GROUP BY 1""")
def bu_funnel_by_basis(spark, sf):
    df = sizing.bottom_up(corpus.sizing_requests(spark, sf))
    return df.groupBy("pricing_basis").agg(
        F.count("*").alias("requests"), F.sum(F.round("bu_tam.estimate", 0).cast("decimal(28,0)")).cast("double").alias("total_tam"),
        F.max(F.round("annual_revenue.point", 2)).alias("top_revenue"),
    )


@query("funnel_interval", f"""
WITH {REQUESTS}, x AS (
  SELECT request_id, 'top_down' AS method, 'tam' AS metric, tam_lo AS lo, tam AS p, tam_hi AS hi FROM sized WHERE NOT bad UNION ALL
  SELECT request_id, 'top_down', 'sam', sam_lo, sam, sam_hi FROM sized WHERE NOT bad UNION ALL
  SELECT request_id, 'top_down', 'som', sam_lo * (8.0/100.0), som, sam_hi * (12.0/100.0) FROM sized WHERE som IS NOT NULL UNION ALL
  SELECT request_id, 'bottom_up', 'tam', bu_tam_lo, bu_tam, bu_tam_hi FROM sized UNION ALL
  SELECT request_id, 'bottom_up', 'sam', bu_sam_lo, bu_sam, bu_sam_hi FROM sized UNION ALL
  SELECT request_id, 'bottom_up', 'som', bu_sam_lo * (8.0/100.0), bu_som, bu_sam_hi * (12.0/100.0) FROM sized WHERE bu_som IS NOT NULL)
SELECT request_id, method, metric, round(lo, 2) AS low, round(p, 2) AS point, round(hi, 2) AS high FROM x""")
def funnel_interval(spark, sf):
    rows = sizing.results_long(sizing.bottom_up(sizing.top_down(corpus.sizing_requests(spark, sf))))
    return rows.filter(F.col("status") == "calculated").select(
        "request_id", "method", "metric", _r("low").alias("low"), _r("estimate").alias("point"), _r("high").alias("high")
    )


_DIVERGENCE = REQUESTS + """,
cmp AS (
  SELECT *, nk = 17 AS mismatch, round(abs(tam - bu_tam), 2) AS a, (tam + bu_tam) / 2.0 AS mid FROM sized WHERE NOT bad
),
div AS (SELECT *, round(a / mid * 100.0, 2) AS pctd, round(greatest(tam, bu_tam) / least(tam, bu_tam), 2) AS ratio FROM cmp)"""


@query("method_divergence", f"""
WITH {_DIVERGENCE}
SELECT request_id, CASE WHEN mismatch THEN 'MISMATCH' ELSE 'USD' END AS currency, CASE WHEN NOT mismatch THEN a END AS absolute,
  CASE WHEN NOT mismatch THEN pctd END AS percent, CASE WHEN NOT mismatch THEN ratio END AS ratio,
  CASE WHEN mismatch THEN 'warning' WHEN pctd <= 20 THEN 'acceptable' WHEN pctd <= 50 THEN 'warning' ELSE 'severe_divergence' END AS severity,
  CASE WHEN mismatch THEN 'low' WHEN pctd <= 20 THEN 'high' WHEN pctd <= 50 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN NOT mismatch THEN round(round(abs(sam - bu_sam), 2) / ((sam + bu_sam) / 2.0) * 100.0, 2) END AS sam_percent,
  CASE WHEN NOT mismatch AND som IS NOT NULL THEN round(round(abs(som - bu_som), 2) / ((som + bu_som) / 2.0) * 100.0, 2) END AS som_percent
FROM div""")
def method_divergence(spark, sf):
    df = sizing.size_markets(corpus.sizing_requests(spark, sf)).filter(F.col("comparison").isNotNull())
    c = "comparison."
    return df.select(
        "request_id", *[F.col(c + n).alias(n) for n in ("currency", "absolute", "percent", "ratio", "severity", "confidence")],
        F.col(c + "sam.percent").alias("sam_percent"), F.col(c + "som.percent").alias("som_percent"),
    )


@query("divergence_diagnostics", f"""
WITH {_DIVERGENCE}
SELECT request_id, NOT mismatch AND tam > bu_tam * 3.0 AS market_definition, mismatch AS currency_mismatch,
  NOT mismatch AND nk % 6 = 0 AS assumptions_used FROM div""")
def divergence_diagnostics(spark, sf):
    df = sizing.size_markets(corpus.sizing_requests(spark, sf)).filter(F.col("comparison").isNotNull())
    d = F.col("comparison.diagnostics")
    return df.select(
        "request_id", F.array_contains(d, "market_definition_divergence").alias("market_definition"),
        F.array_contains(d, "currency_mismatch").alias("currency_mismatch"), F.exists(d, lambda x: x.startswith("modeling_assumptions")).alias("assumptions_used"),
    )


@query("scenario_bounds", f"""
WITH {REQUESTS}, s AS (
  SELECT *, nk % 2 = 0 AS r FROM sized),
t AS (SELECT *, round(bu_tam_lo, 2) AS tl, round(bu_tam_hi, 2) AS th FROM s),
u AS (SELECT *, round(tl * (20.0/100.0), 2) AS sl, round(th * (20.0/100.0), 2) AS sh FROM t)
SELECT request_id, CASE WHEN r THEN 'AVAILABLE' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, CASE WHEN r THEN tl END AS tam_low,
  CASE WHEN r THEN round(bu_tam, 2) END AS tam_base, CASE WHEN r THEN th END AS tam_high, CASE WHEN r THEN sl END AS sam_low,
  CASE WHEN r THEN sh END AS sam_high, CASE WHEN r AND bu_som IS NOT NULL THEN round(sl * (8.0/100.0), 2) END AS som_low,
  CASE WHEN r AND bu_som IS NOT NULL THEN round(sh * (12.0/100.0), 2) END AS som_high FROM u""")
def scenario_bounds(spark, sf):
    df = sizing.scenario_bounds(sizing.bottom_up(sizing.top_down(corpus.sizing_requests(spark, sf))))
    s = "scenarios."
    return df.select(
        "request_id", F.col(s + "status").alias("status"), F.col(s + "tam.low").alias("tam_low"), F.col(s + "tam.base").alias("tam_base"),
        F.col(s + "tam.high").alias("tam_high"), F.col(s + "sam.low").alias("sam_low"), F.col(s + "sam.high").alias("sam_high"),
        F.col(s + "som.low").alias("som_low"), F.col(s + "som.high").alias("som_high"),
    )


@query("sensitivity_rank", f"""
WITH {REQUESTS}, p AS (
  SELECT request_id, 0 AS r, 0 AS o, 'annual_price' AS parameter, price * 1.0 AS base_value, 'HIGH' AS impact FROM sized UNION ALL
  SELECT request_id, 0, 1, 'potential_customers', b, 'HIGH' FROM sized UNION ALL
  SELECT request_id, 1, 2, 'target_customer_percentage', 20.0, 'MEDIUM' FROM sized UNION ALL
  SELECT request_id, 0, 3, 'obtainable_market_share', 10.0, 'HIGH' FROM sized WHERE nk % 8 <> 0 UNION ALL
  SELECT request_id, 0, 4, 'macro_market_size', macro, 'HIGH' FROM sized UNION ALL
  SELECT request_id, 1, 5, 'Online', 80.0, 'MEDIUM' FROM sized WHERE nk % 2 = 1 UNION ALL
  SELECT request_id, 1, 6, 'Recurring', 50.0, 'MEDIUM' FROM sized WHERE nk % 2 = 1)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY r, o) AS INTEGER) AS rank, parameter,
  round(CAST(base_value AS DOUBLE), 2) AS base_value, impact FROM p""")
def sensitivity_rank(spark, sf):
    return sizing.sensitivity(corpus.sizing_requests(spark, sf)).select("request_id", "rank", "parameter", _r("base_value").alias("base_value"), "impact")


_REGISTRY = REQUESTS + """,
reg AS (
  SELECT *, CAST(nk % 8 <> 0 AS INTEGER) AS has_share, CAST(nk % 7 <> 0 AS INTEGER) AS has_seg, CAST(nk % 9 = 0 AS INTEGER) AS has_srv,
    CAST(nk % 6 = 0 AS INTEGER) AS assumed, CAST(nk % 2 = 1 AS INTEGER) AS odd FROM sized
),
counts AS (
  SELECT *, 6 + 2 * odd + has_seg + has_share + has_srv AS n_total, 1 + has_share + assumed * has_seg + assumed AS user_provided,
    assumed AS critical, 3 + has_srv + assumed * has_seg + has_share AS high_impact FROM reg
)"""


@query("assumption_registry", f"""
WITH {_REGISTRY}
SELECT request_id, CAST(n_total AS INTEGER) AS total, CAST(user_provided AS INTEGER) AS user_provided, 0 AS model_derived,
  CAST(critical AS INTEGER) AS critical, CAST(high_impact AS INTEGER) AS high_impact FROM counts""")
def assumption_registry(spark, sf):
    df = rel.assumption_registry(corpus.sizing_requests(spark, sf))
    return df.select("request_id", *[F.col(f"registry_counts.{c}").alias(c) for c in ("total", "user_provided", "model_derived", "critical", "high_impact")])


@query("reliability", f"""
WITH {_REGISTRY}, c AS (
  SELECT *, 5 + 2 * odd + has_srv + (1 - assumed) * has_seg - assumed AS plain,
    2 * has_share + assumed * has_seg + assumed AS assumed_ops, 2026 - (2026 - nk % 13) AS age FROM counts),
d AS (
  SELECT c.*, CASE WHEN NOT c.bad AND c.nk <> 17 THEN v.pctd END AS pctd, NOT c.bad AS both_ok FROM c LEFT JOIN
    (SELECT request_id, round(round(abs(tam - bu_tam), 2) / ((tam + bu_tam) / 2.0) * 100.0, 2) AS pctd FROM sized) v USING (request_id)),
e AS (
  SELECT *, CASE WHEN nk % 4 IN (0, 1) AND plain >= 2 AND assumed_ops = 0 THEN 'HIGH' WHEN nk % 4 IN (0, 1) AND plain >= 1 THEN 'MEDIUM'
      WHEN nk % 4 = 2 AND plain >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS strength,
    CASE WHEN critical >= 1 THEN 'CRITICAL' WHEN has_share + assumed * has_seg + assumed >= 2 OR user_provided >= 2 THEN 'HIGH'
      WHEN user_provided >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
    CASE WHEN age <= 2 THEN 'RECENT' WHEN age <= 5 THEN 'MODERATELY_OLD' WHEN age <= 10 THEN 'OLD' ELSE 'VERY_OLD' END AS fresh,
    CASE WHEN nk = 17 THEN 'WARNING' WHEN pctd <= 20 THEN 'ACCEPTABLE' WHEN pctd <= 50 THEN 'WARNING' ELSE 'SEVERE_DIVERGENCE' END AS agree FROM d)
SELECT request_id,
  CASE WHEN bad THEN 'INSUFFICIENT' WHEN risk = 'CRITICAL' OR strength = 'LOW' OR agree = 'SEVERE_DIVERGENCE' OR fresh = 'VERY_OLD' THEN 'LOW'
    WHEN fresh = 'OLD' THEN 'MEDIUM' WHEN strength = 'HIGH' AND risk IN ('LOW', 'MEDIUM') AND agree = 'ACCEPTABLE' AND fresh = 'RECENT' THEN 'HIGH'
    WHEN risk IN ('LOW', 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN bad THEN 'INSUFFICIENT' ELSE strength END AS evidence_strength, CASE WHEN bad THEN 'HIGH' ELSE risk END AS assumption_risk,
  CASE WHEN bad THEN 'UNKNOWN' ELSE fresh END AS freshness, CASE WHEN bad THEN 'SINGLE_METHOD' ELSE agree END AS methodology_agreement FROM e""")
def reliability(spark, sf):
    df = rep.report(corpus.sizing_requests(spark, sf))
    fields = ("level", "evidence_strength", "assumption_risk", "freshness", "methodology_agreement")
    return df.select("request_id", *[F.col(f"reliability.{c}").alias(c) for c in fields])


@query("report_headline", f"""
WITH {REQUESTS}
SELECT request_id, CASE WHEN bad THEN 'conflict' ELSE 'calculated' END AS report_status,
  CASE WHEN bad THEN 'bottom_up' ELSE 'top_down' END AS headline_method, round(CASE WHEN bad THEN bu_tam ELSE tam END, 2) AS tam,
  round(CASE WHEN bad THEN bu_sam ELSE sam END, 2) AS sam, round(CASE WHEN bad THEN bu_som ELSE som END, 2) AS som,
  CASE WHEN bad THEN 'conflict' WHEN nk % 8 = 0 THEN 'partial' ELSE 'completed' END AS final_status FROM sized""")
def report_headline(spark, sf):
    df = rep.headline(rep.report(corpus.sizing_requests(spark, sf)))
    return df.select(
        "request_id", "report_status", "headline_method", *[_r(f"{m}.estimate").alias(m) for m in ("tam", "sam", "som")], "final_status"
    )


@query("report_headline_pipeline", f"""
WITH {REQUESTS}, q AS (
  -- operands of the bottom-up TAM: customers and price carry the tier; providers, seats and volume have none
  SELECT *, CASE WHEN nk % 4 = 3 THEN 'LOW' ELSE 'OK' END AS quality FROM sized)
SELECT request_id, CASE WHEN NOT bad AND quality = 'LOW' THEN 'top_down' ELSE 'bottom_up' END AS headline_method,
  round(CASE WHEN NOT bad AND quality = 'LOW' THEN tam ELSE bu_tam END, 2) AS tam, 'completed' AS final_status FROM q""")
def report_headline_pipeline(spark, sf):
    df = rep.headline(rep.report(corpus.sizing_requests(spark, sf)), policy="pipeline")
    return df.select("request_id", "headline_method", _r("tam.estimate").alias("tam"), "final_status")


@query("report_sections")
def report_sections(spark, sf):
    return rep.report_sections(rep.report(corpus.sizing_requests(spark, sf)))


@query("calculation_trace", f"""
WITH {REQUESTS}
SELECT request_id, round(CASE WHEN bad THEN bu_tam ELSE tam END, 2) AS tam_value, CASE WHEN bad THEN 20.0 ELSE 25.0 END AS sam_factor,
  CASE WHEN bad THEN 'serviceable_percentage' ELSE 'geography' END AS sam_factor_type FROM sized""")
def calculation_trace(spark, sf):
    t = rep.calculation_trace(rep.report(corpus.sizing_requests(spark, sf)))
    return t.select("request_id", F.round("tam_trace.value", 2).alias("tam_value"), F.col("sam_trace.factor").alias("sam_factor"),
                    F.col("sam_trace.factor_type").alias("sam_factor_type"))


@query("calculation_steps", f"""
WITH {REQUESTS}, chain AS (
  SELECT request_id, 1 AS o, 1.0 AS f, macro FROM sized WHERE NOT bad UNION ALL
  SELECT request_id, 2, 80.0/100.0, macro FROM sized WHERE NOT bad AND nk % 2 = 1 UNION ALL
  SELECT request_id, 3, 50.0/100.0, macro FROM sized WHERE NOT bad AND nk % 2 = 1 UNION ALL
  SELECT request_id, 4, 25.0/100.0, macro FROM sized WHERE NOT bad UNION ALL
  SELECT request_id, 5, segf, macro FROM sized WHERE NOT bad AND nk % 7 <> 0 UNION ALL
  SELECT request_id, 6, 10.0/100.0, macro FROM sized WHERE NOT bad AND nk % 8 <> 0),
steps AS (
  SELECT request_id, 'top_down' AS method, o, macro * product(f) OVER (PARTITION BY request_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS result FROM chain UNION ALL
  SELECT request_id, 'bottom_up', 7, rev FROM sized UNION ALL SELECT request_id, 'bottom_up', 8, bu_tam FROM sized UNION ALL
  SELECT request_id, 'bottom_up', 9, bu_sam FROM sized UNION ALL SELECT request_id, 'bottom_up', 10, bu_som FROM sized WHERE bu_som_status = 'calculated')
SELECT request_id, method, CAST(row_number() OVER (PARTITION BY request_id ORDER BY o) AS INTEGER) AS step_number, round(result, 1) AS result FROM steps""")
def calculation_steps(spark, sf):
    steps = sizing.calculation_steps(sizing.bottom_up(sizing.top_down(corpus.sizing_requests(spark, sf))))
    return steps.select("request_id", "method", "step_number", F.round("result", 1).alias("result"))


@query("running_funnel", """
WITH d AS (SELECT o_custkey, o_orderkey, least(greatest(o_totalprice / 600000.0, 0.05), 1.0) AS share FROM orders)
SELECT o_custkey, o_orderkey, round(product(share) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 8) AS remaining FROM d""")
def running_funnel(spark, sf):
    share = F.least(F.greatest(F.col("o_totalprice") / 600000.0, F.lit(0.05)), F.lit(1.0))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return corpus.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.product(share).over(w), 8).alias("remaining"))


@query("cagr_by_nation", """
WITH y AS (
  SELECT c.c_nationkey AS nk, CAST(year(o.o_orderdate) AS INTEGER) AS yr, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL),
e AS (SELECT nk, min(yr) AS y0, max(yr) AS y1, min_by(v, yr) AS v0, max_by(v, yr) AS v1 FROM y GROUP BY nk)
SELECT n.n_name, y0 AS begin_year, y1 AS end_year,
  CASE WHEN y1 > y0 THEN round(pow(v1 / v0, 1.0 / CAST(y1 - y0 AS DOUBLE)) - 1.0, 4) END AS cagr
FROM e JOIN nation n ON n.n_nationkey = e.nk""")
def cagr_by_nation(spark, sf):
    orders = corpus.table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    cust = corpus.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"))
    nation = corpus.table(spark, sf, "nation").select("n_nationkey", "n_name")
    yearly = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy("nk", "year").agg(F.sum("p").cast("double").alias("v"))
    ends = yearly.groupBy("nk").agg(
        F.min("year").alias("begin_year"), F.max("year").alias("end_year"), F.min_by("v", "year").alias("v0"), F.max_by("v", "year").alias("v1"),
    )
    years = (F.col("end_year") - F.col("begin_year")).cast("double")
    return ends.join(nation, F.col("nk") == F.col("n_nationkey")).select("n_name", "begin_year", "end_year", cagr(F.col("v0"), F.col("v1"), years).alias("cagr"))


@query("freshness", """
WITH a AS (SELECT 2005 - CAST(year(o_orderdate) AS INTEGER) AS age FROM orders)
SELECT CASE WHEN age <= 2 THEN 'RECENT' WHEN age <= 5 THEN 'MODERATELY_OLD' WHEN age <= 10 THEN 'OLD' ELSE 'VERY_OLD' END AS freshness,
  greatest(age, 0) AS age, CAST(count(*) AS BIGINT) AS orders FROM a GROUP BY 1, 2""")
def freshness_of_orders(spark, sf):
    year = F.year("o_orderdate")
    return corpus.table(spark, sf, "orders").groupBy(
        freshness(year, F.lit(2005)).alias("freshness"), freshness_age(year, F.lit(2005)).alias("age")
    ).agg(F.count("*").alias("orders"))


@query("attractiveness", f"""
WITH {REQUESTS}, c AS (SELECT *, CAST(nk % 8 AS BIGINT) AS n FROM sized),
p AS (SELECT *, 60 + CASE WHEN bu_tam >= 5e8 THEN 20 WHEN bu_tam >= 1e8 THEN 10 ELSE 0 END
  + CASE WHEN n <= 2 THEN 10 WHEN n <= 5 THEN 0 ELSE -10 END + 5 AS pts FROM c)
SELECT request_id, n AS n_competitors, least(greatest(pts, 10), 95) / 10.0 AS score,
  CASE WHEN pts >= 75 THEN 'HIGH' WHEN pts >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS rating FROM p""")
def attractiveness(spark, sf):
    df = rep.report(corpus.sizing_requests(spark, sf))
    rivals = df.select("request_id", F.explode(F.sequence(F.lit(0), F.col("nation_key") % 8)).alias("i")).filter("i > 0")
    out = rep.assess_attractiveness(df, rivals)
    return out.select("request_id", "n_competitors", F.col("attractiveness.score").alias("score"), F.col("attractiveness.rating").alias("rating"))
