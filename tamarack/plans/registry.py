"""Registered queries: a Spark function and, where SQL can say the same, an oracle text."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _without_call_sites(fn: Query) -> Query:
    """Build the plan without capturing the Python call site of every column function.

    The capture only serves error messages, and costs more than everything else when a large plan is built.
    """
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        try:
            spark.conf.set("spark.python.sql.dataFrameDebugging.enabled", "false")
        except Exception:  # a fixed setting of this session: building is slower, nothing else changes
            pass
        return fn(spark, sf_dir)

    return run


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with its oracle when there is one."""
    def add(fn: Query) -> Query:
        QUERIES[name] = _without_call_sites(fn)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# Common table expressions of the oracles. They restate the derivations of ``corpus`` in SQL.
SIZES = """
sizes AS (
  SELECT c.c_nationkey AS nk, p.p_type AS pt, CAST(year(o.o_orderdate) AS INTEGER) AS yr,
         CAST(round(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS sz
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey GROUP BY ALL
)"""

CLAIMS = SIZES + """,
cl0 AS (
  SELECT s.s_suppkey AS k, s.s_name, n.n_name, z.nk, z.pt, z.yr,
         CASE WHEN s.s_suppkey % 7 = 0 THEN round(z.sz * 1.1, 0) ELSE z.sz END AS v
  FROM supplier s JOIN sizes z ON s.s_nationkey = z.nk JOIN nation n ON n.n_nationkey = z.nk
),
cl1 AS (
  SELECT *, 'USD ' || CAST(CAST(v / 1e6 AS DECIMAL(18,6)) AS VARCHAR) || ' million' AS raw,
         k || '-' || pt || '-' || yr AS candidate_id,
         (['example.gov','example.edu','reuters.com','medium.com','reddit.com'])[CAST(k % 5 + 1 AS INTEGER)] AS suffix
  FROM cl0
),
cl AS (
  SELECT *, (['Total ','estimated ',''])[CAST(k % 3 + 1 AS INTEGER)] || pt || ' market size' AS metric,
         (['USD','$','dollars'])[CAST(k % 3 + 1 AS INTEGER)] AS unit,
         CASE WHEN k % 11 <> 0 THEN s_name END AS source_name,
         'https://s' || k || '.' || suffix || '/report/' || lower(pt) || '/' || yr AS source_url,
         's' || k || '.' || suffix AS domain,
         CASE WHEN k % 4 = 0 THEN '' ELSE 'According to house ' || k || ', ' END || 'the ' || pt || ' market in ' || n_name
           || ' reached ' || raw || ' in ' || yr || '.' AS context
  FROM cl1
),
-- source quality in hundredths: tier rule, year before 2018, named author, verbatim number
quality AS (
  SELECT *, (['Tier 1: Government & Official Statistics','Tier 2: Academic & Industry Trade Associations',
              'Tier 3: Market Analysts & Financial Press','Tier 4: General Web & Secondary Articles',
              'Tier 5: Unusable (Social/Forums/Unsourced)'])[CAST(k % 5 + 1 AS INTEGER)] AS tier,
    least(greatest(([95,85,65,35,10])[CAST(k % 5 + 1 AS INTEGER)]
      + CASE WHEN yr >= 2023 THEN 3 WHEN yr < 2018 THEN -5 ELSE 1 END
      + CASE WHEN source_name IS NOT NULL THEN 2 ELSE 0 END + 3, 0), CASE WHEN k % 5 = 4 THEN 25 ELSE 100 END) / 100.0 AS q
  FROM cl
),
keys AS (
  SELECT *, lower(pt) || ' market size|market_size|' || lower(n_name) || '|' || yr || '|usd|' AS subject_head,
    CASE WHEN strpos(CAST(CAST(round(v,4) AS DECIMAL(28,4)) AS VARCHAR), '.0000') > 0
         THEN CAST(CAST(v AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(v AS VARCHAR) END AS vkey
  FROM quality
),
keyed AS (
  SELECT *, 'dup_' || substr(md5(subject_head || vkey || '|None|None'), 1, 12) AS group_id,
         'cnf_' || substr(md5('conflict_' || subject_head || CASE WHEN v >= 1e6 THEN 'macro' ELSE 'micro' END), 1, 12) AS subject_id
  FROM keys
)"""

GROUPS = CLAIMS + """,
valid AS (SELECT * FROM keyed WHERE k % 5 <> 4),
grp AS (
  SELECT group_id, subject_id, min_by(candidate_id, (source_url, candidate_id)) AS candidate_id, any_value(v) AS v,
         any_value(n_name) AS n_name, any_value(pt) AS pt, any_value(yr) AS yr, any_value(nk) AS nk,
         min_by(source_url, (source_url, candidate_id)) AS source_url, min_by(tier, (source_url, candidate_id)) AS tier,
         min_by(metric, (source_url, candidate_id)) AS metric, min_by(raw, (source_url, candidate_id)) AS raw,
         min_by(context, (source_url, candidate_id)) AS context, min_by(coalesce(source_name, ''), (source_url, candidate_id)) AS source_name,
         CAST(count(*) AS BIGINT) AS n_claims, CAST(count(DISTINCT source_url) AS BIGINT) AS n_urls,
         CAST(count(DISTINCT domain) AS BIGINT) AS n_domains, max(q) AS max_q, bool_or(k % 5 < 3) AS strong,
         count(context) > count(DISTINCT lower(context)) AS is_syndicated
  FROM valid GROUP BY group_id, subject_id
),
conf AS (
  SELECT subject_id, CAST(count(DISTINCT v) AS BIGINT) AS n_values, min(v) AS min_value, max(v) AS max_value,
         CAST(sum(n_claims) AS BIGINT) AS subject_claims FROM grp GROUP BY subject_id HAVING count(DISTINCT v) > 1
),
tri AS (
  SELECT g.*, c.n_values, c.min_value, c.max_value, c.subject_claims,
         CASE WHEN c.n_values IS NOT NULL THEN 'conflict' ELSE 'valid' END AS validation_status,
         CASE WHEN c.n_values IS NULL AND n_domains >= 2 AND strong THEN 'verified' ELSE 'validated' END AS lifecycle_stage,
         CASE WHEN c.n_values IS NOT NULL THEN CASE WHEN max_q >= 0.70 THEN 'medium' ELSE 'low' END
              WHEN n_domains >= 2 AND strong THEN CASE WHEN max_q >= 0.85 THEN 'very_high' ELSE 'high' END
              WHEN n_domains >= 2 THEN 'medium'
              ELSE CASE WHEN max_q >= 0.70 THEN 'medium' ELSE 'low' END END AS confidence
  FROM grp g LEFT JOIN conf c USING (subject_id)
)"""

REQUESTS = """
per_customer AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spend, count(*) AS n
  FROM orders GROUP BY ALL
),
rq AS (
  SELECT c.c_nationkey AS nk, c.c_mktsegment AS seg, p.yr, CAST(sum(p.spend) AS DOUBLE) AS total,
         CAST(count(*) AS DOUBLE) AS b, CAST(sum(p.n) AS DOUBLE) AS n_orders, any_value(n.n_name) AS n_name,
         c.c_nationkey || '-' || c.c_mktsegment || '-' || p.yr AS request_id
  FROM per_customer p JOIN customer c ON p.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY ALL
),
td0 AS (
  SELECT *, total * CAST(2.71828183 AS DOUBLE) AS macro, CASE WHEN nk % 2 = 0 THEN total * CAST(2.4464536 AS DOUBLE) ELSE total * CAST(2.71828183 AS DOUBLE) END AS macro_lo,
         CASE WHEN nk % 2 = 0 THEN total * CAST(2.9901099 AS DOUBLE) ELSE total * CAST(2.71828183 AS DOUBLE) END AS macro_hi, nk = 23 AS bad FROM rq
),
td1 AS (
  SELECT *, CASE WHEN nk % 2 = 1 THEN macro * (80.0/100.0) * (50.0/100.0) ELSE macro END AS tam,
         CASE WHEN nk % 2 = 1 THEN macro_lo * (80.0/100.0) * (45.0/100.0) ELSE macro_lo END AS tam_lo,
         CASE WHEN nk % 2 = 1 THEN macro_hi * (80.0/100.0) * (55.0/100.0) ELSE macro_hi END AS tam_hi,
         CASE WHEN nk % 7 <> 0 THEN (CAST(nk AS DOUBLE) + 20.0) / 100.0 ELSE 1.0 END AS segf FROM td0
),
td AS (
  SELECT *, tam * (25.0/100.0) * segf AS sam, tam_lo * (25.0/100.0) * segf AS sam_lo, tam_hi * (25.0/100.0) * segf AS sam_hi FROM td1
),
bu0 AS (
  SELECT *, total / b * CAST(1.0000137 AS DOUBLE) AS price,
         CASE WHEN nk % 5 = 4 THEN 12.0 WHEN nk % 3 = 2 THEN 4.0 ELSE 1.0 END AS freq,
         CASE nk % 5 WHEN 1 THEN 3.0 WHEN 2 THEN 4.0 WHEN 3 THEN n_orders / b ELSE 1.0 END AS uses,
         CASE WHEN nk % 2 = 0 THEN b * 0.8 ELSE b END AS b_lo, CASE WHEN nk % 2 = 0 THEN b * 1.2 ELSE b END AS b_hi FROM td
),
bu1 AS (SELECT *, price * freq * uses AS rev FROM bu0),
bu2 AS (
  SELECT *, b * rev AS bu_tam, b_lo * rev AS bu_tam_lo, b_hi * rev AS bu_tam_hi,
         CASE WHEN nk % 9 = 0 THEN ceil(b * 0.4) ELSE b * (20.0/100.0) END AS srv,
         CASE WHEN nk % 9 = 0 THEN ceil(b * 0.4) ELSE b_lo * (20.0/100.0) END AS srv_lo,
         CASE WHEN nk % 9 = 0 THEN ceil(b * 0.4) ELSE b_hi * (20.0/100.0) END AS srv_hi FROM bu1
),
bu AS (SELECT *, least(srv * rev, bu_tam) AS bu_sam, srv_lo * rev AS bu_sam_lo, srv_hi * rev AS bu_sam_hi FROM bu2),
sized AS (
  SELECT *, CASE WHEN bad THEN 'conflict' ELSE 'calculated' END AS td_status,
         CASE WHEN bad THEN 'conflict' WHEN nk % 8 = 0 THEN 'insufficient_evidence' ELSE 'calculated' END AS td_som_status,
         CASE WHEN nk % 8 = 0 THEN 'insufficient_evidence' ELSE 'calculated' END AS bu_som_status,
         CASE WHEN nk % 8 <> 0 AND NOT bad THEN sam * (10.0/100.0) END AS som,
         CASE WHEN nk % 8 <> 0 THEN bu_sam * (10.0/100.0) END AS bu_som FROM bu
)"""

# Constructed documents: what each sentence of ``corpus.sentences`` must yield.
TEXTS = CLAIMS + """,
tx AS (
  SELECT *, (['India','Germany','Japan','Brazil','France','Canada','Australia','Italy','Spain','China'])[CAST(nk % 10 + 1 AS INTEGER)] AS place,
         CAST(CAST(v / 1e6 AS DECIMAL(18,3)) AS VARCHAR) AS n, CAST((k * 137 + yr) % 9000 + 1000 AS VARCHAR) AS cnt,
         CAST(k % 90 + 5 AS VARCHAR) AS pct, CAST(k % 40 + 10 AS DOUBLE) AS lo, CAST(k % 40 + 25 AS DOUBLE) AS hi
  FROM cl
)"""
