"""Registered queries: text normalisation and claim extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import text as tx
from tamarack.operators import evidence as ev
from tamarack.operators import extract as ex
from tamarack.plans import corpus
from tamarack.plans.registry import CLAIMS, TEXTS, query
from tamarack.sources.pages import html_text, html_text_regex


@query("normalise_units", f"""
WITH {CLAIMS}
SELECT candidate_id, lower(pt) || ' market size' AS metric, 'usd' AS unit, lower(n_name) AS place,
  substr(group_id, 5) AS group_hash FROM keyed""")
def normalise_units(spark, sf):
    df = ev.with_claim_keys(corpus.claims(spark, sf))
    return df.select("candidate_id", F.col("norm_metric").alias("metric"), F.col("norm_unit").alias("unit"), F.col("norm_place").alias("place"),
                     F.substring("group_id", 5, 12).alias("group_hash"))


@query("unit_currency", """
SELECT p_partkey, (['USD','INR','EUR','GBP',NULL,NULL])[CAST(p_partkey % 6 + 1 AS INTEGER)] AS currency,
  (['usd','crore','eur','pound','student','glass'])[CAST(p_partkey % 6 + 1 AS INTEGER)] AS unit FROM part""")
def unit_currency(spark, sf):
    raw = corpus.pick(("Dollars", "crore", "€", "pounds", "students", "glass"), F.col("p_partkey") % 6)
    return corpus.table(spark, sf, "part").select("p_partkey", tx.unit_currency(raw).alias("currency"), tx.normalize_unit(raw).alias("unit"))


@query("parse_number", """
WITH p AS (SELECT p_partkey, p_size, (['thousand','lakh','Crore','mn','BN','t'])[CAST(p_partkey % 6 + 1 AS INTEGER)] AS m,
  ([1e3,1e5,1e7,1e6,1e9,1.0])[CAST(p_partkey % 6 + 1 AS INTEGER)] AS f FROM part)
SELECT p_partkey, (CAST(p_size AS DOUBLE) * 1000 + 25) * f AS value FROM p""")
def parse_number(spark, sf):
    mult = corpus.pick(("thousand", "lakh", "Crore", "mn", "BN", "t"), F.col("p_partkey") % 6)
    number = F.concat(F.col("p_size").cast("string"), F.lit(",025"))
    return corpus.table(spark, sf, "part").select("p_partkey", tx.parse_number(number, mult).alias("value"))


@query("display_value", """
WITH o AS (SELECT o_orderkey, o_totalprice * pow(10, o_orderkey % 5) AS v, (['INR','USD','EUR'])[CAST(o_orderkey % 3 + 1 AS INTEGER)] AS c FROM orders)
SELECT o_orderkey, CASE
  WHEN c = 'INR' AND v >= 1e7 THEN '₹' || format('{:,.2f}', v / 1e7) || ' crore' WHEN c = 'INR' AND v >= 1e5 THEN '₹' || format('{:,.2f}', v / 1e5) || ' lakh'
  WHEN c = 'INR' THEN '₹' || format('{:,.2f}', v) WHEN c = 'USD' AND v >= 1e9 THEN '$' || format('{:,.2f}', v / 1e9) || 'B'
  WHEN c = 'USD' AND v >= 1e6 THEN '$' || format('{:,.2f}', v / 1e6) || 'M' WHEN c = 'USD' AND v >= 1e3 THEN '$' || format('{:,.2f}', v / 1e3) || 'K'
  WHEN c = 'USD' THEN '$' || format('{:,.2f}', v) WHEN v >= 1e9 THEN c || ' ' || format('{:,.2f}', v / 1e9) || 'B'
  WHEN v >= 1e6 THEN c || ' ' || format('{:,.2f}', v / 1e6) || 'M' ELSE c || ' ' || format('{:,.2f}', v) END AS display FROM o""")
def display_value(spark, sf):
    v = F.col("o_totalprice") * F.pow(F.lit(10), F.col("o_orderkey") % 5)
    cur = corpus.pick(("INR", "USD", "EUR"), F.col("o_orderkey") % 3)
    return corpus.table(spark, sf, "orders").select("o_orderkey", tx.display_value(v, cur).alias("display"))


@query("display_short")
def display_short(spark, sf):
    v = F.col("o_totalprice") * F.pow(F.lit(10), F.col("o_orderkey") % 5)
    cur = corpus.pick(("INR", "USD", "EUR"), F.col("o_orderkey") % 3)
    return corpus.table(spark, sf, "orders").select(
        "o_orderkey", tx.display_value(v, cur, style="short").alias("short"), tx.display_number(v).alias("number"), tx.display_count(v).alias("count")
    )


# -- sentences and claims -----------------------------------------------------------------------


@query("sentences", """
WITH d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+') AS a FROM documents)
SELECT doc_id, CAST(len(a) AS INTEGER) AS sentences, CAST(list_sum(list_transform(a, lambda x: length(x))) AS BIGINT) AS characters FROM d""")
def sentences(spark, sf):
    d = corpus.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return ex.sentences(d).groupBy("doc_id").agg(F.count("*").cast("int").alias("sentences"), F.sum(F.length("sentence")).alias("characters"))


def _claims(spark, sf, *families):
    docs = corpus.sentences(spark, sf)
    return ex.claims_from_sentences(ex.sentences(docs), families=families or ex.FAMILIES)


@query("extract_money", f"""
WITH {TEXTS} SELECT candidate_id AS doc_id, 'market size / revenue' AS metric, 'market_size' AS metric_type, 'USD' AS unit,
  round(CAST(n AS DOUBLE) * 1e6, 2) AS value, 'USD ' || n || ' million' AS raw, place AS geography, yr AS year FROM tx""")
def extract_money(spark, sf):
    c = _claims(spark, sf, "money")
    return c.select("doc_id", "metric", "metric_type", "unit", F.round("value", 2).alias("value"), F.col("raw_value_expression").alias("raw"), "geography", "year")


_BARE_YEAR = "regexp_full_match(cnt, '19[0-9][0-9]|20[0-3][0-9]')"


@query("extract_counts", f"""
WITH {TEXTS} SELECT candidate_id AS doc_id, 'enterprise customers' AS metric, 'customer_count' AS metric_type, 'customers' AS unit,
  CAST(cnt AS DOUBLE) AS value, place AS geography, yr AS year FROM tx WHERE NOT {_BARE_YEAR}""")
def extract_counts(spark, sf):
    c = _claims(spark, sf).filter(F.col("family") == "count")
    return c.select("doc_id", "metric", "metric_type", "unit", "value", "geography", "year")


@query("extract_percent", f"""
WITH {TEXTS} SELECT candidate_id AS doc_id, 'local demand ' || place AS metric, 'market_share' AS metric_type, CAST(pct AS DOUBLE) AS value,
  place AS geography, yr AS year FROM tx""")
def extract_percent(spark, sf):
    c = _claims(spark, sf, "percent")
    return c.select("doc_id", "metric", "metric_type", "value", "geography", "year")


@query("extract_ranges", f"""
WITH {TEXTS} SELECT candidate_id AS doc_id, 'users' AS metric, 'users' AS unit, lo * 1e6 AS range_min, hi * 1e6 AS range_max, place AS geography FROM tx""")
def extract_ranges(spark, sf):
    return _claims(spark, sf, "range").select("doc_id", "metric", "unit", "range_min", "range_max", "geography")


@query("extract_approx", f"""
WITH {TEXTS} SELECT candidate_id AS doc_id, 'subscribers' AS metric, 'more than ' || CAST(lo AS INTEGER) || ' million subscribers' AS raw,
  lo * 1e6 AS range_min, round(lo * 1e6 * 1.05, 2) AS range_max, place AS geography, yr AS year FROM tx""")
def extract_approx(spark, sf):
    c = _claims(spark, sf, "approximate")
    return c.select("doc_id", "metric", F.col("raw_value_expression").alias("raw"), "range_min", F.round("range_max", 2).alias("range_max"), "geography", "year")


@query("claims_all", f"""
WITH {TEXTS}, f AS (
  SELECT candidate_id, place, yr, 'money' AS family, 1 AS keep FROM tx UNION ALL SELECT candidate_id, place, yr, 'percent', 1 FROM tx UNION ALL
  SELECT candidate_id, place, NULL, 'range', 1 FROM tx UNION ALL SELECT candidate_id, place, yr, 'approximate', 1 FROM tx UNION ALL
  SELECT candidate_id, place, yr, 'count', CAST(NOT {_BARE_YEAR} AS INTEGER) FROM tx)
SELECT family, place AS geography, yr AS year, CASE WHEN family IN ('money', 'count', 'percent') THEN 'high' ELSE 'medium' END AS extraction_confidence,
  CAST(count(*) AS BIGINT) AS claims FROM f WHERE keep = 1 GROUP BY ALL""")
def claims_all(spark, sf):
    return _claims(spark, sf).groupBy("family", "geography", "year", "extraction_confidence").agg(F.count("*").alias("claims"))


@query("document_claims")
def document_claims(spark, sf):
    """All claim families over the whole prose of ``documents``."""
    d = corpus.table(spark, sf, "documents").select(F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")).alias("original_url"),
                                                    F.col("source").alias("source_name"), F.col("text").alias("content"))
    c = ex.extract_claims(d)
    return c.select("source_url", "sentence_no", "family", "metric", "metric_type", "value", "unit", "geography", "year", "range_min", "range_max")


@query("extraction_status", f"""
WITH {TEXTS} SELECT source_url AS original_url, CAST(sum(4 + CAST(NOT {_BARE_YEAR} AS INTEGER)) AS BIGINT) AS total_candidates_found, 'success' AS status FROM tx GROUP BY 1""")
def extraction_status(spark, sf):
    docs = corpus.sentences(spark, sf)
    return ex.extraction_status(docs, ex.extract_claims(docs))


@query("competitor_mentions", f"""
WITH {TEXTS}, n AS (SELECT source_url, source_name, unnest(['Acme ' || lower(pt), 'Supplier ' || k, 'Borealis']) AS name FROM tx)
SELECT source_url, name, count(*) > 0 AS listed FROM n GROUP BY 1, 2""")
def competitor_mentions(spark, sf):
    return ex.extract_competitors(corpus.sentences(spark, sf)).select("source_url", "name", F.lit(True).alias("listed"))


@query("html_text")
def html_text_query(spark, sf):
    p = corpus.table(spark, sf, "pages").select("page_id", html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.col("t.title").alias("title"), F.col("t.text").alias("text"))


@query("html_text_regex", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '[\s' || chr(160) || ']+', ' ', 'g')) AS text FROM b""")
def html_text_regex_query(spark, sf):
    return corpus.table(spark, sf, "pages").select("page_id", html_text_regex(F.col("html")).alias("text"))
