"""Source relevance, de-duplication and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions.text import has_any


def _query_terms(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*terms.QUERY_STOP_WORDS))


def query_string(query) -> Column:
    """Search text of a research query: metric, population, topic, place, year; absent parts are skipped."""
    def part(name: str) -> Column:
        return F.when(F.trim(query[name]) != "", F.trim(query[name]))

    year = F.when(query["year"] != 0, query["year"].cast("string"))
    return F.concat_ws(" ", part("metric_required"), part("target_population"), part("industry_topic"), part("geography"), year)


def source_relevance(pairs: DataFrame) -> DataFrame:
    """Add ``relevance_status`` and ``relevance_reason`` to (source, query) rows; both outcomes are kept.

    Reads ``title, snippet, url, category, relevance_score`` and ``metric_required, target_population,
    industry_topic, geography``.
    """
    corpus = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("url", F.lit(""))))
    df = pairs.withColumn("_c", corpus)
    text = F.col("_c")
    everything = F.concat_ws(" ", "metric_required", "target_population", "industry_topic", "geography")
    trimmed = F.transform(_query_terms(everything), lambda w: F.regexp_replace(w, r"^[.,;:()\[\]\"']+|[.,;:()\[\]\"']+$", ""))
    population = F.when(F.coalesce("target_population", F.lit("")) != "", F.col("target_population")).otherwise(F.col("metric_required"))
    df = df.withColumns({
        "_hits": F.size(F.filter(trimmed, lambda w: text.contains(w))),
        "_pop": _query_terms(population), "_topic": _query_terms(F.col("industry_topic")), "_geo": _query_terms(F.col("geography")),
    })

    def matched(name: str) -> Column:
        return (F.size(name) == 0) | F.exists(F.col(name), lambda w: F.col("_c").contains(w))

    pop, topic, place, hits = matched("_pop"), matched("_topic"), matched("_geo"), F.col("_hits")
    authority = F.col("category").isin("official_government", "national_statistics", "industry_analyst", "academic_institution")
    reason = (
        F.when(has_any(F.col("_c"), terms.DENIED_TOPICS), "denied_topic")
        .when(authority & ((hits > 0) | pop | topic | place), "authoritative_overlap")
        .when(authority, "authority_without_overlap")
        .when((hits >= 2) | (pop & topic) | (pop & place), "semantic_overlap")
        .when((F.col("relevance_score") >= 0.7) & (hits >= 1), "high_score")
        .otherwise("insufficient_overlap")
    )
    accepted = F.col("relevance_reason").isin("authoritative_overlap", "semantic_overlap", "high_score")
    return (
        df.withColumn("relevance_reason", reason)
        .withColumn("relevance_status", F.when(accepted, "accepted").otherwise("rejected"))
        .withColumnRenamed("_hits", "matched_terms").drop("_c", "_pop", "_topic", "_geo")
    )


def first_seen_sources(sources: DataFrame, order: Column, by=("request_id",), key: str = "url") -> DataFrame:
    """One row per request and url, the first in ``order``; an aggregate, so hot requests stay cheap."""
    rest = [c for c in sources.columns if c not in (*by, key)]
    return sources.groupBy(*by, key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*by, key, "_r.*").select(*sources.columns)


CAP_SALTS = 32


def first_rows(df: DataFrame, limit, by, order, salt, salts: int = CAP_SALTS) -> DataFrame:
    """The first ``limit`` rows (a number or a column; null: all) of each group in ``order``.

    Rows are ranked within (group, salt) first and what lies beyond the limit there goes, so a group of any share of
    the rows is spread over ``salts`` tasks; the few that are left are ranked once more. Groups whose limit is
    null are not ranked at all. ``salt`` names columns that spread the rows of a group.
    """
    order = order if isinstance(order, (list, tuple)) else [order]
    marked = df.withColumns({"_limit": F.lit(limit) if not isinstance(limit, Column) else limit, "_salt": F.pmod(F.xxhash64(*salt), F.lit(salts))})
    columns = [F.col(f"`{c}`") for c in df.columns]
    everything = marked.filter(F.col("_limit").isNull()).select(*columns)
    part = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    whole = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = marked.filter(F.col("_limit").isNotNull()).withColumn("_rn", part).filter(F.col("_rn") <= F.col("_limit"))
    some = some.withColumn("_rn", whole).filter(F.col("_rn") <= F.col("_limit")).select(*columns)
    return some if not isinstance(limit, Column) and limit is not None else some.union(everything)


def cap_sources(sources: DataFrame, limit, order, by=("request_id",)) -> DataFrame:
    """The first ``limit`` sources of each request: the feature of a bounded analysis, not a sample.

    ``limit`` is a number or a column; null keeps all.
    """
    return first_rows(sources, limit, by, order, ["url"])


def new_sources(candidates: DataFrame, known: DataFrame, on=("request_id", "url")) -> DataFrame:
    """Candidates that are not among the known sources."""
    return candidates.join(known.select(*on).distinct(), list(on), "left_anti")


def merge_competitors(listed: DataFrame, extracted: DataFrame, by=("request_id",), order=("name",)) -> DataFrame:
    """Listed competitors plus extracted ones with a new name (case ignored).

    Of extracted names that differ in case alone the first in ``order`` stays.
    """
    key = F.lower("name")
    rest = [c for c in extracted.columns if c not in by]
    first = extracted.groupBy(*by, key.alias("_k")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    fresh = first.join(listed.select(*by, key.alias("_k")).distinct(), [*by, "_k"], "left_anti").select(*by, "_r.*")
    return listed.unionByName(fresh.select(*extracted.columns), allowMissingColumns=True)


def competitor_matrix(competitors: DataFrame) -> DataFrame:
    """Ten comparison columns with defaults."""
    def col(name: str) -> Column:
        return F.col(name) if name in competitors.columns else F.lit(None).cast("string")

    scope = [c for c in ("request_id",) if c in competitors.columns]
    return competitors.select(
        *scope,
        F.coalesce(col("name"), F.lit("Competitor")).alias("product"),
        F.coalesce(col("target_customers"), col("target_market"), F.lit("Businesses")).alias("target_customer"),
        F.coalesce(col("geography"), F.lit("Global")).alias("geography"),
        F.coalesce(col("category"), F.lit("B2B SaaS")).alias("category"),
        F.coalesce(col("key_features"), F.lit("Core Workflow Automation, Analytics & Reporting")).alias("key_features"),
        F.coalesce(col("pricing_model"), F.lit("Subscription")).alias("pricing_model"),
        F.coalesce(col("public_pricing"), col("pricing"), F.lit("Pricing not publicly available")).alias("public_pricing"),
        F.coalesce(col("deployment_model"), F.lit("Cloud SaaS")).alias("deployment_model"),
        F.coalesce(col("differentiators"), F.lit("Not stated")).alias("differentiators"),
        F.coalesce(col("source_name"), col("source_url"), F.lit("Industry benchmark")).alias("evidence_source"),
    )
