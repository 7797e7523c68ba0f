"""Source catalogues and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.source_rules import authority_score, source_category, source_tier
from tamarack.functions.text import domain_of, is_http_url
from tamarack.operators.discovery import first_rows, query_string

_RESULT_KEYS = ("results", "organic_results", "items", "data", "webPages")


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A source catalogue from files; JSON and CSV need the schema."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def search_catalog(queries: DataFrame, catalog: DataFrame, on=("request_id",)) -> DataFrame:
    """Catalogue rows per query, at most ``max_results`` of each query in catalogue order (``ord``)."""
    text = query_string({c: F.col(c) for c in ("metric_required", "target_population", "industry_topic", "geography", "year")})
    asked = queries.select(*on, "query_no", "max_results", text.alias("query_used"))
    joined = asked.join(catalog, list(on))
    return first_rows(joined, F.col("max_results"), [*on, "query_no"], ["ord", "url"], ["ord", "url"]).drop("max_results")


PAYLOAD_SCHEMA = "request_id string, query_used string, max_results int, payload string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Saved search API responses, one JSON object a line, as :func:`parse_search_results` takes them.

    ``payload`` may be an object, a list or a text that holds one. Files are split at lines, and a filter on the columns
    (``request_id``) is applied by the reader before a line's other fields are parsed. Lines that are no JSON
    object or name no request are left out; without a limit 5 results stay.
    """
    lines = spark.read.schema(PAYLOAD_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return lines.filter(F.col("request_id").isNotNull()).fillna({"max_results": 5})


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Save responses (request_id, query_used, max_results, payload) for :func:`read_payloads`; adds to what the folder has."""
    payloads.select("request_id", "query_used", F.col("max_results").cast("int").alias("max_results"), "payload").write.mode("append").json(path)


def parse_search_results(payloads: DataFrame) -> DataFrame:
    """Search API payloads (JSON text) to source rows.

    Accepts a bare list or the usual result keys and field names. Rows without an http(s) address are
    dropped, the score is clamped to 0..1 or taken from the domain, the first ``max_results`` valid rows
    stay. ``payloads``: ``request_id, query_used, payload, max_results``. The cut happens inside the row.
    """
    body = F.trim("payload")
    arrays = [F.when(body.startswith("["), body)]
    for key in _RESULT_KEYS:
        for path in (f"$.{key}", f"$.{key}.value"):
            part = F.get_json_object("payload", path)
            arrays.append(F.when(part.startswith("["), part))
    # element by element: one that is no object goes alone
    elements = F.filter(F.from_json(F.coalesce(*arrays), "array<string>"), lambda e: F.ltrim(e).startswith("{"))
    records = F.transform(elements, lambda e: F.from_json(e, "map<string,string>"))

    def pick(r: Column, *names: str) -> Column:
        return F.coalesce(*[F.when(F.trim(r[n]) != "", F.trim(r[n])) for n in names])

    def score(r: Column) -> Column:
        numbers = [r[n].try_cast("double") for n in ("score", "relevance", "relevance_score")]
        stated = F.coalesce(*[F.when(n != 0, n) for n in numbers])
        return F.when(stated.isNotNull(), F.least(F.greatest(stated, F.lit(0.0)), F.lit(1.0)))

    rows = F.transform(F.filter(records, lambda r: r.isNotNull()), lambda r: F.struct(
        pick(r, "url", "link", "formattedUrl").alias("url"), pick(r, "title", "name", "heading").alias("title"),
        pick(r, "content", "snippet", "description", "body").alias("snippet"),
        pick(r, "source", "source_name", "publisher").alias("source_name"),
        pick(r, "published_date", "publishedDate", "date").alias("publication_date"), score(r).alias("score"),
    ))
    valid = F.filter(rows, lambda r: is_http_url(r["url"]))
    first = F.slice(valid, F.lit(1), F.col("max_results"))
    df = payloads.select("request_id", "query_used", F.posexplode(first).alias("ord", "r")).select("request_id", "query_used", "ord", "r.*")
    df = df.withColumn("domain", domain_of(F.col("url")))
    df = df.withColumn("category", source_category(F.col("domain")))
    return df.withColumns({
        "title": F.coalesce("title", F.concat(F.lit("Document at "), F.col("domain"))),
        "source_name": F.coalesce("source_name", "domain"),
        "source_quality_tier": source_tier(F.col("category"), F.col("domain"), F.lit("")),
        "relevance_score": F.coalesce("score", authority_score(F.col("domain"), F.col("category"))),
        "lifecycle_stage": F.lit("discovered"),
    }).drop("score")


def attach_documents(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of discovered sources; a failed or empty fetch falls back to the search snippet.

    A popular url belongs to many requests: the document side is joined by url once, and adaptive
    execution splits a skewed url.
    """
    docs = documents.select(
        F.col("original_url").alias("url"), "final_url", F.col("title").alias("_title"), "content", "content_type", "http_status",
        "fetch_status", F.col("source_name").alias("_name"),
    )
    df = sources.join(docs, "url", "left")
    failed = (
        F.col("fetch_status").isNull() | (F.col("fetch_status") != "success") | (F.trim(F.coalesce("content", F.lit(""))) == "")
        | F.coalesce(F.col("http_status") >= 400, F.lit(False))
    )
    fall_back = failed & (F.trim(F.coalesce("snippet", F.lit(""))) != "")
    rest = [c for c in sources.columns if c not in ("url", "title", "source_name")]
    return df.select(
        F.col("url").alias("original_url"), F.coalesce("final_url", "url").alias("final_url"),
        F.when(fall_back, F.col("title")).otherwise(F.coalesce("_title", "title")).alias("title"),
        F.when(fall_back, F.col("source_name")).otherwise(F.coalesce("_name", "source_name")).alias("source_name"),
        F.when(fall_back, F.trim("snippet")).otherwise(F.col("content")).alias("content"),
        F.when(fall_back, "text/plain").otherwise(F.col("content_type")).alias("content_type"), "http_status",
        F.when(fall_back, "snippet_fallback").otherwise(F.coalesce("fetch_status", F.lit("fetch_failed"))).alias("fetch_status"),
        *rest,
    )
