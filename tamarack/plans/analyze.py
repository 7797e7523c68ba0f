"""The whole analysis over tables: sources, documents, claims, triangulation, operands, report."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators import discovery, evidence, extract, operands, requests as req
from tamarack.plans import report as rep
from tamarack.sources import catalog


class Analysis(NamedTuple):
    """Lazy tables of one analysis run; take what you need, or write the shared ones first."""

    requests: DataFrame
    sources: DataFrame
    documents: DataFrame
    claims: DataFrame
    checked: DataFrame
    triangulated: DataFrame
    operands: DataFrame
    reports: DataFrame
    competitors: DataFrame


def business_columns(requests: DataFrame) -> DataFrame:
    """The request columns that claim checks and operand roles read, under their target names."""
    return requests.select(
        "request_id", "business_idea", F.coalesce("target_country", "preferred_geography").alias("target_geography"),
        F.coalesce("preferred_year", F.lit(2025)).alias("target_year"), F.col("preferred_year"),
        F.col("product").alias("target_product"), F.col("industry").alias("target_industry"),
        F.coalesce("target_customer_segment", "customer_type").alias("target_customer"), F.col("customer_type").alias("target_customer_type"),
    )


# Tasks per core that texts are dealt to: a task that holds more claims than others delays the end by little.
TASKS_PER_CORE = 4


def spread(documents: DataFrame) -> DataFrame:
    """Documents dealt to a number of tasks that follows the cores and not the bytes.

    Texts are few bytes and much work. After the joins before it, adaptive execution gathers them by bytes, down to one task that
    extracts all of them. A fixed number is left as it is. Sources are distinct by request and url, so no task gets many.
    """
    spark = documents.sparkSession
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return documents.repartition(tasks, "request_id", "original_url")


def analyze(requests: DataFrame, source_table: DataFrame, document_table: DataFrame, gate: str = "ranked", policy: str = "orchestrator",
            store: Callable[[DataFrame, str], DataFrame] | None = None) -> Analysis:
    """Build the analysis of every request.

    ``source_table`` has one row per discovered source with ``request_id, ord`` and the source columns;
    ``document_table`` the fetched documents by url. ``gate`` chooses operands by ``ranked`` scores or by
    ``first_match``. Shuffles: sources by url, texts by request and url, claims by claim key and by subject, operands by request.
    Requests and claim groups are read several times; with ``store`` (such as :func:`tamarack.sources.shared.written_once`)
    they are written first, so that texts are extracted once for the reports.
    """
    store = store or (lambda df, name: df)
    wanted = store(req.derive_business(req.clean_requests(requests)), "requests")
    business = business_columns(wanted)
    queries = req.unified_query(wanted)
    paired = source_table.join(queries.drop("query_no", "year"), "request_id")
    judged = discovery.source_relevance(paired)
    relevant = judged.filter(F.col("relevance_status") == "accepted").select(*source_table.columns, "max_results")
    first = discovery.first_seen_sources(relevant, F.col("ord"))
    sources = discovery.cap_sources(first, F.col("max_results") * 3, F.col("ord")).drop("max_results")
    documents = catalog.attach_documents(sources, document_table)
    claims = extract.extract_claims(spread(documents))
    checked = evidence.validate_claims(claims.join(business, "request_id"))
    tri = evidence.statuses(store(evidence.claim_groups(checked), "claim-groups"))
    if gate == "ranked":
        best = operands.best_operands(operands.operand_candidates(tri.join(business.drop("preferred_year"), "request_id")))
        asked = wanted.select("request_id", "assumptions", "pricing_basis").join(
            business.select("request_id", "business_idea", "target_geography", "target_year"), "request_id"
        )
        sized = operands.sizing_requests(asked, best)
    else:
        best = req.first_match_inputs(tri)
        sized = req.first_match_requests(wanted, best)
    reports = rep.headline(rep.report(sized), policy)
    return Analysis(wanted, sources, documents, claims, checked, tri, best, reports, extract.extract_competitors(documents))
