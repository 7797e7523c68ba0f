"""Triangulation that grows with new claims: mergeable facts, a store of batches, statuses of what a batch touches.

A *fact* is all that claims of one group, url, domain and context text have in common, with their number: facts of two
batches merge by adding up, so a batch is grouped once and never again. The store appends the facts of each batch below
buckets of subjects. A new batch reads back the facts of its own subjects alone and decides their groups anew; other
subjects keep their statuses. Everything is counted exactly, and gives what :func:`triangulate` gives over all claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import terms
from tamarack.functions import text as tx
from tamarack.operators import evidence as ev

_KEYS = ("group_key", "subject_key", "group_id", "subject_id")
_GRAIN = ("source_url", "domain", "context_key")
# What tells one status of a group from another.
STATUS = ("validation_status", "lifecycle_stage", "confidence", "corroborating_source_count", "conflicting_source_count")


def _scope(df: DataFrame) -> list[str]:
    return [c for c in ("request_id",) if c in df.columns]


def _order(first: str = "") -> Column:
    return F.struct(f"{first}source_url", f"{first}candidate_id")


def claim_facts(checked: DataFrame) -> DataFrame:
    """Facts of validated claims (:func:`tamarack.operators.evidence.validate_claims`); rejected ones are left out.

    One row per group, url, domain and digest of the context (null for short ones): ``n_claims``, ``max_quality_score``,
    ``has_authority`` and ``first``, the claim that leads them.
    """
    df = ev.with_claim_keys(checked.filter("is_valid"))
    if "domain" not in df.columns:
        df = df.withColumn("domain", tx.domain_of(F.col("source_url")))
    context = F.regexp_replace(tx.low(F.col("source_context")), r"\s+", " ")
    df = df.withColumn("context_key", F.when(F.length(context) > 30, F.sha2(context, 256)))
    carried = [c for c in (*ev._CANONICAL, *ev.KEPT) if c in df.columns]
    strong = F.col("source_quality_tier").isin(terms.TIER_1, terms.TIER_2, terms.TIER_3)
    return df.groupBy(*_scope(df), *_KEYS, *_GRAIN).agg(
        F.min_by(F.struct(*carried), _order()).alias("first"), F.count(F.lit(1)).alias("n_claims"),
        F.max("source_quality_score").alias("max_quality_score"), F.bool_or(strong).alias("has_authority"))


def merge_facts(*parts: DataFrame) -> DataFrame:
    """The facts of several batches as those of one."""
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p)
    return facts.groupBy(*_scope(facts), *_KEYS, *_GRAIN).agg(
        F.min_by("first", _order("first.")).alias("first"), F.sum("n_claims").alias("n_claims"),
        F.max("max_quality_score").alias("max_quality_score"), F.bool_or("has_authority").alias("has_authority"))


def groups_of_facts(facts: DataFrame) -> DataFrame:
    """Rows as :func:`tamarack.operators.evidence.duplicate_groups` gives them. ``facts`` may hold one fact several times."""
    scope = _scope(facts)
    with_context = F.when(F.col("context_key").isNotNull(), F.col("n_claims"))
    grouped = facts.groupBy(*scope, *_KEYS).agg(
        F.min_by("first", _order("first.")).alias("first"), F.sum("n_claims").alias("n_claims"),
        F.countDistinct("source_url").alias("n_urls"), F.countDistinct("domain").alias("n_domains"),
        (F.coalesce(F.sum(with_context), F.lit(0)) > F.countDistinct("context_key")).alias("is_syndicated"),
        F.max("max_quality_score").alias("max_quality_score"), F.bool_or("has_authority").alias("has_authority"))
    return grouped.select(*scope, *_KEYS, "first.*", *[c for c in grouped.columns if c not in (*scope, *_KEYS, "first")])


def triangulate_facts(facts: DataFrame) -> DataFrame:
    """Statuses of all groups of ``facts``, as :func:`tamarack.operators.evidence.triangulate` gives them."""
    return ev.statuses(groups_of_facts(facts))


# -- store --------------------------------------------------------------------------------------


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("subject_key"), F.lit(buckets)).cast("int")


def append_facts(facts: DataFrame, path: str, batch: int, buckets: int = 64) -> None:
    """Write the facts of one batch. Writing a batch again, as after a failure, replaces it."""
    facts.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def stored_facts(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    """All facts of the store with ``batch`` and ``bucket``, or those of the batches up to one."""
    facts = spark.read.parquet(path)
    return facts if up_to is None else facts.filter(F.col("batch") <= up_to)


def facts_of_subjects(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """All facts, up to ``batch``, of the subjects that this batch states. Buckets without any of them are not read."""
    stored = stored_facts(spark, path, batch)
    keys = [*_scope(stored), "subject_key"]
    touched = stored.filter(F.col("batch") == batch)
    buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # as many as the store has at most
    return stored.filter(F.col("bucket").isin(buckets)).join(touched.select(*keys).distinct(), keys, "left_semi")


def compact_facts(spark: SparkSession, path: str, target: str, up_to: int, buckets: int = 64) -> None:
    """Write the merged facts of the batches up to one as batch ``up_to`` of another store, which goes on from there."""
    append_facts(merge_facts(stored_facts(spark, path, up_to).drop("batch", "bucket")), target, up_to, buckets)


# -- running statuses ---------------------------------------------------------------------------


def latest_statuses(changes: DataFrame) -> DataFrame:
    """The last status of every group from rows with ``batch``."""
    keys = [*_scope(changes), "group_key"]
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return last.select(*keys, "s.*")


def status_changes(spark: SparkSession, checked: DataFrame, facts_path: str, changes_path: str, batch: int, buckets: int = 64) -> DataFrame:
    """Take in one batch of validated claims; the groups whose status it changes, also written below ``changes_path``.

    A row is a group that is new, or whose status, stage, confidence or counts differ from its last row; ``batch``
    numbers the change. Groups of other subjects are not looked at. Batches come in rising order; one that is taken in again
    replaces its own facts and changes.
    """
    append_facts(claim_facts(checked), facts_path, batch, buckets)
    now = triangulate_facts(facts_of_subjects(spark, facts_path, batch))
    keys = [*_scope(now), "group_key"]
    if batch_exists(spark, changes_path):
        before = spark.read.parquet(changes_path).filter(F.col("batch") < batch)
        # only rows of the subjects that this batch states
        before = latest_statuses(before.join(now.select(*_scope(now), "subject_key").distinct(), [*_scope(now), "subject_key"], "left_semi"))
        now = now.join(before.select(*keys, F.struct(*STATUS).alias("_before")), keys, "left").filter(
            ~F.struct(*STATUS).eqNullSafe(F.col("_before"))).drop("_before")
    now.write.mode("overwrite").parquet(f"{changes_path}/batch={batch}")
    return spark.read.parquet(changes_path).filter(F.col("batch") == batch)


def batch_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written below a path that Spark can read."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
