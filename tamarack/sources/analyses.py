"""Stored analyses: an append-only Parquet log of versions, or the current state in buckets of ids.

Saving appends rows, which Spark's file commit makes all-or-nothing; nothing is rewritten, so a lost
executor or a failed job leaves the former state. Reading takes the latest version per id but keeps the
first ``business_idea`` and ``created_at``. A deletion is a row too. ``compact`` writes the current
state to a new place. :class:`AnalysisBuckets` keeps no versions: an upsert rewrites the buckets that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT = ("business_idea", "created_at")


def latest_versions(log: DataFrame, key: str = "analysis_id", version: str = "version", deleted: str = "is_deleted") -> DataFrame:
    """Current rows of a version log.

    ``business_idea`` and ``created_at`` come from the first version since the last deletion.
    """
    rest = [c for c in log.columns if c not in (key, version, deleted, *_KEPT)]
    fence = log.groupBy(key).agg(F.max(F.when(F.col(deleted), F.col(version))).alias("_fence"))
    alive = log.join(fence, key).filter(~F.col(deleted) & (F.col("_fence").isNull() | (F.col(version) > F.col("_fence"))))
    kept = [c for c in _KEPT if c in log.columns]
    rows = alive.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(version)).alias("_last"),
        *([F.min_by(F.struct(*kept), F.col(version)).alias("_first")] if kept else []),
    )
    return rows.select(key, *[F.col(f"_first.{c}").alias(c) for c in kept], "_last.*")


def merge_analyses(existing: DataFrame, incoming: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Upsert as one full outer join: incoming values win, except ``business_idea`` and ``created_at``."""
    old, new = existing.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    present = F.col(f"n.{key}").isNotNull()
    cols = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    for c in existing.columns:
        if c == key:
            continue
        if c in _KEPT:
            known = F.col(f"o.{key}").isNotNull()
            cols.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(present, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*cols)


def history_page(analyses: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest analyses first; the limit is clamped to 1..200. Plans as a top-k, not a full sort."""
    return analyses.orderBy(F.desc("created_at"), "analysis_id").offset(max(0, offset)).limit(max(1, min(limit, 200)))


def history_after(analyses: DataFrame, limit: int = 50, after: tuple[str, str] | None = None) -> DataFrame:
    """The next newest analyses behind the last row (created_at, analysis_id) of a page; the first page without it.

    The rows are those of :func:`history_page`, but a later page sorts nothing that earlier ones had, and the bound on
    ``created_at`` reaches the Parquet scan, where a layout by time (:meth:`AnalysisLog.compact`) skips what is newer.
    """
    if after is not None:
        at, key = after
        analyses = analyses.filter((F.col("created_at") <= at) & ((F.col("created_at") < at) | (F.col("analysis_id") > key)))
    return history_page(analyses, limit)


class AnalysisLog:
    """The version log at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, analyses: DataFrame, version: int) -> None:
        """Append analyses (one row per id) under a version number that grows with every save."""
        self._append(analyses.withColumn("is_deleted", F.lit(False)), version)

    def delete(self, ids: DataFrame, version: int) -> None:
        """Mark the ids of a one-column table as deleted."""
        log = self.log()
        gone = ids.select("analysis_id").distinct()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields if f.name not in ("analysis_id", "version", "is_deleted")]
        self._append(gone.select("analysis_id", *empty, F.lit(True).alias("is_deleted")), version)

    def clear(self, version: int) -> None:
        self.delete(self.current(), version)

    def log(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def current(self) -> DataFrame:
        return latest_versions(self.log())

    def get(self, analysis_id: str) -> DataFrame:
        """One analysis; the id filter reaches the Parquet scan."""
        return latest_versions(self.log().filter(F.col("analysis_id") == analysis_id))

    def count(self) -> int:
        return self.current().count()

    def history(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return history_page(self.current(), limit, offset)

    def compact(self, new_path: str) -> AnalysisLog:
        """Current state as a fresh log elsewhere, in files and row groups by time."""
        rows = self.current().withColumn("is_deleted", F.lit(False)).withColumn("version", F.lit(0).cast("bigint"))
        rows.repartitionByRange("created_at", "analysis_id").sortWithinPartitions("created_at", "analysis_id").write.parquet(new_path)
        return AnalysisLog(self.spark, new_path)

    def _append(self, rows: DataFrame, version: int) -> None:
        rows.withColumn("version", F.lit(version).cast("bigint")).write.mode("append").parquet(self.path)


class AnalysisBuckets:
    """Current analyses at a path, one row per id, in ``buckets`` partitions by a hash of the id.

    A batch reads and rewrites only the buckets of its own ids, by dynamic partition overwrite: files of other buckets
    stay as they are, and lost executors leave the former state, as new files are moved in after the last task. A
    deleted id stays as a mark, so that a bucket whose last analysis goes is rewritten like any other. The number of
    buckets belongs to the store; a bucket may be written as several files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def create(self, analyses: DataFrame) -> AnalysisBuckets:
        """Write a new store with ``analyses`` (analysis_id and any other columns, one row per id); fails on an existing one."""
        self._write(analyses.withColumn("is_deleted", F.lit(False)), "error")
        return self

    def upsert(self, incoming: DataFrame) -> None:
        """Merge analyses (one row per id, the store's columns) as :func:`merge_analyses` does; a deleted id starts anew."""
        old = self._touched(incoming)
        alive = old.filter(~F.col("is_deleted")).drop("is_deleted")
        marks = old.filter("is_deleted").join(incoming.select("analysis_id"), "analysis_id", "left_anti")
        merged = merge_analyses(alive, incoming.select(alive.columns)).withColumn("is_deleted", F.lit(False))
        self._write(merged.unionByName(marks), "overwrite")

    def delete(self, ids: DataFrame) -> None:
        """Mark the ids of a table with ``analysis_id`` as deleted; unknown ids change nothing."""
        gone = ids.select("analysis_id").filter("analysis_id IS NOT NULL").distinct().withColumn("_gone", F.lit(True))
        marked = self._touched(ids).join(gone, "analysis_id", "left")
        columns = [c for c in marked.columns if c not in ("analysis_id", "is_deleted", "_gone")]
        kept = [F.when(F.col("_gone").isNull(), F.col(f"`{c}`")).alias(c) for c in columns]  # a mark keeps the id alone
        self._write(marked.select("analysis_id", *kept, (F.col("is_deleted") | F.col("_gone").isNotNull()).alias("is_deleted")), "overwrite")

    def current(self) -> DataFrame:
        return self._stored().filter(~F.col("is_deleted")).drop("bucket", "is_deleted")

    def get(self, analysis_id: str) -> DataFrame:
        """One analysis: only files of its bucket are read."""
        key = F.lit(analysis_id).cast(self._stored().schema["analysis_id"].dataType)
        one = self._stored().filter((F.col("bucket") == self._bucket(key)) & (F.col("analysis_id") == key) & ~F.col("is_deleted"))
        return one.drop("bucket", "is_deleted")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _touched(self, ids: DataFrame) -> DataFrame:
        """Rows of the buckets that hold these ids."""
        stored = self._stored()
        key = F.col("analysis_id").cast(stored.schema["analysis_id"].dataType)
        buckets = ids.filter("analysis_id IS NOT NULL").select(self._bucket(key).alias("b")).distinct()
        touched = [r.b for r in buckets.collect()]  # as many numbers as there are buckets at most
        return stored.filter(F.col("bucket").isin(touched)).drop("bucket")

    def _write(self, rows: DataFrame, mode: str) -> None:
        placed = rows.filter("analysis_id IS NOT NULL").withColumn("bucket", self._bucket(F.col("analysis_id")))
        writer = placed.hint("rebalance", "bucket").write.option("partitionOverwriteMode", "dynamic")
        writer.mode(mode).partitionBy("bucket").parquet(self.path)
