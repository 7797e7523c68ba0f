"""Structured Streaming: run progress and transitions, document feeds, running corroboration and statuses."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.text import domain_of
from tamarack.operators.evidence import with_claim_keys
from tamarack.operators.extract import extract_claims
from tamarack.operators.incremental import status_changes


def read_feed(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A file feed with a declared schema; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def run_progress(events: DataFrame) -> DataFrame:
    """Latest stage, percent and status per run. Batch, or streaming in update mode."""
    latest = F.max_by(F.struct("stage", "status", "progress_percent", "message"), F.struct("ts", "progress_percent"))
    return events.groupBy("pipeline_id").agg(latest.alias("l"), F.max("ts").alias("updated_at"), F.count("*").alias("n_events")).select(
        "pipeline_id", "l.*", "updated_at", "n_events"
    )


def stage_durations(events: DataFrame, run: str = "pipeline_id") -> DataFrame:
    """State transitions of finished runs with the time spent in the former state (batch)."""
    w = Window.partitionBy(run).orderBy("ts", "progress_percent")
    micros = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    return events.select(
        run, F.lag("stage").over(w).alias("from_stage"), F.col("stage").alias("to_stage"), (micros / 1000.0).alias("duration_ms"), "status", "ts",
    )


def first_failures(events: DataFrame, run: str = "pipeline_id") -> DataFrame:
    """First failing stage per run."""
    failed = events.filter(F.col("status") == "failed")
    return failed.groupBy(run).agg(F.min_by("stage", "ts").alias("failed_stage"), F.min("ts").alias("failed_at"))


def stream_claims(documents: DataFrame, event_time: str = "fetched_at", delay: str = "1 day") -> DataFrame:
    """Claims of a document feed; a document seen again within the delay is skipped.

    Extraction keeps no state, so the only state is one url and digest per document for the length of the delay.
    """
    keyed = documents.withColumn("_doc", F.sha2("content", 256)).withWatermark(event_time, delay)
    fresh = keyed.dropDuplicatesWithinWatermark(["original_url", "_doc"]).drop("_doc")
    return extract_claims(fresh, carry=(event_time,))


def stream_corroboration(claims: DataFrame, event_time: str = "fetched_at", delay: str = "1 day", window: str = "7 days") -> DataFrame:
    """Exact number of domains and claims per distinct claim and window, once the watermark has passed it (append mode).

    Claims are counted per domain first and domains per claim then, so the state is one row per window, claim and
    domain, and it goes with the window. The same code over a batch gives the same rows.
    """
    keyed = with_claim_keys(claims.withWatermark(event_time, delay)).withColumn("_d", domain_of(F.col("source_url")))
    by_domain = keyed.groupBy(F.window(event_time, window), "group_key", "group_id", "_d").agg(F.count("*").alias("_n"))
    return by_domain.groupBy("window", "group_key", "group_id").agg(F.count("_d").alias("n_domains"), F.sum("_n").alias("n_claims"))


def stream_statuses(checked: DataFrame, facts_path: str, changes_path: str, checkpoint: str, buckets: int = 64):
    """Running triangulation of a stream of validated claims: status changes of claim groups, batch after batch.

    Returns the (unstarted) stream writer. Each micro-batch is reduced to facts by ordinary aggregation, so that a subject with a
    third of all claims loads no single task, and merges with the stored facts of its own subjects. A micro-batch that
    Spark runs again replaces what its first attempt wrote.
    """
    def take_in(batch: DataFrame, number: int) -> None:
        status_changes(batch.sparkSession, batch, facts_path, changes_path, number, buckets)

    return checked.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(take_in)


# -- transitions --------------------------------------------------------------------------------

TRANSITIONS_DDL = "from_stage string, to_stage string, duration_ms double, status string, ts timestamp, first_failure boolean"
_EVENT = ("ts", "progress_percent", "stage", "status")


def run_transitions(events: DataFrame, run: str = "pipeline_id") -> DataFrame:
    """Every transition of every run with the time spent in the former state, and whether it is the run's first failure (batch).

    Events that repeat run, time, percent, stage and status count once. Events of one run are ordered by these.
    """
    once = events.filter(F.col(run).isNotNull() & F.col("ts").isNotNull()).select(run, *_EVENT).distinct()
    w = Window.partitionBy(run).orderBy(*_EVENT)
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    earlier = F.coalesce(F.max(failed).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return once.select(
        run, F.lag("stage").over(w).alias("from_stage"), F.col("stage").alias("to_stage"),
        (F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / 1000.0).alias("duration_ms"), "status", "ts",
        (failed & ~earlier).alias("first_failure"))


def stream_transitions(events: DataFrame, delay: str = "10 minutes", idle: str = "1 day", run: str = "pipeline_id") -> DataFrame:
    """The rows of :func:`run_transitions` from a stream, each once the watermark has passed its event (append mode).

    The state of a run is its last stage and the events that the watermark has not passed, which are put in order; a timer at
    the first of them wakes the run without new data. Events later than the watermark are left out, as in every watermarked
    operator, so repeats of events already passed do no harm. ``idle`` after its last event a run is forgotten.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    keep_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def advance(key, parts, state):
        stage, since, failed, done, waiting = state.get if state.exists else (None, None, False, 0, "[]")
        pending = {tuple(e) for e in json.loads(waiting)}
        for part in parts:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            rows = part.astype(object).where(part.notna(), None)
            for at, percent, to_stage, status in zip(micros, rows["progress_percent"], rows["stage"], rows["status"], strict=True):
                if at >= done * 1000:
                    pending.add((int(at), None if percent is None else int(percent), to_stage, status))
        passed = max(done, state.getCurrentWatermarkMs())
        ready = sorted((e for e in pending if e[0] < passed * 1000), key=lambda e: [(x is not None, x) for x in e])
        out = []
        for event in ready:
            at, _, to_stage, status = event
            out.append((*key, stage, to_stage, None if since is None else (at - since) / 1000.0, status, pd.Timestamp(at, unit="us"),
                        status == "failed" and not failed))
            stage, since, failed = to_stage, at, failed or status == "failed"
            pending.discard(event)
        if pending or since is None or passed < since // 1000 + keep_ms:
            state.update((stage, since, failed, passed, json.dumps(sorted(pending, key=repr))))
            wake = min(e[0] for e in pending) // 1000 + 1 if pending else (since or 0) // 1000 + keep_ms
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        columns = [run, "from_stage", "to_stage", "duration_ms", "status", "ts", "first_failure"]
        yield pd.DataFrame(out, columns=columns).astype({"ts": "datetime64[us]", "duration_ms": "float64"})

    named = events.filter(F.col(run).isNotNull()).select(F.col(run).cast("string").alias(run), *_EVENT).withWatermark("ts", delay)
    return named.groupBy(run).applyInPandasWithState(
        advance, f"{run} string, {TRANSITIONS_DDL}", "stage string, since long, failed boolean, done long, waiting string", "append",
        GroupStateTimeout.EventTimeTimeout)
