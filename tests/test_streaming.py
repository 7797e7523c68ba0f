"""Streaming operators on file sources; checkpoints go where the session says, else to a temporary folder."""

import datetime as dt
import os
import tempfile

import pytest

from tamarack.operators.extract import extract_claims
from tamarack.streaming import feeds


@pytest.fixture()
def folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    with tempfile.TemporaryDirectory(prefix="run-", dir=shared or "/tmp") as d:
        yield d


def drain(df, name, mode, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", os.path.join(folder, "cp-" + name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_run_progress(spark, folder):
    t = dt.datetime(2024, 1, 1)
    schema = "pipeline_id string, stage string, status string, message string, progress_percent int, ts timestamp"
    rows = [("p1", "received", "running", "", 5, t), ("p1", "discovery", "running", "", 30, t + dt.timedelta(seconds=2)), ("p2", "received", "failed", "", 5, t)]
    spark.createDataFrame(rows, schema).write.parquet(folder + "/ev")
    drain(feeds.run_progress(feeds.read_feed(spark, folder + "/ev", schema)), "progress", "complete", folder)
    got = {(r.pipeline_id, r.stage, r.progress_percent) for r in spark.table("progress").collect()}
    assert got == {("p1", "discovery", 30), ("p2", "received", 5)}
    batch = spark.read.schema(schema).parquet(folder + "/ev")
    moved = [r for r in feeds.stage_durations(batch).collect() if r.from_stage]
    assert [(r.from_stage, r.to_stage, r.duration_ms) for r in moved] == [("received", "discovery", 2000.0)]
    assert [(r.pipeline_id, r.failed_stage) for r in feeds.first_failures(batch).collect()] == [("p2", "received")]


def test_stream_claims_equal_batch_without_repeats(spark, folder):
    schema = "original_url string, source_name string, content string, fetched_at timestamp"
    t = dt.datetime(2024, 1, 1)
    rows = [(f"https://d{i % 3}.org/{i % 4}", "S", f"India has {i % 4 + 5} million students in 2024.", t) for i in range(12)]
    spark.createDataFrame(rows, schema).write.parquet(folder + "/docs")
    drain(feeds.stream_claims(feeds.read_feed(spark, folder + "/docs", schema)), "claims", "append", folder)
    got = sorted((r.source_url, r.value) for r in spark.table("claims").collect())
    batch = extract_claims(spark.createDataFrame(rows, schema).dropDuplicates(["original_url", "content"]))
    assert got == sorted((r.source_url, r.value) for r in batch.collect()) and len(got) == 12


def test_running_corroboration_is_exact(spark, folder):
    schema = "original_url string, source_name string, content string, fetched_at timestamp"
    t = dt.datetime(2024, 1, 1)
    rows = [(f"https://d{i % 7}.org/{i}", "S", f"India has {5 + i % 2} million students in 2024.", t + dt.timedelta(days=i)) for i in range(20)]
    late = [("https://end.org/x", "S", "India has 9 million teachers in 2024.", t + dt.timedelta(days=60))]
    # one file at a time: the last moves the watermark beyond all windows before it
    for i, part in enumerate((rows[:10], rows[10:], late, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/part{i}")
        os.makedirs(f"{folder}/docs", exist_ok=True)
        name = next(n for n in os.listdir(f"{folder}/part{i}") if n.endswith(".parquet"))
        os.rename(f"{folder}/part{i}/{name}", f"{folder}/docs/{i}.parquet")
        os.utime(f"{folder}/docs/{i}.parquet", (1e9 + i, 1e9 + i))
    claims = extract_claims(feeds.read_feed(spark, folder + "/docs", schema, max_files=1), carry=("fetched_at",))
    drain(feeds.stream_corroboration(claims), "corroboration", "append", folder)
    batch = feeds.stream_corroboration(extract_claims(spark.createDataFrame(rows, schema), carry=("fetched_at",)))
    key = lambda r: (r.window.start, r.group_key, r.n_domains, r.n_claims)
    got, want = sorted(map(key, spark.table("corroboration").collect())), sorted(map(key, batch.collect()))
    assert got == want and len(want) > 4 and max(r[2] for r in want) > 2
