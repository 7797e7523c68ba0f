"""Analyses in buckets, saved search responses."""

import os
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from test_incremental import folder  # noqa: F401

from tamarack.sources import analyses as store
from tamarack.sources import catalog

COLUMNS = "analysis_id string, business_idea string, created_at string, status string"


def files(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path.removeprefix("file://")).rglob("*.parquet")}


def state(df):
    return {r.analysis_id: (r.business_idea, r.created_at, r.status) for r in df.collect()}


def test_upserts_rewrite_the_buckets_they_touch(spark, folder):  # noqa: F811
    path = folder + "/analyses"
    rows = {f"a{i:03d}": (f"idea {i}", f"2024-01-{1 + i % 28:02d}", "partial") for i in range(200)}

    def table(d):
        return spark.createDataFrame([(k, *v) for k, v in d.items()], COLUMNS)

    kept = store.AnalysisBuckets(spark, path, buckets=16).create(table(rows))
    assert state(kept.current()) == rows
    before = files(path)
    kept.upsert(table({"a007": ("changed", "2025-01-01", "completed"), "b1": ("new", "2025-02-02", "partial")}))
    rows["a007"], rows["b1"] = (*rows["a007"][:2], "completed"), ("new", "2025-02-02", "partial")
    assert state(kept.current()) == rows and kept.get("a007").first().status == "completed"
    after = files(path)
    same = {p for p in before if after.get(p) == before[p]}
    buckets = {os.path.dirname(p) for p in before}
    # the files of all buckets but two are the same ones
    assert len(buckets) == 16 and len({os.path.dirname(p) for p in same}) in (14, 15)

    kept.delete(spark.createDataFrame([("a007",), ("unknown",), (None,)], "analysis_id string"))
    del rows["a007"]
    assert state(kept.current()) == rows and kept.get("a007").isEmpty()
    kept.upsert(table({"a007": ("again", "2026-01-01", "partial"), "a008": ("x", "x", "completed")}))
    rows["a007"], rows["a008"] = ("again", "2026-01-01", "partial"), (*rows["a008"][:2], "completed")
    assert state(kept.current()) == rows
    # a bucket whose last analysis goes is empty, and an empty batch changes nothing
    kept.delete(kept.current().select("analysis_id"))
    assert kept.current().isEmpty()
    last = files(path)
    kept.upsert(table(rows).limit(0))
    assert files(path) == last
    with pytest.raises(AnalysisException):
        kept.create(table(rows))


def test_one_analysis_reads_one_bucket(spark, folder):  # noqa: F811
    kept = store.AnalysisBuckets(spark, folder + "/one", buckets=8).create(
        spark.createDataFrame([(i, f"idea {i}") for i in range(100)], "analysis_id long, business_idea string"))
    one = kept.get("42")
    assert [r.business_idea for r in one.collect()] == ["idea 42"]
    assert len({os.path.dirname(f) for f in one.inputFiles()}) <= 8
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(analysis_id,42)" in plan


def test_saved_responses(spark, folder):  # noqa: F811
    path = folder + "/payloads"
    listed = '[{"url": "https://a.org/x", "title": "A"}, {"url": "https://b.org/y"}]'
    asked = spark.createDataFrame(
        [("r1", "q", 1, listed), ("r2", "q \u00e9\n", None, '{"results": ' + listed + "}"), ("r3", "q", 5, None), ("r4", "q", 5, "no json")],
        "request_id string, query_used string, max_results int, payload string")
    catalog.write_payloads(asked, path)
    # responses as a service sends them, with the payload as an object or a list, and broken lines
    Path(path.removeprefix("file://"), "more.json").write_text(
        '{"request_id": "r5", "query_used": "q", "max_results": 5, "payload": {"items": [{"link": "https://c.org/z", "name": "C, \\"c\\""}]}}\n'
        '{"request_id": "r6", "payload": [{"url": "https://d.org/"}], "other": 1}\nno json\n\n{"query_used": "q"}\n[1]\n')
    saved = catalog.read_payloads(spark, path)
    assert sorted(r.request_id for r in saved.collect()) == ["r1", "r2", "r3", "r4", "r5", "r6"]
    got = sorted((r.request_id, r.url, r.title) for r in catalog.parse_search_results(saved).collect())
    assert got == [
        ("r1", "https://a.org/x", "A"), ("r2", "https://a.org/x", "A"), ("r2", "https://b.org/y", "Document at b.org"),
        ("r5", "https://c.org/z", 'C, "c"'), ("r6", "https://d.org/", "Document at d.org")]
    one = catalog.parse_search_results(saved.filter("request_id = 'r5'"))
    assert one.count() == 1 and "EqualTo(request_id,r5)" in one._jdf.queryExecution().executedPlan().toString()
