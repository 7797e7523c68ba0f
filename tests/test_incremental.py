"""Facts in batches and in a stream against triangulation of all claims at once; transitions of runs in a stream."""

import datetime as dt
import os
import random

from test_streaming import drain, folder  # noqa: F401

from pyspark.sql import functions as F

from tamarack.operators import evidence as ev
from tamarack.operators import incremental as inc
from tamarack.schemas import CLAIMS_DDL
from tamarack.streaming import feeds

SEEN = ["group_key", "candidate_id", "value", "n_claims", "n_urls", "is_syndicated", *inc.STATUS]


def claims(n, seed=1):
    """Claims on few subjects from few hosts: corroborated, contradicted, republished, rejected ones."""
    r = random.Random(seed)
    hosts = ["stats.gov", "a.edu", "reuters.com", "blog.example", "b.example", "reddit.com"]
    rows = []
    for i in range(n):
        subject = min(r.randrange(12), r.randrange(12))  # some subjects have most claims
        value = 5e6 + 1e6 * (0 if subject % 3 else r.randrange(3))
        host, text = r.choice(hosts), r.choice(["", f"press item number {r.randrange(4)} "])
        rows.append((f"c{i}", f"market size of sector {subject}", "market_size", value, f"USD {value:.0f}", "USD", "India", 2024, False, None, None, r.choice([None, "Desk"]),
                     f"https://{host}/{r.randrange(6)}", f"{text}the sector {subject} market reached USD {value:.0f} in 2024", "medium", None))
    return rows


def seen(df, columns=SEEN):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_merged_facts_equal_one_run(spark):
    checked = ev.validate_claims(spark.createDataFrame(claims(300), CLAIMS_DDL))
    want = seen(ev.triangulate(checked, validated=True))
    assert {r[-5] for r in want} == {"valid", "conflict"} and {r[-4] for r in want} == {"verified", "validated"}
    part = F.pmod(F.hash("candidate_id"), F.lit(3))
    facts = [inc.claim_facts(checked.filter(part == i)) for i in range(3)]
    assert seen(inc.triangulate_facts(inc.merge_facts(*facts))) == want
    # merging is not needed to decide: a fact may come in parts
    assert seen(inc.triangulate_facts(facts[0].unionByName(facts[1]).unionByName(facts[2]))) == want
    assert inc.triangulate_facts(inc.claim_facts(checked.limit(0))).collect() == []


def test_facts_keep_requests_apart(spark):
    df = spark.createDataFrame(claims(120, 4), CLAIMS_DDL).withColumn("request_id", F.when(F.hash("candidate_id") % 2 == 0, "r1").otherwise("r2"))
    checked = ev.validate_claims(df)
    want = seen(ev.triangulate(checked, validated=True), ["request_id", *SEEN])
    assert seen(inc.triangulate_facts(inc.merge_facts(inc.claim_facts(checked))), ["request_id", *SEEN]) == want


def test_store_reads_what_a_batch_touches(spark, folder):  # noqa: F811
    rows = claims(200, 2)
    facts, changes = folder + "/facts", folder + "/changes"
    # a further host for one subject
    only = [(*r[:12], "https://ons.gov.uk/1", *r[13:]) for r in rows[150:] if r[1].endswith("sector 1")]
    batches = [rows[:100], rows[100:150], only]
    so_far = []
    for number, part in enumerate(batches):
        so_far += part
        checked = ev.validate_claims(spark.createDataFrame(part, CLAIMS_DDL))
        new = inc.status_changes(spark, checked, facts, changes, number, buckets=8)
        want = ev.triangulate(spark.createDataFrame(so_far, CLAIMS_DDL))
        assert seen(inc.latest_statuses(spark.read.parquet(changes)), ["group_key", *inc.STATUS]) == seen(want, ["group_key", *inc.STATUS])
        if number == 2:
            assert {r.metric for r in new.collect()} == {"market size of sector 1"}
            assert {r.metric for r in inc.triangulate_facts(inc.facts_of_subjects(spark, facts, 2)).collect()} == {"market size of sector 1"}
    # a batch taken in again changes nothing
    before = seen(inc.latest_statuses(spark.read.parquet(changes)))
    inc.status_changes(spark, ev.validate_claims(spark.createDataFrame(only, CLAIMS_DDL)), facts, changes, 2, buckets=8)
    assert seen(inc.latest_statuses(spark.read.parquet(changes))) == before
    inc.compact_facts(spark, facts, folder + "/compact", 2, buckets=4)
    assert seen(inc.triangulate_facts(inc.stored_facts(spark, folder + "/compact"))) == seen(ev.triangulate(spark.createDataFrame(so_far, CLAIMS_DDL)))
    assert inc.stored_facts(spark, folder + "/compact").count() < inc.stored_facts(spark, facts).count()


def files(spark, folder, name, parts, schema):  # noqa: F811
    """One file per part, in order of time."""
    os.makedirs(f"{folder}/{name}")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{name}-{i}")
        written = next(n for n in os.listdir(f"{folder}/{name}-{i}") if n.endswith(".parquet"))
        os.rename(f"{folder}/{name}-{i}/{written}", f"{folder}/{name}/{i}.parquet")
        os.utime(f"{folder}/{name}/{i}.parquet", (1e9 + i, 1e9 + i))
    return f"{folder}/{name}"


def test_running_statuses_of_a_stream(spark, folder):  # noqa: F811
    rows = claims(150, 3)
    path = files(spark, folder, "claims", [rows[:8], rows[8:60], rows[60:]], CLAIMS_DDL)
    checked = ev.validate_claims(feeds.read_feed(spark, path, CLAIMS_DDL, max_files=1))
    query = feeds.stream_statuses(checked, folder + "/facts", folder + "/changes", folder + "/cp", buckets=4).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    changes = spark.read.parquet(folder + "/changes")
    assert changes.select("batch").distinct().count() == 3
    got = inc.latest_statuses(changes)
    assert seen(got, ["group_key", *inc.STATUS]) == seen(ev.triangulate(spark.createDataFrame(rows, CLAIMS_DDL)), ["group_key", *inc.STATUS])
    # a subject that became contradicted shows both statuses, in order
    history = {}
    for r in changes.orderBy("batch").collect():
        history.setdefault(r.group_key, []).append(r.validation_status)
    assert ["valid", "conflict"] in [sorted(set(h), key=h.index) for h in history.values()]


EVENTS = "pipeline_id string, stage string, status string, message string, progress_percent int, ts timestamp"


def test_transitions_of_a_stream_equal_batch(spark, folder):  # noqa: F811
    t = dt.datetime(2024, 1, 1)

    def at(minutes, run, stage, status="running", percent=None):
        return (run, stage, status, "", percent, t + dt.timedelta(minutes=minutes))

    first = [at(0, "p1", "received", percent=5), at(2, "p1", "discovery", percent=30), at(1, "p2", "received"), at(1, "p2", "received"), at(3, "p1", "fetch")]
    # out of order within the delay, repeats, two events at one time, a failure after which a run goes on
    second = [at(2.5, "p1", "retry", "failed", 31), at(3, "p1", "fetch"), at(6, "p2", "extract", percent=40), at(6, "p2", "discovery", percent=20), at(7, "p1", "extract", "failed"),
              at(40, "p3", "received")]
    third = [at(41, "p2", "sizing", "failed"), at(42, "p1", "done"), at(43, "p3", "discovery")]
    too_late = [at(1, "p1", "never seen"), at(2, "p1", "discovery", percent=30)]
    end = [at(900, "end", "received")]
    path = files(spark, folder, "events", [first, second, third, too_late, end, [at(901, "end", "done")]], EVENTS)
    feed = feeds.read_feed(spark, path, EVENTS, max_files=1)
    drain(feeds.stream_transitions(feed, delay="10 minutes"), "transitions", "append", folder)
    key = lambda r: (r.pipeline_id, r.ts, r.from_stage or "", r.to_stage, r.duration_ms, r.status, r.first_failure)
    got = sorted(map(key, spark.table("transitions").collect()), key=repr)
    batch = feeds.run_transitions(spark.createDataFrame(first + second + third, EVENTS))
    assert got == sorted(map(key, batch.collect()), key=repr)
    assert len(got) == 12 and sum(r[-1] for r in got) == 2


def test_pages_by_cursor_equal_pages_by_offset(spark, folder):  # noqa: F811
    from tamarack.sources import analyses as store

    rows = [(f"a{i:03d}", f"2024-01-{1 + i % 9:02d}", "idea", "done") for i in range(60)]
    log = store.AnalysisLog(spark, folder + "/log")
    log.save(spark.createDataFrame(rows, "analysis_id string, created_at string, business_idea string, status string"), 1)
    kept = log.compact(folder + "/by-time").log()
    after, seen_ids = None, []
    for page in range(7):
        got = store.history_after(kept, 10, after).collect()
        assert [r.analysis_id for r in got] == [r.analysis_id for r in store.history_page(kept, 10, 10 * page).collect()]
        seen_ids += [r.analysis_id for r in got]
        after = (got[-1].created_at, got[-1].analysis_id) if got else after
    assert sorted(seen_ids) == sorted(r[0] for r in rows)
    plan = store.history_after(kept, 10, ("2024-01-03", "a007"))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(created_at,2024-01-03)" in plan
