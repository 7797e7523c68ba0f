"""Filter audit and hard negatives against brute force."""

from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from llm.helpers import documents, empty_documents, odd_texts, prose
from pyspark.sql import functions as F

from tamarack.llm import filter_audit, hard_negatives


def failing(rows):
    """Letters that each (doc_id, text) fails."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = text.encode().split()
        smaller = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t in rows)
        tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                 any(c in "#$%&*|" for c in text), smaller)
        out.append({f for f, t in zip("ABCDE", tests, strict=True) if t})
    return out


def audited(rows, good, toxic):
    """The whole result by applying every order to every document; ``rows`` are (doc_id, text, lang)."""
    fails = failing([(d, t) for d, t, _ in rows])
    out, shapley = {}, Counter()
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(d, f) for (d, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [d for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x for _, x in mine) - len(gone), sum(x == {f} for _, x in mine),
                                          sum(d in good for d in gone), sum(d in toxic for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_filter_audit(spark):
    long = [" ".join(f"w{s}x{i}" for i in range(120)) for s in range(8)]
    texts = odd_texts() + long + long[:3] + [None, "", prose(9, 300), long[4].upper(), long[5] + " #", long[5] + " #", long[6] + "\n" * 3, "É" * 90 + "ABCDEFGHI", "É" * 90 + "ABCDEFGHIJK"]
    docs = documents(spark, texts)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    ids = [d for d, _, _ in rows]
    labels = spark.createDataFrame(
        [(d, i % 2, 1 if i % 5 == 0 else 0) for i, d in enumerate(ids) if i % 3] + [(ids[1], 1, None), (ids[1], None, 0), (None, 1, 1), (10**9, 1, 1)],
        "doc_id long, quality int, toxic int")
    known = labels.collect()
    good, toxic = {r.doc_id for r in known if r.quality == 1}, {r.doc_id for r in known if r.toxic == 1}
    got = as_dict(filter_audit.filter_audit(docs.repartition(3), labels))
    assert got == audited(rows, good, toxic)
    assert any(v[2] for v in got.values()) and any(v[3] for v in got.values()) and any(v[4] for v in got.values())


def test_filter_audit_of_odd_rows(spark):
    rows = [(None, "a b", "en"), (None, "a b", "en"), (4, "a b", None), (4, "a b", ""), (9, "a b", ""), (9, None, None), (2, "", "en"), (9, "c" * 300_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("own")).withColumn("mask", F.lit("own"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert as_dict(filter_audit.filter_audit(docs, labels)) == audited(rows, set(), set())
    assert filter_audit.filter_audit(empty_documents(spark), labels).collect() == []


def test_gray_walk_counts_each_subset():
    rng = np.random.default_rng(1)
    for n in (1, 3, 5):
        masks = np.arange(1 << n)
        counts = rng.integers(0, 100, (1 << n, 2))
        got = filter_audit.gray_survivors(masks, counts, n)
        for active in range(1 << n):
            assert got[active].tolist() == counts[masks & active == 0].sum(axis=0).tolist()


def mined(rows, m):
    """rows: (id, label, vector) that take part; anchors are ids divisible by 50."""
    rows = [(i, lab, tuple(int(np.floor(256.0 * x)) for x in v)) for i, lab, v in rows]
    rows = list(dict.fromkeys(rows))
    out = []
    for a, (i, lab, v) in enumerate(rows):
        if i % 50:
            continue
        score = [(sum(p * q for p, q in zip(v, w, strict=True)) if len(v) == len(w) else None) for _, _, w in rows]
        ranked = sorted((k for k in range(len(rows)) if k != a and score[k] is not None), key=lambda k: (-score[k], rows[k][0]))
        for p in [k for k in ranked if rows[k][1] == lab][:m.positives]:
            fits = [k for k in ranked if rows[k][1] != lab and m.low_percent * score[p] <= 100 * score[k] <= m.high_percent * score[p]]
            out += [(i, rows[p][0], r, rows[k][0], score[p], score[k]) for r, k in enumerate(fits[:m.negatives], 1)]
    return sorted(out)


def mine(spark, rows, m):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("q", F.lit("own")).withColumn("key", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(table, F.col("label"), F.col("id") % 50 == 0, m).collect())


@pytest.mark.parametrize("block", [1 << 21, 400])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vectors = np.float32(centres[rng.integers(0, 6, 900)] * rng.choice([0.2, 1.0], 900)[:, None] + 0.3 * rng.normal(size=(900, 8)))
    rows = [(i, int(i * 7 % 4), v.tolist()) for i, v in enumerate(vectors)]
    # equal vectors: ties by id, within and across labels; a third of the rows in one direction
    rows += [(900 + i, i % 4, vectors[17].tolist()) for i in range(300)]
    m = hard_negatives.Mining(block_values=block, anchor_values=block // 2, clusters=5)
    got = mine(spark, rows, m)
    assert got == mined(rows, m)
    assert len(got) > 200


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.5, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.75, 0.0]), (3, 1, [2.0, 0.0]), (50, 3, [0.0, 0.0]),
            (51, 3, [0.0, 0.0]), (52, 1, [0.0, 0.0]), (100, 1, [-1.0, -1.0]), (150, 2, [1.0, 1.0, 1.0]), (151, 2, [1.0, 1.0, 0.5]), (152, 1, [0.9, 0.9, 0.5]),
            (200, 5, []), (201, 5, []), (202, 6, [])]
    left_out = [(None, 1, [1.0, 0.5]), (4, None, [1.0, 0.5]), (5, 1, None), (6, 2, [1.0, None]), (7, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0])]
    m = hard_negatives.Mining()
    assert mine(spark, rows + left_out, m) == mined(rows, m)
    assert mine(spark, left_out, m) == []
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(empty, F.col("label"), F.col("id") % 50 == 0).collect() == []


def test_walks_stop_early_where_bounds_are_tight():
    """In narrow clusters a walk ends long before its list does, with the whole result."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = np.floor(256 * (centres[rng.integers(0, 20, 20_000)] + 0.01 * rng.normal(size=(20_000, 16)))).astype(np.int64)
    a = x[:60]
    w = hard_negatives._Walk(a, x, centres / np.linalg.norm(centres, axis=1)[:, None])
    scored = Counter()
    plain = w.scores
    w.scores = lambda members, places: (scored.update(n=len(members) * len(places)), plain(members, places))[1]
    owner = np.arange(len(a))
    low, high = np.full(60, hard_negatives.NONE), np.full(60, np.iinfo(np.int64).max)
    i, p, s = hard_negatives.walk(w, owner, low, high, lambda walkers, places: np.ones((len(walkers), len(places)), bool), np.arange(len(x)), 5)
    assert scored["n"] < 0.5 * len(a) * len(x)
    best = defaultdict(list)
    for walker, place in zip(i.tolist(), p.tolist(), strict=True):
        best[walker].append(place)
    scores = a @ x.T
    for walker in range(60):
        assert best[walker] == sorted(range(len(x)), key=lambda k: (-scores[walker, k], k))[:5]
