"""Line de-duplication, sharding and quality rules against plain Python."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from llm.helpers import documents, empty_documents, odd_texts, prose
from pyspark.sql import functions as F

from tamarack.llm import line_dedup, quality, sharding

BLANKS = " \t\n\x0b\x0c\r"


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def dedup_by_hand(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    key = lambda line: lowered(line.strip(BLANKS))
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-(2**63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        me = -(2**63) if d is None else d
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != me)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINE = "This line is long enough, É."
LINE_TEXTS = odd_texts() + [
    f"one\n{LINE}\ntwo", f"{LINE}\n{LINE}", f"  {LINE.replace('T', 't')}\t", f"{LINE.replace('É', 'é')}", f"{LINE}\nlast", "same short\n" * 5,
] + [f"{prose(i % 3, 8)}\nown {i}\n{prose(i % 2, 9)}" for i in range(12)]


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, batches):
    docs = documents(spark, LINE_TEXTS)
    # a repeated row, a null id twice, an id with two texts
    more = spark.createDataFrame([(4, LINE), (4, LINE), (None, LINE), (None, "only\n" + LINE), (10, LINE + "\nb")], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True).select("doc_id", "text", F.lit("own").alias("n_lines"), F.lit(1).alias("extra"))
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=2)
    assert got.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=repr) == dedup_by_hand(rows)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(empty_documents(spark)).collect() == []


def shard_by_hand(key, weights):
    base = struct.unpack("<q", struct.pack("<Q", 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)))[0]
    h = xxhash.xxh64_intdigest(struct.pack("<q", base), 42)
    scores = []
    for i, w in enumerate(weights):
        if w > 0:
            u = ((xxhash.xxh64_intdigest(struct.pack("<i", i), h) >> 11) + 0.5) / 2**53
            scores.append((math.log(u) / w, -i))
    return -max(scores)[1]


@pytest.mark.parametrize("weights", [[1.0] * 24, [0.0, 3.0, 1.0, 0.5], [2.0]])
def test_shards(spark, weights):
    docs = documents(spark).unionByName(documents(spark)).unionByName(spark.createDataFrame([(None, "x"), (None, None)], "doc_id long, text string"), allowMissingColumns=True)
    got = sharding.shard_documents(docs, weights).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.law == "key" and r.shard == shard_by_hand(r.doc_id, weights)
        assert r.grown_shard == shard_by_hand(r.doc_id, weights + weights[-1:])
        assert r.grown_shard in (r.shard, len(weights))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_shards_follow_weights(spark):
    got = spark.range(20_000).select(sharding.rendezvous_shard(F.col("id"), [1.0, 2.0, 1.0]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20_000 for r in got}
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("id"), [0.0])
    assert sharding.shard_documents(empty_documents(spark), [1.0]).collect() == []


def statistics_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if grams[tuple(words[i:i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_text_statistics(spark):
    texts = odd_texts() + ["a b c a b c", "a a a a", "a a a", "x y z q x y z\nx y z\n x y z\nx y z", "## a\n|b|\n## a", "a b c d b c d b c d", " \x1c \x85 "]
    docs = documents(spark, texts, extra=False)
    got = {r.doc_id: r for r in quality.text_statistics(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == statistics_by_hand(r.text), r.text


def test_filter_on_statistics_keeps_the_plan_small(spark):
    plan = quality.text_statistics(documents(spark, extra=False)).filter("n_repeat_words > 3 AND n_words > 5")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in text and text.count("xxhash64(") == 1


def tail_by_hand(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(0, 1), (0, 100), (1, 100), (3, 2000), (5, 1000), (90, 20_000), (400, 100_000), (480, 100_000)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(1.0 if r.k > 0.005 * r.n else tail_by_hand(r.k, r.n, 0.005), rel=1e-6)
    assert spark.range(1).select(quality.binomial_tail(F.lit(9), F.lit(100), 0.005).alias("p")).first().p == 1.0


def labelled(spark, bad_share):
    """4000 English documents: symbol_share 0.9 for the bad ones, and for ``bad_share`` of the good ones."""
    return spark.range(4000).selectExpr(
        "id AS doc_id", "'en' AS lang", "200L AS n_words", "1000L AS word_chars", "5L AS n_lines_with_words", "0L AS n_dup_lines", "0L AS n_upper",
        "0L AS n_repeat_words", f"CASE WHEN id % 10 = 0 OR id % 1000 < {bad_share * 1000} THEN 900L ELSE 0L END AS n_symbols")


def test_cutoffs_bound_false_rejections(spark):
    labels = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 0 ELSE 1 END AS quality")
    # few good documents above the cutoff: the rule holds; more than alpha: it does not
    for share, found in ((0.0, True), (0.002, True), (0.05, False)):
        stats = labelled(spark, share)
        cutoffs = quality.learn_cutoffs(stats, labels)
        got = {r._stratum: r._cutoffs for r in cutoffs.collect()}
        assert ("symbol_share" in got["en"]) == found
        if found:
            assert got["en"]["symbol_share"] == 0.02
        judged = quality.judge(stats, cutoffs)
        rejected = judged.join(labels, "doc_id").filter("quality = 0 AND NOT kept").count()
        assert rejected == (400 if found else 0)


def cutoffs_by_hand(rows, control):
    """Cutoffs of one stratum from its good documents (features by rule, base_failed)."""
    def reached(path):
        for i, step in enumerate(path.steps):
            k = sum(any(x[r] > c for r, c in step.items()) and not base for x, base in rows)
            if k > path.alpha * len(rows) or tail_by_hand(k, len(rows), path.alpha) > path.level:
                return i
        return len(path.steps)

    common, *alone = control.paths()
    if reached(common):
        return dict(common.steps[reached(common) - 1])
    return {p.name: p.steps[reached(p) - 1][p.name] for p in alone if reached(p)}


@pytest.mark.parametrize("n, noisy", [(150, 0), (260, 0), (260, 1), (3000, 0), (3000, 40), (6000, 40), (6000, 400), (6000, 2000)])
def test_cutoffs_along_paths(spark, n, noisy):
    """``noisy`` good documents have ever more symbols; every seventh fails the base rule and costs the cutoffs nothing."""
    docs = [(i, "fr", 10 if i % 7 == 3 else 100, 1000, 10 * (i % 45) if i < noisy else 0, 0, 5, 0, 4 * (i % 30)) for i in range(n)]
    stats = spark.createDataFrame(docs, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
                                        " n_lines_with_words long, n_repeat_words long, n_upper long")
    control = quality.RiskControl()
    got = quality.learn_cutoffs(stats, stats.selectExpr("doc_id", "1 AS quality")).collect()
    rows = [({"symbol_share": s / 1000, "dup_line_share": 0, "repeat_share": 0, "upper_share": u / 1000}, w < 50) for _, _, w, _, s, _, _, _, u in docs]
    want = cutoffs_by_hand(rows, control)
    assert [(r._stratum, r._cutoffs) for r in got] == [("fr", want)]
    if n == 150:
        assert want == {}  # too few labels to show anything
    elif noisy in (0, 40) and n != 260:
        assert len(want) == 4
    elif noisy == 400:
        assert want["symbol_share"] == 0.3  # the common path ends half way
    elif noisy == 2000:
        assert "symbol_share" not in want and len(want) == 3  # the common path fails, the others go on alone


def test_cutoffs_without_labels(spark):
    docs = quality.text_statistics(documents(spark, extra=False))
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    judged = quality.judge(docs, quality.learn_cutoffs(docs, labels)).collect()
    assert len(judged) == len(odd_texts()) and all(r.kept == (not r.base_failed) for r in judged)
    none = quality.text_statistics(empty_documents(spark))
    assert quality.judge(none, quality.learn_cutoffs(none, labels)).collect() == []


def test_line_runs_levels(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=2)
    for doc in range(9, 0, -1):
        runs.absorb(spark.createDataFrame([(1, 1, doc), (doc, doc, doc), (doc, doc, doc)], "_h1 long, _h2 long, _doc long"))
    # nine runs, merged like a binary counter
    assert [len(level) for level in runs.levels] == [1, 0, 0, 1]
    assert [(r._h1, r._last_doc) for r in runs.frequent().collect()] == [(1, 9)]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
