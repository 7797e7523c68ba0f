"""Near-duplicates and nearest neighbours against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from llm.helpers import documents, empty_documents, odd_texts, prose
from pyspark.sql import functions as F

from tamarack.llm import ann, minhash


def shingles(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def groups_by_hand(rows, n):
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(text, step, mark):
    words = text.split()
    return " ".join(mark if i % step == step - 1 else w for i, w in enumerate(words))


def family():
    base = [prose(40 + i, 150) for i in range(6)]
    texts = odd_texts() + base + base[:2] + [t.upper() for t in base[:2]] + [t.replace(" ", "  \n") for t in base[:2]]
    texts += [edited(t, step, m) for t in base for step, m in ((150, "one"), (50, "two"), (40, "three"), (23, "four"), (12, "five"))]
    # a chain: each differs from the next in a little, the ends in much
    chain = base[5].split()
    for i in range(12):
        chain = chain[:i * 10] + [f"link{i}"] + chain[i * 10 + 1:]
        texts.append(" ".join(chain))
    texts += [f"{prose(90, 20)} tail{i}" for i in range(60)] + ["a b c d e f g h i j", "a b c d e f g h i k", "a b", "A  b", "b a"]
    return texts


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    docs = documents(spark, family()).repartition(5)
    got = minhash.near_duplicates(docs, minhash.MinHash(shingle_words=words)).collect()
    want = groups_by_hand([(r.doc_id, r.text) for r in docs.collect()], words)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def template_family(members=500, pairs=60):
    """A long passage (170 shingles of 200) in every text; the first texts are linked two by two, 0.81 similar, the others not at all (0.74)."""
    passage = " ".join(f"t{i}" for i in range(173))
    tails = [" ".join(f"u{d}x{i}" for i in range(30)) for d in range(members)]
    for d in range(pairs):
        one, two = 2 * d + 1, 2 * d + 2
        tails[two] = " ".join(tails[one].split()[:11] + tails[two].split()[11:])
    return [f"{passage} {t}" for t in tails]


def test_near_duplicates_within_a_template_family(spark):
    rows = list(enumerate(template_family()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, minhash.MinHash(shingle_words=4)).collect()
    want = groups_by_hand(rows, 4)
    assert len({c for _, c in want.values()}) == len(rows) - 60
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_odd_rows(spark):
    text = prose(7, 80)
    rows = [(None, text), (None, None), (5, text), (5, text), (3, text), (9, None), (9, ""), (7, "same id"), (7, "another text")]
    rows += [(7, edited(text, 60, "new")), (2, None), (2, "alone by its own text")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    own = {5: [3, 3], 3: [3], 9: [9, 9], 7: [3, 7, 7], 2: [2, 2], None: [None, None]}
    assert {d: sorted((r.component_id for r in got if r.doc_id == d), key=str) for d in own} == own
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(empty_documents(spark)).collect() == []


def test_signatures_estimate_similarity():
    signer = minhash._Signer(minhash.MinHash(bands=200, band_rows=1))
    rng = np.random.default_rng(3)
    for size in (3, 12, 2000):  # densification: far fewer members than bins, too
        values = np.unique(rng.integers(0, 2**63, 3 * size).astype(np.uint64))
        shares = []
        for _ in range(40):
            picked = rng.permutation(values)
            a, b = np.sort(picked[:2 * size]), np.sort(picked[size:3 * size])
            shares.append((signer.bands(a) == signer.bands(b)).mean())
        assert abs(np.mean(shares) - 1 / 3) < 0.06


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    got = minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)


def vectors(spark, n, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)).astype(np.float32)
    m[10:40] = m[10]  # a group of copies
    m[60] = m[61] * 2
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    odd = [(n, None), (None, rows[3][1]), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [1.0, float("inf")] + [0.0] * (dim - 2)),
           (n + 4, [None] + [1.0] * (dim - 1)), (n + 5, []), (50, rows[50][1])]
    return m, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")


def neighbours_by_hand(m, k):
    m = m.astype(np.float64)
    score = (m @ m.T) / np.linalg.norm(m, axis=1)[:, None] / np.linalg.norm(m, axis=1)
    for q in range(0, len(m), 10):
        s = np.round(score[q], 12)
        s[q] = -9
        yield q, np.lexsort((np.arange(len(m)), -s))[:k].tolist(), score[q]


def found(df):
    by = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(by[r.query_id]) + 1
        by[r.query_id].append((r.vec_id, r.score))
    return by


def test_nearest_is_exact_while_windows_cover_all(spark):
    m, df = vectors(spark, 300)
    got = found(ann.nearest(df.withColumn("cls", F.lit("own")), F.col("id") % 10 == 0, curves=ann.Curves(curves=2)))
    assert set(got) == set(range(0, 300, 10))
    for q, best, score in neighbours_by_hand(m, 5):
        assert [v for v, _ in got[q]] == best
        assert all(s == pytest.approx(score[v], abs=1e-12) for v, s in got[q])


def test_nearest_recall_over_many_blocks(spark):
    m, df = vectors(spark, 3000)
    got = found(ann.nearest(df, F.col("id") % 10 == 0, curves=ann.Curves(curves=24, slices=45, reach=1, least_slice=1)))
    hits = [len({v for v, _ in got[q]} & set(best)) for q, best, _ in neighbours_by_hand(m, 5)]
    assert sum(hits) >= 0.9 * 5 * len(hits)


def test_nearest_in_a_dense_group(spark):
    rng = np.random.default_rng(11)
    m = rng.standard_normal((6000, 24))
    m[:2000] = m[0] + 1e-4 * rng.standard_normal((2000, 24))  # a third are near copies of one vector
    rng.shuffle(m)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = found(ann.nearest(df, F.col("id") % 10 == 0, curves=ann.Curves(curves=24, slices=120, reach=1, least_slice=1, together=8)))
    dense = [len({v for v, _ in got[q]} & set(best)) for q, best, score in neighbours_by_hand(m, 5) if np.sort(score)[-1000] > 0.9999]
    assert len(dense) > 100 and sum(dense) >= 0.9 * 5 * len(dense)


def test_nearest_among_scaled_copies(spark):
    rng = np.random.default_rng(12)
    m = rng.standard_normal((900, 24))
    m[:600] = m[0] * (2.0 ** (np.arange(600) % 40))[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = found(ann.nearest(df, F.col("id") == 599, curves=ann.Curves(curves=4, slices=8, reach=1, least_slice=1)))
    assert [i for i, _ in got[599]] == [0, 1, 2, 3, 4]


def test_blocks_divide_the_work_only(spark):
    _, df = vectors(spark, 700)
    few = ann.Curves(curves=2, slices=4, reach=3, least_slice=1, block_rows=40, block_queries=3, together=1)
    got = found(ann.nearest(df, F.col("id") % 50 == 0, curves=few))
    whole = found(ann.nearest(df, F.col("id") % 50 == 0))
    assert got == whole and ann.Curves().slices_of(700) == 1 and ann.Curves().slices_of(10**9) == 64


def test_nearest_with_repeated_ids(spark):
    """An id with several directions counts by its best one, is no neighbour of its own, and no neighbour comes twice."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.2]), (1, [2.0, 0.0]), (2, [1.0, 0.3]), (2, [0.0, 1.0]), (3, [-1.0, 0.1]), (4, [0.5, 0.5]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.nearest(df, F.col("id") == 1, k=5))

    def cosine(a, b):
        return np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)

    best = {j: max(cosine(a, b) for i, a in rows if i == 1 for x, b in rows if x == j) for j in (2, 3, 4)}
    assert [(v, pytest.approx(s)) for v, s in got[1]] == sorted(best.items(), key=lambda x: -x[1])


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0])], "vec_id int, embedding array<double>")
    got = found(ann.nearest(df, F.col("id") % 10 == 0))
    assert got == {0: [(1, 0.0)]}
    assert ann.nearest(df.limit(0), F.col("id") >= 0).collect() == []


def test_hilbert_keys_are_a_curve():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        cells = np.stack([a.reshape(-1) for a in axes], axis=1)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
