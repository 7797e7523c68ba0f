"""The n-gram Jaccard join against brute force, in one block and in many."""

import numpy as np
import pytest
from llm.helpers import documents, empty_documents, prose
from llm.test_near import edited, family, shingles, template_family

from tamarack.llm import ngram_join, sets
from tamarack.llm.prefix_tree import tree_links


def components_of(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def linked(members, percent, sizes=None):
    """All pairs of the sets whose similarity reaches the threshold; ``sizes`` may count tokens that no other set has."""
    keys = sorted(members)
    sizes = sizes or {k: len(members[k]) for k in keys}
    return [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:]
            if (c := len(members[a] & members[b])) and 100 * c >= percent * (sizes[a] + sizes[b] - c)]


@pytest.mark.parametrize("block_tokens", [1_500_000, 2_500])
@pytest.mark.parametrize("texts", [family, template_family])
def test_ngram_join(spark, texts, block_tokens):
    docs = documents(spark, texts()).repartition(5)
    got = ngram_join.ngram_join(docs, ngram_join.NgramJoin(block_tokens=block_tokens)).collect()
    members = {r.doc_id: shingles(r.text, 4) for r in docs.collect()}
    want = components_of(members, linked(members, 85))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(members[d]), c) for d, c in want.items()}


def test_family_near_the_threshold(spark):
    """Copies with edits of their own: some pairs just reach the threshold, most do not."""
    text = prose(5, 160)
    texts = [edited(text, 30 + i % 7, f"own{i}") for i in range(40)] + [edited(text, 50 + i, f"few{i}") for i in range(12)] + [prose(6, 50)]
    docs = documents(spark, texts)
    members = {r.doc_id: shingles(r.text, 4) for r in docs.collect()}
    want = components_of(members, linked(members, 85))
    assert 3 < len(set(want.values())) < len(want) - 5
    for block_tokens in (1_500_000, 2_000):
        got = ngram_join.ngram_join(docs, ngram_join.NgramJoin(block_tokens=block_tokens)).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_joined_links_are_spanning(spark):
    """At most one link fewer than sets, whatever the family; components known before are not linked again."""
    texts = template_family(120, 30) + [prose(7, 200), edited(prose(7, 200), 60, "x"), " ".join(prose(7, 200).split()[:185])]
    members = {i: set(sets.shingle_set(t, 4).tolist()) for i, t in enumerate(texts)}
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    method = ngram_join.NgramJoin(percent=80)
    want = components_of(members, linked(members, 80))
    got = [(r.a, r.b) for r in ngram_join.joined_links(table, None, method).collect()]
    assert components_of(members, got) == want
    assert len(got) == len(members) - len(set(want.values()))
    placed = spark.createDataFrame(list(want.items()), "node long, at long")
    assert ngram_join.joined_links(table, placed, method).collect() == []


def test_odd_rows(spark):
    text = prose(7, 80)
    rows = [(None, text), (None, None), (5, text), (5, text), (3, text), (9, None), (9, " \n"), (7, "same id"), (7, "another text"),
            (7, edited(text, 60, "new")), (8, "x" * 100_000), (4, "same   ID")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own = {5: [3, 3], 3: [3], 9: [9, 9], 7: [3, 4, 7], 8: [8], 4: [4], None: [None, None]}
    assert {d: sorted((r.component_id for r in got if r.doc_id == d), key=str) for d in own} == own
    assert {r.n_shingles for r in got if r.doc_id == 9} == {0}
    assert ngram_join.ngram_join(empty_documents(spark)).collect() == []


def test_trees_on_random_sets():
    rng = np.random.default_rng(0)
    for trial in range(150):
        percent, base = int(rng.choice([50, 80, 85, 95])), int(rng.integers(1, 60))
        members = {}
        for i in range(int(rng.integers(2, 40))):
            own = set(range(base)) - set(rng.integers(0, base, rng.integers(0, base // 3 + 2)).tolist()) | set(rng.integers(100, 130, rng.integers(1, 8)).tolist())
            if i and rng.random() < 0.2:
                own = set(members[int(rng.integers(i))])
            members[i] = own
        sizes = {i: len(s) + int(rng.integers(0, 3)) for i, s in members.items()}
        tokens = np.concatenate([np.array(sorted(s)) for s in members.values()]) * 7919 % 100_003
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in members.values()])])
        nodes, size = np.arange(len(members)), np.array(list(sizes.values()))
        pairs = linked(members, percent, sizes)
        got = tree_links(nodes, size, tokens, offsets, nodes, None, percent)
        assert components_of(members, got) == components_of(members, pairs), trial
        asks = rng.random(len(members)) < 0.4
        got = tree_links(nodes, size, tokens, offsets, nodes, asks, percent)
        assert components_of(members, got) == components_of(members, [(a, b) for a, b in pairs if asks[a] != asks[b]]), trial
